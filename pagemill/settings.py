"""Settings of a run, with the defaults of the question builder."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# fixed values
DENSITIES = {"light": 3, "standard": 5, "dense": 8}
DENSITY_FACTORS = {"light": 0.85, "standard": 1.0, "dense": 1.2}
BASE_CHARS, COMPACT_FACTOR, LEAST_FACTOR, MOST_FACTOR = 6500, 1.35, 0.9, 3.2
UNLIMITED = 2**53 - 1


def js_round(x: float) -> int:
    return math.floor(x + 0.5)


@dataclass(frozen=True)
class Limits:
    """Limits of a run; the three caps on chunks are off by default, as the builder forces them to be."""

    max_files: int = 60
    max_file_bytes: int = 30 * 1024 * 1024
    max_chunks_per_file: int = UNLIMITED
    max_total_chunks: int = UNLIMITED
    max_prompt_chars: int = UNLIMITED
    low_text_chars: int = 220
    retries: int = 2


@dataclass(frozen=True)
class QuizSettings:
    target_questions: int = 20
    questions_per_prompt: float = 5
    density: str = "standard"
    response_format: str = "standard"
    option_count: int = 4
    ordering: str = "best_match"
    difficulty: str = "medium"
    topic_focus: str = ""
    question_style: str = ""
    custom_instructions: str = ""
    limits: Limits = field(default_factory=Limits)

    @property
    def questions(self) -> int:
        """Questions a prompt: not finite means the standard preset, else rounded into 1 to 100."""
        n = self.questions_per_prompt
        return max(1, min(100, js_round(n))) if math.isfinite(n) else DENSITIES["standard"]

    @property
    def char_budget(self) -> int:
        factor = min(MOST_FACTOR, max(LEAST_FACTOR, 0.6 + self.questions / 10))
        return js_round(BASE_CHARS * factor * DENSITY_FACTORS.get(self.density, 1.0) * (COMPACT_FACTOR if self.response_format == "compact" else 1.0))

    @property
    def options(self) -> int:
        return 5 if self.option_count == 5 else 4

    def with_density(self, density: str) -> QuizSettings:
        """Changing the density also resets the questions a prompt to its preset."""
        return QuizSettings(**(self.__dict__ | {"density": density, "questions_per_prompt": DENSITIES[density]}))
