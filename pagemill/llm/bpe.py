"""Byte-level BPE of a public vocabulary: speculate by longest match, verify every adjacent pair, merge exactly what fails.

Public facts used: a list of tokens is the BPE encoding of its bytes exactly if each token is the encoding of
itself and every adjacent pair of tokens is the encoding of the pair's bytes.  Whether a pair is, can be told
by undoing the merges at the seam from the latest back, which numpy does here for all pairs of a batch at once.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable

import numpy as np
import regex

#: White space as the tokenizers' regular expressions understand it (the Unicode property White_Space).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Splits only where the full pattern splits too: a run without white space with at most one space before it.
_LUMPS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The vocabulary's own pattern, to which the lumps are given.
_WORDS = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_WS}\\p{{L}}\\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable in Latin-1, else 256, 257 and so on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class BytePairEncoder:
    """Encodes texts with the vocabulary file's merges, without special tokens (their strings are ordinary text)."""

    def __init__(self, vocabulary: bytes, cache_size: int = 200_000) -> None:
        model = json.loads(vocabulary)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = byte_alphabet()
        #: Inner numbers follow the order of merges; ``_out`` has the vocabulary's own.
        self._number = {c: i for i, c in enumerate(letters)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
        n = 256 + len(merges)
        self._out = np.fromiter((model["vocab"][t] for t in self._number), np.int32, n)
        self._left, self._right = np.arange(n), np.arange(n)
        self._left[256:] = [self._number[a] for a, _ in merges]
        self._right[256:] = [self._number[b] for _, b in merges]
        keys = self._left[256:] * n + self._right[256:]
        order = np.argsort(keys)
        self._pair_keys, self._pair_result, self._size = keys[order], order + 256, n
        self._merge_of = {(int(a), int(b)): i + 256 for i, (a, b) in enumerate(zip(self._left[256:], self._right[256:], strict=True))}
        self._longest: dict[str, int] = {}
        for token in self._number:
            self._longest[token[0]] = max(len(token), self._longest.get(token[0], 1))
        self._letters = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        self._cache: dict[str, list[int]] = {}
        self._cache_size = cache_size

    def _greedy(self, word: str) -> list[int]:
        number, at, out = self._number, 0, []
        while at < len(word):
            end = min(len(word), at + self._longest[word[at]])
            while (token := number.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, else one beyond all."""
        keys = a * self._size + b
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == keys, self._pair_result[at], 2 * self._size)

    def _stays_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether BPE of their joined bytes gives just the two."""
        fine = np.ones(len(first), bool)
        left, right = first.astype(np.int64), second.astype(np.int64)
        before = np.full(len(first), 2 * self._size)
        at = np.arange(len(first))
        while at.size:
            clash = self._merged(left, right) < before
            fine[at[clash]] = False
            # undo the later of the two last merges beside the seam; a single byte has none to undo
            undo_left = (left > right) & (left > 255) | (right <= 255)
            done = clash | (left <= 255) & (right <= 255)
            before = np.where(undo_left, left, right + 1)
            left, right = np.where(undo_left, self._right[left], left), np.where(undo_left, right, self._left[right])
            keep = ~done
            at, left, right, before = at[keep], left[keep], right[keep], before[keep]
        return fine

    def exact(self, word: str) -> list[int]:
        """Merges one word of stand-in letters pair by pair, the earliest merge first."""
        ids: list[int] = [self._number[c] for c in word]
        after, prior = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        heap = [(m, i) for i in range(len(ids) - 1) if (m := self._merge_of.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            merge, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self._merge_of.get((ids[i], ids[j])) != merge:
                continue
            ids[i], ids[j] = merge, -1
            after[i] = after[j]
            if after[j] >= 0:
                prior[after[j]] = i
            for a, b in ((prior[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := self._merge_of.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m, a))
        return [t for t in ids if t >= 0]

    def _learn(self, lumps: Iterable[str]) -> None:
        """Encodes lumps that the cache has not, all words of them together."""
        parts = {lump: [w.encode("utf-8", "replace").decode("latin-1").translate(self._letters) for w in _WORDS.findall(lump)] for lump in lumps}
        words = {w: self._greedy(w) for words in parts.values() for w in words}
        several = [(w, ids) for w, ids in words.items() if len(ids) > 1]
        if several:
            flat = np.fromiter((t for _, ids in several for t in ids), np.int64)
            ends = np.cumsum([len(ids) for _, ids in several])
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            seams = np.flatnonzero(inner)
            bad = seams[~self._stays_apart(flat[seams], flat[seams + 1])]
            for k in np.unique(np.searchsorted(ends, bad, side="right")):
                word = several[k][0]
                words[word] = self.exact(word)
        for lump, own in parts.items():
            self._cache[lump] = self._out[[t for w in own for t in words[w]]].tolist()

    def _lumps(self, texts: list[str | None]) -> list[list[str]]:
        lumps = [_LUMPS.findall(t) if t else [] for t in texts]
        new = set().union(*lumps).difference(self._cache) if lumps else set()
        if len(self._cache) + len(new) > self._cache_size:
            self._cache.clear()
            new = set().union(*lumps)
        self._learn(new)
        return lumps

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; an empty list for an empty text and for None."""
        known = self._cache
        return [[i for lump in own for i in known[lump]] for own in self._lumps(texts)]

    def count(self, texts: list[str | None]) -> list[int]:
        known = self._cache
        return [sum([len(known[lump]) for lump in own]) for own in self._lumps(texts)]
