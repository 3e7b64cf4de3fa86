"""Problem 8: documents with unfilled template slots, or made of filler, error messages or demands for scripts.

A document is read as units (sentences within lines).  A linear classifier over hashed word n-grams, length, title and
shape features tells slot units and residue units from ordinary ones, and it alone decides.  It is fitted on a bounded
sample: weak labels are response statuses and a short list of general phrases and notations; what stands beside a
labelled unit in a document without other text, and what the classifier then takes for residue itself, is learnt in
further rounds.  It is measured on all documents of sources it never saw.  A document is found if it has a slot unit,
or residue units and at most one ordinary sentence besides titles and site lines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import spread

#: Documents the classifier is fitted on, about; every document is classified.
SAMPLE = 6_000
#: Of each document of the sample, the units it is fitted on, at most: all over the text, by seeded hash, those with a weak label first.
SAMPLE_UNITS = 16
#: Units longer than this are no examples; they are judged like all others.
SAMPLE_UNIT_CHARS = 1_000
#: Sources are unseen, for validation, if their hash falls in one part of so many.
HELD_OUT = 5
#: Rounds of fitting; in each but the first the classifier labels what the weak labels leave open.
ROUNDS = 4
#: Of the units of ordinary text, of unseen sources, the share that lies below the margin of residue, and below that of what stands beside residue.
SURE, NEAR = 0.9995, 0.99
#: A document with so many ordinary sentences is no residue for certain, so its units are examples of ordinary text.
SURELY_ORDINARY = 6
BUCKETS = 1 << 17
UNIT_BATCH = 400

#: Filler in mock Latin, by its best known words.
MOCK_LATIN = re.compile(r"\blorem ipsum\b|\bdolor sit amet\b|\bconsectetur\b")
#: Notations of the common template languages and of form letters.
NOTATIONS = re.compile(
    r"\{\{ ?[a-z]\w*(?:[. _]\w+)* ?\}\}|[$#]\{ ?[a-z]\w* ?\}|<%=? ?[a-z]\w* ?%>|\{% ?[a-z]\w*(?: \w+)? ?%\}|<<[a-z]\w*>>|\[\[ ?[a-z]\w* ?\]\]|(?<![\w%])%[a-z]\w*%(?!\w)|(?<!\w)__[a-z]\w*__(?!\w)|&lt;[a-z]\w*&gt;"
    r"|@{1,2}[a-z]\w*@{1,2}(?!\w)|\bX{3,} ?[a-z]\w*(?: \w+)? ?X{3,}\b|[\[(](?:insert|enter|your|name of)\b[^\]\[()]*[\])]|\[(?:add|todo|tbd|name|date|title)\b[^\]\[]*\]|(?-i:\[[A-Z]{2,}(?:[ _][A-Z]+)*\])",
    re.I,
)
#: Response statuses.
STATUS = re.compile(r"^(?:error:? |http )?[45]\d\d\b(?! ?[,;%])(?=(?: \w+){1,4}(?:[.!]|$))")
#: A short list of phrases, in the languages at hand, that error messages, demands for scripts and filler everywhere consist of.
PHRASES = re.compile(
    r"\b(?:not found|access denied|forbidden|service unavailable|something went wrong|an error occurred|too many requests|timed? out|has expired|try again|no results|could not be (?:loaded|opened|found)|unable to (?:load|open)|do not have permission|fatal|traceback|exception|connection|database"
    r"|(?:enable|activate|turn on|switch on|allow|accept|requires?) (?:javascript|scripts?|cookies)|(?:javascript|cookies) (?:is|are) (?:disabled|off|required)|checking your browser|you are (?:a )?human|not a robot"
    r"|(?:sample|dummy|placeholder) (?:text|title|content)|your (?:text|title|content) here|coming soon|under construction|click to (?:add|edit)|x{4,} x{4,}"
    r"|nicht gefunden|ein fehler|zugriff verweigert|javascript aktivieren|aktivieren sie|platzhaltertext|blindtext|ihr text|introuvable|une erreur|accès refusé|activer javascript|texte de remplissage|votre texte"
    r"|no se encontr\w+|un error|acceso denegado|activ[ea]r? javascript|habilit[ea]r? javascript|texto de relleno|su texto|não encontrad[ao]|um erro|acesso negado|seu texto)\b"
)
#: Words of speaking about texts: who quotes, defines or explains a message or a notation doesn't give it.
SPEAKING = re.compile(
    r"[\"“”„«»`]|\b(?:means?|meaning|called|notation|syntax|denot\w+|defin\w+|refers? to|stands? for|such as|for example|e\.g\.|explain\w*|describ\w+|quot(?:es|ed|ing|ations?)|template languages?)\b",
    re.I
)
SITE_LINE = re.compile(r"^(?:[^.!?]{1,40}\|)+[^.!?|]{0,40}$|^[^.!?]{0,60}[©®][^.!?]{0,40}$|^copyright\b|^all rights reserved|^https?://\S+$", re.I)
HEADING = re.compile(r"^(?:unit|lesson|part|section|chapter|module|kapitel|capítulo|chapitre|unidade?|lección|leçon|lektion|teil)\s+[\w.]+\b[:.]?\s*", re.I)
_UNITS = re.compile(r"(?<=[.!?…]) +|\n+|(?<=[。！？])")
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_WORDS = re.compile(r"\w+")
#: A short run of words between signs, as slots of any notation are written.
_ENCLOSED = re.compile(
    r"([^\w\s\"'.,;:!?“”„«»`]{1,4}|(?<!\w)__|\bX{3,} ?)\s?([A-Za-z]\w*(?:[ .:\-]{1,2}\w+){0,4}?)\s?([^\w\s\"'.,;:!?“”„«»`]{1,4}|__(?!\w)|;?&gt;| ?X{3,}\b)"
)
_SIGNS = re.compile(r"[\[{<%($@&#*|~^]|__|XXX")
_DIGITS = str.maketrans("123456789", "000000000")
_QUIZ_JSON = re.compile(r"[\"'](?:questions?|correctAnswer|options)[\"']\s*:")
_HAN = re.compile(r"[぀-鿿]")


class Units(NamedTuple):
    texts: list[str]
    first: list[bool]


def units_of(text: str) -> Units:
    texts = [u for x in _UNITS.split(text) if (u := x.strip())]
    return Units(texts, [i == 0 for i in range(len(texts))])


def is_ordinary(unit: str) -> bool:
    """Whether a unit that is no residue counts as a sentence rather than a title, a heading, a site line or a scrap."""
    rest = HEADING.sub("", unit)
    if SITE_LINE.search(unit):
        return False
    if _HAN.search(rest):
        return len(rest) > 5
    words = len(_WORDS.findall(rest))
    return words >= 4 and rest[-1] in ".!?;:\"”)…" or words > 12


def weak_label(unit: str) -> int:
    """0 none, 1 slot, 2 residue, by notations, statuses and phrases alone; 3 where words or signs tell that something is spoken of."""
    if SPEAKING.search(unit):
        return 3
    low = unit.lower()
    return 1 if _SIGNS.search(unit) and NOTATIONS.search(unit) else 2 if STATUS.match(low) or len(low) < 160 and PHRASES.search(low) or MOCK_LATIN.search(low) else 0


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[token] = zlib.crc32(token.encode("utf-8", "replace"))
        return found


def shapes(text: str) -> list[str]:
    """Features of what stands between signs: the signs, and the form of the words between them, whatever the words."""
    out = []
    for before, inside, after in _ENCLOSED.findall(text):
        form = "x" if len(inside) == 1 else (
            "A" if inside.isupper() else "a" if inside.islower() else "Aa"
        ) + ("_" if "_" in inside else "") + (" " if " " in inside else "")
        out += [f"\x01shape {before.strip()}{form}{after.strip()}", f"\x01form {form}", f"\x01opens {before.strip()} {inside.split()[0].lower()}"]
    return out


class Model:
    """Hashed n-gram weights of the two classes against ordinary text, and the margins above which they count."""

    def __init__(self, weights: np.ndarray, cut: np.ndarray | None = None) -> None:
        self.weights = weights
        self.cut = np.zeros(2, np.float32) if cut is None else cut
        self._hashes = _Hashes()

    def features(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all features, start of each unit's)."""
        flat: list[int] = []
        starts: list[int] = []
        hashes = self._hashes
        for text, first in zip(units.texts, units.first, strict=True):
            starts.append(len(flat))
            tokens = _TOKENS.findall(text.lower().translate(_DIGITS))
            flat.append(hashes[f"\x01length {min(len(tokens), 30) // 2}"])
            flat.append(hashes[f"\x01title {first} {text[-1] in '.!?'} {text[:1].isupper()}"])
            if _SIGNS.search(text):
                flat += [hashes[s] for s in shapes(text)]
            flat += [hashes[t] for t in tokens]
        one = np.array(flat, np.uint64)
        begins = np.array(starts, np.int64)
        # a unit's neighbours in order give its bigrams; across units they are marked off by the length feature
        two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) if len(one) > 1 else one[:0]
        pairs = np.concatenate([two, np.zeros(1, np.uint64)])
        pairs[begins[1:] - 1] = 0
        both = np.stack([one, pairs], axis=1).reshape(-1)
        both ^= both >> np.uint64(15)
        return (both % np.uint64(BUCKETS)).astype(np.int64), begins * 2

    def scores(self, units: Units) -> np.ndarray:
        """The margins of slot and residue for each unit."""
        if not units.texts:
            return np.zeros((0, 2), np.float32)
        buckets, starts = self.features(units)
        return np.add.reduceat(self.weights[buckets], starts, axis=0)

    def found(self, units: Units) -> np.ndarray:
        """Whether each unit is a slot unit, and whether it is residue."""
        return self.scores(units) > self.cut


def fit(
    units: Units,
    labels: np.ndarray,
    epochs: int = 6,
    rate: float = 0.5,
    l2: float = 1e-6,
    seed: int = 8,
    made: tuple[np.ndarray, np.ndarray] | None = None
) -> Model:
    """Logistic regression for each class with AdaGrad steps and an L2 penalty; labels 0 ordinary, 1 slot, 2 residue, -1 left out; ``made`` are the units' features."""
    model = Model(np.zeros((BUCKETS, 2), np.float32))
    buckets, starts = made or model.features(units)
    ends = np.append(starts[1:], len(buckets))
    wanted = np.stack([labels == 1, labels == 2], axis=1).astype(np.float32)
    rarity = np.where(wanted.any(axis=1), min(10.0, max(1.0, (labels == 0).sum() / max(1, (labels > 0).sum()) / 3)), 1.0).astype(np.float32)
    squares = np.full((BUCKETS, 2), 1e-2, np.float32)
    order, rng = np.flatnonzero(labels >= 0), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 256):
            rows = order[at : at + 256]
            lengths = ends[rows] - starts[rows]
            begins = np.append(0, np.cumsum(lengths)[:-1])
            index = np.repeat(starts[rows] - begins, lengths) + np.arange(lengths.sum())
            used = buckets[index]
            margins = np.add.reduceat(model.weights[used], begins, axis=0)
            off = (1 / (1 + np.exp(-np.clip(margins, -30, 30))) - wanted[rows]) * rarity[rows, None]
            touched, place = np.unique(used, return_inverse=True)
            step = np.stack(
                [np.bincount(place, np.repeat(off[:, c], lengths), len(touched)) for c in (0, 1)],
                axis=1
            ).astype(np.float32) / len(rows) * 16 + l2 * model.weights[touched]
            squares[touched] += step**2
            model.weights[touched] -= rate * step / np.sqrt(squares[touched])
    return model


class Examples(NamedTuple):
    """Units of the sample: text, whether it is its document's first, weak label, ordinary sentences of the document, whether the source is unseen, document."""

    texts: list[str]
    first: list[bool]
    labels: np.ndarray
    ordinary: np.ndarray
    unseen: np.ndarray
    documents: np.ndarray


def is_unseen(source: str | None) -> bool:
    """Whether a source is held out for validation."""
    return zlib.crc32((source or "").strip().lower().encode()) % HELD_OUT == 0


def examples_of(text: str) -> list[tuple[str, bool, int, int]]:
    """(unit, first, weak label, ordinary sentences of the text) of the units of one text that the classifier may be fitted on."""
    if _QUIZ_JSON.search(text):
        return []
    units = units_of(text)
    labels = [weak_label(u) for u in units.texts]
    ordinary = sum(is_ordinary(u) for u, k in zip(units.texts, labels, strict=True) if k in (0, 3))
    order = sorted(
        (k == 0, zlib.crc32(u.encode("utf-8", "replace")), i) for i,
        (u, k) in enumerate(zip(units.texts, labels, strict=True)) if len(u) <= SAMPLE_UNIT_CHARS
    )
    return [(units.texts[i], units.first[i], labels[i], ordinary) for _, _, i in order[:SAMPLE_UNITS]]


EXAMPLES = "doc long, unit string, first boolean, label int, ordinary int, unseen boolean"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, *x, is_unseen(source)) for doc, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in examples_of(text)]
        columns = [*zip(*rows, strict=True)] if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "unit", "first", "label", "ordinary", "unseen"])


def sample_examples(documents: DataFrame, sample: int, seed: int) -> Examples:
    """Units of about ``sample`` seeded documents, twice as many at most; whole texts are read, by the executors."""
    share = min(1.0, sample / max(1, documents.count()))
    rows = documents.where("text is not null and doc_id is not null").select("doc_id", "source", "text")
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample)
    got = spread(drawn).mapInArrow(_examples, EXAMPLES).toPandas().sort_values(["doc", "unit"], kind="stable")
    return Examples(
        got["unit"].tolist(),
        got["first"].tolist(),
        got["label"].to_numpy(np.int64),
        got["ordinary"].to_numpy(np.int64),
        got["unseen"].to_numpy(bool),
        np.unique(got["doc"].to_numpy(), return_inverse=True)[1]
    )


def learn(rows: Examples, seed: int = 8) -> Model:
    """The classifier of the seen sources' units.

    Certainly ordinary are unlabelled units of documents with much ordinary text and no labelled unit, and units that
    speak of residue or of notations; in a corpus of short documents only, those without a labelled unit instead.  All
    other unlabelled units are open at first.  After each round those count as
    residue or slots that the classifier takes for such, and as residue also those that stand beside residue in a
    document with little else and look like no ordinary text; units with signs that it doesn't take for slots are ordinary.
    """
    if not len(rows.labels) or rows.unseen.all():
        return Model(np.zeros((BUCKETS, 2), np.float32))
    labels, documents = rows.labels, rows.documents
    n = documents.max() + 1
    labelled = np.bincount(documents, (labels == 1) | (labels == 2), n) > 0
    alone = (rows.ordinary < SURELY_ORDINARY) | labelled[documents]
    enclosed = np.array([bool(_SIGNS.search(t) and _ENCLOSED.search(t)) for t in rows.texts])
    undecided = (labels == 0) & (alone | enclosed)
    if ((labels == 0) & ~undecided & ~rows.unseen).sum() < ((labels == 1) | (labels == 2)).sum():
        undecided &= labelled[documents] | enclosed
    apart = (labels == 0) & ~undecided & rows.unseen
    known = np.where(labels == 3, 0, labels)
    made = Model(np.zeros((1, 2), np.float32)).features(Units(rows.texts, rows.first))
    now = np.where(undecided | rows.unseen, -1, known)
    for _ in range(ROUNDS):
        model = fit(Units(rows.texts, rows.first), now, seed=seed, made=made)
        margins = np.add.reduceat(model.weights[made[0]], made[1], axis=0)
        # a share can't be told from fewer units than make it up
        low, high = (np.quantile(margins[apart, 1], q) if apart.sum() * (1 - q) >= 1 else 0.0 for q in (NEAR, SURE))
        model.cut[1] = min(0.0, high)
        over = margins - model.cut
        beside = np.bincount(documents, (labels == 2) | undecided & (over[:, 1] > 0), n) > 0
        best = np.where((over > 0).any(axis=1), over.argmax(axis=1) + 1, -1)
        best[(best == -1) & alone & beside[documents] & (margins[:, 1] > low)] = 2
        best[(best == -1) & enclosed & ~alone] = 0
        now = np.where(rows.unseen, -1, np.where(undecided, best, known))
    return model


def fitted(documents: DataFrame, sample: int = SAMPLE, seed: int = 8) -> tuple[Model, bool]:
    """The classifier, fitted on a sample of the seen sources, and whether sources were held out: not if the sample has no others."""
    rows = sample_examples(documents, sample, seed)
    apart = not rows.unseen.all()
    return learn(rows if apart else rows._replace(unseen=np.zeros_like(rows.unseen)), seed), apart


TALLY = ["units", "held_out_units", *(f"{name}_{what}" for name in ("slot", "residue") for what in ("true", "found", "both")), "ordinary", "ordinary_found"]


def tally(texts: list[str], unseen: list[bool], model: Model) -> np.ndarray:
    """Counts over all units of whole documents, as TALLY names them; all but the first over unseen sources.

    For slot and residue: units with that weak label, found by the classifier, and both.  Ordinary units are those of
    documents with much ordinary text and no labelled unit.
    """
    out = np.zeros(len(TALLY), np.int64)
    for text, own in zip(texts, unseen, strict=True):
        if _QUIZ_JSON.search(text):
            continue
        units = units_of(text)
        out[0] += len(units.texts)
        if own and units.texts:
            out[1] += len(units.texts)
            labels, found = np.array([weak_label(u) for u in units.texts]), model.found(units)
            for c in (0, 1):
                true, got = labels == c + 1, found[:, c]
                out[2 + 3 * c : 5 + 3 * c] += (true.sum(), got.sum(), (true & got).sum())
            if not np.isin(labels, (1, 2)).any() and sum(map(is_ordinary, units.texts)) >= SURELY_ORDINARY:
                out[8:] += (len(units.texts), found.any(axis=1).sum())
    return out


def _shared(documents: DataFrame, model: Model):
    return documents.sparkSession.sparkContext.broadcast((model.weights, model.cut))


def validation(documents: DataFrame, model: Model, apart: bool = True) -> dict[str, float]:
    """The classifier on every unit of all whole documents of unseen sources, a repeated unit as often as it stands.

    Recall is that of the weak labels; ``*_labelled`` is the share of the units found that have one, low where the
    classifier goes beyond them; ``ordinary_found`` is the share found of the units of ordinary text.
    """
    shared = _shared(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Model(*shared.value), np.zeros(len(TALLY), np.int64)
        for batch in batches:
            total += tally(batch.column(1).to_pylist(), [apart and is_unseen(s) for s in batch.column(0).to_pylist()], own)
        yield pa.RecordBatch.from_arrays([pa.array([int(n)], pa.int64()) for n in total], TALLY)

    counted = spread(documents.where("doc_id is not null and text is not null").select("source", "text")).mapInArrow(run, ", ".join(f"{c} long" for c in TALLY))
    n = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TALLY)).first()
    report = {c: float(n[c]) for c in TALLY[:2]}
    for name in ("slot", "residue"):
        both = n[f"{name}_both"]
        report |= {f"{name}_labelled": both / max(1, n[f"{name}_found"]), f"{name}_recall": both / max(1, n[f"{name}_true"])}
    return report | {"ordinary_found": n["ordinary_found"] / max(1, n["ordinary"])}


def train(documents: DataFrame, sample: int = SAMPLE, seed: int = 8) -> tuple[Model, dict[str, float]]:
    """The classifier, fitted on seen sources, and its measures on all of the unseen ones."""
    model, apart = fitted(documents, sample, seed)
    return model, validation(documents, model, apart)


def judge(texts: list[str | None], model: Model) -> list[bool]:
    """Whether each document is to be excluded."""
    split = [units_of(t) if t else Units([], []) for t in texts]
    joined = Units([u for s in split for u in s.texts], [f for s in split for f in s.first])
    taken = model.found(joined)
    out, at = [], 0
    for text, units in zip(texts, split, strict=True):
        own = taken[at : at + len(units.texts)]
        at += len(units.texts)
        found = bool(own.any()) and not _QUIZ_JSON.search(text)
        if found and not own[:, 0].any():
            found = sum(is_ordinary(u) for u, r in zip(units.texts, own[:, 1], strict=True) if not r) <= 1
        out.append(found)
    return out


def residue_documents(documents: DataFrame, sample: int = SAMPLE, seed: int = 8) -> DataFrame:
    """(doc_id) of the documents found.

    Null, empty and blank texts are no cases; repeated rows give repeated ids; rows with a null id are left out.
    Whole texts are classified, in one narrow stage; the model (1 MB) goes along with the tasks.
    """
    model, _ = fitted(documents, sample, seed)
    shared = _shared(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, UNIT_BATCH):
                part = batch.slice(at, UNIT_BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(judge(part.column(1).to_pylist(), own), pa.bool_()))], ["doc_id"])

    return spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text")).mapInArrow(run, "doc_id long")


def corpus(documents: DataFrame, keep: list[str], sample: int = SAMPLE, seed: int = 8) -> DataFrame:
    """The columns ``keep``, text among them, of the documents that are not found, each judged where it lies, without a join.

    Null texts and rows with a null id stay.
    """
    model, _ = fitted(documents, sample, seed)
    shared = _shared(documents, model)
    given = documents.select(F.col("doc_id").isNotNull().alias("_known"), F.col("text").alias("_text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, UNIT_BATCH):
                part = batch.slice(at, UNIT_BATCH)
                found = judge(part.column(1).to_pylist(), own)
                stay = pa.array([not (f and k) for f, k in zip(found, part.column(0).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(stay) for c in part.columns[2:]], keep)

    return spread(given).mapInArrow(run, documents.select(*keep).schema)


def without_residue(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The corpus without the documents found."""
    return documents.join(found, "doc_id", "left_anti")
