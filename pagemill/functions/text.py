"""Scalar text functions of the question pipeline, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.jsstr import SPACE, collapse, js_round, js_trim, let

# fixed values
STOP_WORDS = "the and or to a of in for on with at is are was were be this that an it as by from can will if not but into about".split()
COMPRESSED_CHARS = 420
LEAST_COMPRESSED = 140
KEPT_SENTENCES = 4
FOCUS_POINTS, FOCUS_LENGTH = 8, 3


def normalize_extracted(text: Column) -> Column:
    """Joins words hyphenated over line ends, collapses white space, drops NUL, trims."""
    joined = F.regexp_replace(text, f"-{SPACE}*\n{SPACE}*", "")
    return js_trim(F.replace(F.regexp_replace(joined, f"{SPACE}+", " "), F.lit("\x00"), F.lit("")))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 of two letters or more, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 1)


def content_tokens(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def _long(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.length(w) >= 7))


def _numeric(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike("[0-9]")))


def sentences(text: Column) -> Column:
    """Trimmed sentences, split at white space after a stop; the trimmed text if there is none."""
    parts = F.filter(F.transform(F.split(text, rf"(?<=[.!?]){SPACE}+"), js_trim), lambda s: s != "")
    return let(parts, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(js_trim(text))))


def chunk_sentences(text: Column) -> Column:
    """Sentences for chunking: split only where a capital or a digit follows."""
    parts = F.filter(F.transform(F.split(text, rf"(?<=[.!?]){SPACE}+(?=[A-Z0-9])"), js_trim), lambda s: s != "")
    return let(parts, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(text)))


def sentence_score(sentence: Column) -> Column:
    def of(words: Column) -> Column:
        signals = F.when(F.size(words) > 0, F.regexp_count(sentence, F.lit("[A-Z]{2,}"))).otherwise(0)
        return let(content_tokens(words), lambda kept: F.size(kept) + _long(kept) * F.lit(1.6) + _numeric(kept) * F.lit(1.3) + signals * F.lit(1.8))

    return let(tokens(sentence), of)


def information_score(text: Column, words: Column) -> Column:
    """``words`` are the text's tokens, held in a column of their own."""
    n = F.size(words)
    headings = F.regexp_count(text, F.lit("(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]+:"))
    made = n * F.lit(0.6) + (
        F.size(F.array_distinct(words)) / n
    ) * F.lit(40.0) + _long(words) * F.lit(1.1) + _numeric(words) * F.lit(1.4) + headings * F.lit(2.0)
    return F.when(n > 0, made).otherwise(F.lit(0.0))


def fingerprint(content: Column) -> Column:
    """Count, first 18, middle 12 and last 12 of the tokens without stop words; empty if there are none."""

    def of(words: Column) -> Column:
        n = F.size(words)
        middle = F.greatest(F.lit(1), F.floor(n / 2).cast("int") - 5)
        head, mid, tail = F.slice(words, 1, 18), F.slice(words, middle, F.lit(12)), F.slice(words, F.greatest(n - 11, F.lit(1)), F.lit(12))
        made = F.concat(n.cast("string"), F.lit(":"), F.array_join(head, "|"), F.lit("::"), F.array_join(mid, "|"), F.lit("::"), F.array_join(tail, "|"))
        return F.when(n > 0, made).otherwise(F.lit(""))

    return let(content, of)


def compress(text: Column, most: int = COMPRESSED_CHARS) -> Column:
    """The highest scored sentences in order of the text that fit together, else the beginning with dots."""

    def add(out: Column, x: Column) -> Column:
        longer = F.when(out == "", x["s"]).otherwise(F.concat(out, F.lit(" "), x["s"]))
        return F.when(F.length(longer) > most, out).otherwise(longer)

    def shorten(flat: Column) -> Column:
        scored = F.transform(sentences(flat), lambda s, i: F.struct((-sentence_score(s)).alias("low"), i.alias("i"), s.alias("s")))
        kept = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, KEPT_SENTENCES), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
        cut = F.concat(js_trim(F.substring(flat, 1, most - 3)), F.lit("..."))
        return let(F.aggregate(kept, F.lit(""), add), lambda picked: F.when(F.length(picked) >= min(LEAST_COMPRESSED, most), js_trim(picked)).otherwise(cut))

    return let(collapse(text), lambda flat: F.when(F.length(flat) <= most, flat).otherwise(shorten(flat)))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def focus_terms(focus: str | None) -> list[str]:
    """Terms of a topic focus; one that is named twice stays twice."""
    lowered = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (focus or "").lower())
    return [t for t in lowered.split() if len(t) >= FOCUS_LENGTH]


def topic_score(text: Column, focus: str | None) -> Column:
    """Eight points for each term that the lower-case text contains anywhere."""
    lowered, points = F.lower(text), F.lit(0)
    for term in focus_terms(focus):
        points = points + F.when(F.contains(lowered, F.lit(term)), FOCUS_POINTS).otherwise(0)
    return points


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def stem_key(question: Column) -> Column:
    """What makes two questions the same; letters other than a-z count as blanks."""
    return js_trim(F.regexp_replace(F.lower(question), "[^a-z0-9]+", " "))


def csv_cell(value: Column) -> Column:
    flat = js_trim(F.regexp_replace(value, "\r?\n", " "))
    return F.when(flat.rlike('[",]'), F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(flat)


def html_escape(value: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(sign), F.lit(entity))
    return value


def script_safe(json: Column) -> Column:
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        json = F.replace(json, F.lit(sign), F.lit(code))
    return json


def fnv1a(value: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, in base 36."""
    step = lambda h, unit: (h.bitwiseXOR(unit) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))

    def both(h: Column, code: Column) -> Column:
        over = code - 65536
        pair = step(step(h, F.shiftright(over, 10) + 55296), over.bitwiseAND(F.lit(1023).cast("long")) + 56320)
        return F.when(code < 65536, step(h, code)).otherwise(pair)

    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.lower(F.conv(F.aggregate(codes, F.lit(2166136261).cast("long"), both).cast("string"), 10, 36))


def format_bytes(n: Column) -> Column:
    kb, mb = F.format_string("%.1f KB", n / 1024), F.format_string("%.1f MB", n / 1048576)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, kb).otherwise(mb)


def option_labels(count: Column) -> Column:
    clamped = F.greatest(F.lit(1), F.least(F.lit(26), js_round(count))).cast("int")
    return F.transform(F.sequence(F.lit(0), clamped - 1), lambda i: F.char(i + 65))


def option_range(count: Column) -> Column:
    labels = option_labels(count)
    return F.when(F.size(labels) == 1, labels[0]).otherwise(F.concat(labels[0], F.lit("-"), F.element_at(labels, -1)))


def choice_text(counts: Column) -> Column:
    """Describes the sorted distinct option counts of a bank."""
    first, last = counts[0].cast("string"), F.element_at(counts, -1).cast("string")
    one = F.concat(first, F.when(counts[0] == 1, " answer choice each").otherwise(" answer choices each"))
    return F.when(F.size(counts) == 0, "No answer choices").when(F.size(counts) == 1, one).otherwise(
        F.concat(first, F.lit("-"), last, F.lit(" answer choices"))
    )


def miss_preview(count: Column) -> Column:
    """Up to six marks, then how many more."""
    marks = F.array_join(F.array_repeat(F.lit("X"), F.least(count, F.lit(6)).cast("int")), " ")
    return F.when(count > 6, F.concat(marks, F.lit(" +"), (count - 6).cast("string"))).otherwise(marks)
