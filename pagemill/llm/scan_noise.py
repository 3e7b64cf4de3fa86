"""Problem 1: noise that scanning leaves in pages and in the chunks cut from them, and the repaired text.

Words are counted over all pages, apart for files that were scanned and files that were not.  A word of a scanned
text that no other file has is looked up by an automaton in the trie of the vocabulary; a far more frequent word
within the confusions of recognition, or else within edits of any letter, makes it a misreading.  Suspects and words
meet by pieces that two errors must leave whole, so no task holds the vocabulary.  Line ends are judged by whether the
joined word is one, furniture by its place and form and by the titles of the file.  Only suspects are shuffled, never texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.spelling import DIGITS, LETTERS, Trie, skeleton, token_pieces, word_pieces
from pagemill.session import broadcast_if_small, cut_lineage, spread

#: The most frequent words known from unscanned files go along with the tasks, so that they need no join; all others are joined.
COMMON = 50_000
#: For a suspect of letters only, a candidate must stand at least so many times as often, by its number of errors.
RATIO = {1: 5, 2: 20}
#: The same if the errors are edits of any letter, of which inflected forms and names are often one or two away.
EDIT_RATIO = {1: 20, 2: 100}
#: From so many letters on, that many edits of any letter still tell one word; below, unrelated words are as near.
EDIT_LENGTH = {1: 4, 2: 8}
#: Suspects looked up, and words in the trie, in one task, at most.
BLOCK, SHARD = 2_000, 20_000
#: Bits, as a power of two, of the map of words whose neighbours are counted; two words with one bit cost counts, no rows.
MAP_BITS = 25

_INSIDE = "*^~¬†§¢@|!$€£©®¥µ\u00ad"
_RUN = re.compile(
    rf"[^\W_{re.escape(_INSIDE)}]+(?:[{re.escape(_INSIDE)}]+[^\W_]+)*[†§¢@|]*|[†§¢@|!][^\W_]+(?:[{re.escape(_INSIDE)}]+[^\W_]+)*[†§¢@|]*|[†§¢@|]+(?=[^\W_])"
)
_PLAIN = re.compile(r"[^\W_]+")
#: A line without these is nothing but plain words.
_MARKED = re.compile(rf"[{re.escape(_INSIDE)}]|[-\u2010\u2011]$")
_BREAK = re.compile(r"([^\W\d_](?:[^\W_]|[*^~†§¢@|!](?=[^\W_]))*)([-\u2010\u2011\u00ad¬])$")
_REST = re.compile(r"[^\W_](?:[^\W_]|[*^~¬†§¢@|!](?=[^\W_])|[†§¢@|])*|[†§¢@|!](?:[^\W_]|[*^~¬†§¢@|](?=[^\W_]))+")
_COMPOUND = re.compile(r"([^\W\d_]+)[-\u2010\u2011](?=[^\W\d_])")
_LABEL = re.compile(r"[^\W\d_]+\d+$|\d+[^\W\d_]+$")
_ROMAN = re.compile(r"[ivxlc1|!]+$", re.I)
_NUMBER = r"[0-9lIO|oSZBgq!s§b]{1,5}"
_FORMS = re.compile(
    rf"^(?:[-–—~*•·=|<(\[]+ ?)?(?:(?:p|pg|pag|page|seite|página|pagina|s)[.:]? ?)?({_NUMBER}|[ivxlc1|!]+)(?: ?(?:/|of|von|de|sur) ?{_NUMBER})?\.?(?: ?[-–—~*•·=|>)\]]+)?$",
    re.I
)
_BARE = re.compile(r"^[0-9]+\.?$")
_TABLE = re.compile(r"^(?:table|figure|tabelle|tabla|tableau|tabela)\s+\S+$|^\S+(?:  +\S+)+$|^[0-9]+(?:[.,][0-9]+)?%?$", re.I)
_OPENING = re.compile(
    r"^\W*(?:chapter|unit|part|lesson|section|module|kapitel|capítulo|chapitre|teil|lektion|unidad|unidade)\s+[\w|!]+\s*[:.\-–—]\s*(\S.*)$",
    re.I
)
_HEAD_NUMBER = re.compile(rf"^(?:(?:page |p\. ?)?{_NUMBER}\s*[|·•\-–—:/]?\s+)?(.*?)(?:\s*[|·•\-–—:/]?\s+(?:page |p\. ?)?(?:{_NUMBER}|[ivxlc]+)\W*)?$")


def title_key(text: str) -> str:
    return skeleton(text)


def file_key(name: str | None) -> str:
    """A file's title as its name has it: without extension, trailing number and separators."""
    return title_key(re.sub(r"(_\d+)?(\.\w{2,4})?$", "", (name or "").strip()))


def _words_of(lines: list[str]) -> Iterator[tuple[int, list[str], str | None]]:
    """(line, words, first and second piece if the one word is joined over the line's end), in lower case.

    A joined word belongs to the line it begins on.
    """
    taken = 0
    for i, line in enumerate(lines):
        bare = line.strip()
        if not taken and not _MARKED.search(bare):
            if bare:
                yield i, _PLAIN.findall(bare.lower()), None
            continue
        start, taken = taken, 0
        body = bare[start:]
        cut = _BREAK.search(bare)
        follow = _REST.match(lines[i + 1].strip()) if cut and i + 1 < len(lines) else None
        if cut and not follow:
            cut = None
        if cut:
            body = bare[start : cut.start(1)] if cut.start(1) >= start else ""
        yield i, [word for run in _RUN.findall(body) if (word := run.strip("*^~¬\u00ad").rstrip("!").lower())], None
        if cut:
            taken = follow.end()
            yield i, [cut[1].lower() + follow[0].lower()], cut[1].lower() + "\x00" + follow[0].lower()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, clean, scanned) of a batch; ``x-`` counts x as the first part of a compound."""
    for batch in batches:
        counts = {True: Counter(), False: Counter()}
        for text, scanned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts[bool(scanned)]
            for _, words, joined in _words_of(text.split("\n")):
                if not joined:
                    own.update(words)
            if not scanned:
                own.update(f"{x}-".lower() for x in _COMPOUND.findall(text))
        words = [*{**counts[True], **counts[False]}]
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([counts[False][w] for w in words], pa.int64()), pa.array([counts[True][w] for w in words], pa.int64())],
            ["word", "clean", "scanned"]
        )


def is_number_line(lines: list[str], i: int) -> bool:
    """Whether the i-th of the non-blank lines stands where page numbers do and is nothing but one."""
    line = lines[i].strip()
    found = _FORMS.match(line) if len(line) < 24 else None
    if not found:
        return False
    core = found[1]
    if not any(c.isdigit() for c in core) and not (_ROMAN.match(core) or core.lower() in ("l", "o")):
        return False
    place = i == 0 or i == len(lines) - 1 or i == 1 and (
        not _TABLE.match(lines[0].strip()) or is_number_line(lines[:1], 0)
    ) and not lines[0].rstrip().endswith(".")
    if not place or i and re.search(r"[^\W_][-\u2010\u2011\u00ad¬]$", lines[i - 1].strip()):  # the rest of a word or range
        return False
    if _BARE.match(line):
        beside = lines[i - 1] if i == len(lines) - 1 and i > 1 else lines[i + 1] if i + 1 < len(lines) else ""
        return not _TABLE.match(beside.strip()) or len(lines) == 1
    return True


def _scan(common: frozenset[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of each record: (record_table, record_id, file_index, line_no, kind, word, extra).

    ``common`` only spares known words a join: a line's end whose joined word is not in it stays open, as ``join``,
    or ``tied`` after a digit.
    """
    for batch in batches:
        out: list[tuple] = []
        for table, key, file_index, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = text.split("\n")
            filled = [i for i, x in enumerate(lines) if x.strip()]
            dense = [lines[i] for i in filled]
            numbers = {filled[k] for k in dict.fromkeys((0, 1, len(dense) - 1)) if 0 <= k < len(dense) and is_number_line(dense, k)}
            put = lambda line, kind, word, extra=None: out.append((table, key, file_index, line, kind, word, extra))  # noqa: B023, E731
            for i in numbers:
                put(i, "sure", "page_number")
            tops = [i for i in filled if i not in numbers][:2]
            for i in tops:
                bare = lines[i].strip()
                if len(bare.split()) <= 14 and not bare.endswith((".", ",", ";")) and not _OPENING.match(bare) and (
                    i == tops[0] or i == filled[0] or filled[0] in numbers
                ):
                    head = _HEAD_NUMBER.match(bare)
                    put(i, "head", title_key(head[1] if head and head[1] else bare), "n" if head and head[1] != bare else None)
            if table == "pdf_pages":
                for i in filled:
                    if len(lines[i]) < 140 and (opening := _OPENING.match(lines[i])):
                        put(i, "title", title_key(opening[1]))
            runs = [*_words_of(lines)]
            flat = [w for _, words, _ in runs for w in words]
            n = 0
            for i, words, joined in runs:
                at, n = n, n + len(words)
                if i in numbers:
                    continue
                if joined:
                    first = joined.partition("\x00")[0]
                    if words[0] in common:
                        put(i, "sure", "hyphen_break")
                    else:
                        put(i, "tied" if first[-1:].isdigit() else "join", words[0], first)
                elif not common.issuperset(words):
                    seen = set()
                    for k, word in enumerate(words, at):
                        if word not in common and word not in seen and not word.isdigit():
                            seen.add(word)
                            put(i, "word", word, f"{flat[k - 1] if k else ''} {flat[k + 1] if k + 1 < len(flat) else ''}")
        columns = [*zip(*out, strict=True)] if out else [()] * 7
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ITEMS)


ITEMS = ["record_table", "record_id", "file_index", "line_no", "kind", "word", "extra"]
ITEM_TYPES = "record_table string, record_id long, file_index int, line_no int, kind string, word string, extra string"


def confused(token: str, own: int, trie: Trie, counts: dict[str, int]) -> list[tuple[str, int]]:
    """(word, errors): the words within the confusions of recognition of a suspect that stands ``own`` times."""
    letters = token.isalpha()
    return [(fix, n) for fix, n in trie.search(token).items() if n and (not letters or counts[fix] >= RATIO[n] * own)]


def edited(token: str, own: int, trie: Trie, counts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, errors, place): the words within edits of any letter; those with the least place count.

    They are asked for only where no word is within the confusions.  A word with a plain number before or after it has none.
    """
    letters = token.isalpha()
    found = [(fix, n, 0) for fix, n in trie.search(token, 1, plain=True).items() if n] if not letters and len(token) > 5 else []
    if not letters and (_LABEL.match(token) or sum(map(str.isalpha, token)) < EDIT_LENGTH[1]):
        return found
    near = trie.search(token, max((n for n, least in EDIT_LENGTH.items() if len(token) >= least), default=0), plain=True)
    return found + [(fix, n, 1) for fix, n in near.items() if n and counts[fix] >= EDIT_RATIO[n] * own]


def _look_up(plain: bool):
    """Candidates of each suspect of a shard among its words."""

    def run(_: tuple, suspects: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(words["word"], words["n"], strict=True))
        trie = Trie(counts)
        rows = []
        for token, own in zip(suspects["word"], suspects["n"], strict=True):
            made = edited(token, own, trie, counts) if plain else [(fix, n, 0) for fix, n in confused(token, own, trie, counts)]
            rows.extend((token, fix, n, counts[fix], place) for fix, n, place in made)
        return pd.DataFrame(rows, columns=["word", "fix", "errors", "times", "place"]).astype(
            {"word": object, "fix": object, "errors": "int32", "times": "int64", "place": "int32"}
        )

    return run


def _shards(rows: DataFrame, pieces, shards: int) -> DataFrame:
    """(word, n, shard): each word in the shards of all its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ns, at = [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for shard in {zlib.crc32(key.encode("utf-8", "replace")) % shards for key in pieces(word)} if shards > 1 else (0,):
                    words.append(word)
                    ns.append(n)
                    at.append(shard)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(at, pa.int32())], ["word", "n", "shard"])

    return rows.select("word", "n").mapInArrow(run, "word string, n long, shard int")


def look_up(suspects: DataFrame, words: DataFrame, plain: bool = False) -> DataFrame:
    """(word, fix, errors, times, place), distinct: candidates of suspects (word, n) among words (word, n).

    Both are sent to the shards of their pieces.  A shard that a common piece fills is cut into parts of its words and
    of its suspects that meet part by part, so that no task has more than SHARD words and BLOCK suspects, or about.
    """
    shards = max(1, -(-8 * words.count() // SHARD)) if words.count() > SHARD else 1
    asked, known = _shards(suspects, token_pieces, shards), _shards(words, word_pieces, shards)
    per = lambda rows, most, name: rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    parts = cut_lineage(per(asked, BLOCK, "_blocks").join(per(known, SHARD, "_parts"), "shard"))
    parts = broadcast_if_small(parts, 100_000)
    own = lambda n: F.pmod(F.hash("word"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(parts, "shard").withColumn("_block", own("_blocks")).withColumn("_part", every("_parts"))
    right = known.join(parts, "shard").withColumn("_part", own("_parts")).withColumn("_block", every("_blocks"))
    keys = ["shard", "_block", "_part"]
    met = left.select("word", "n", *keys).groupBy(*keys).cogroup(right.select("word", "n", *keys).groupBy(*keys))
    return met.applyInPandas(_look_up(plain), "word string, fix string, errors int, times long, place int").distinct()


def word_map(words: DataFrame) -> np.ndarray:
    """A map of 2 ** MAP_BITS bits (4 MB, whatever the number of words) with the bit of each word set."""
    bits = words.select(F.shiftright(F.crc32("word"), 32 - MAP_BITS).alias("_bit"))
    cells = bits.groupBy(F.expr("shiftright(_bit, 5)").alias("_cell")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit & 31 as int)))").alias("_bits"))
    out = np.zeros(1 << MAP_BITS - 5, np.uint32)
    for cell, bits in cells.toPandas().itertuples(index=False):
        out[cell] = bits
    return out


class _Mapped(dict):
    """Whether a word's bit is set in the map, kept for words met before."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __missing__(self, word: str) -> bool:
        if len(self) > 400_000:
            self.clear()
        bit = zlib.crc32(word.encode("utf-8", "replace")) >> 32 - MAP_BITS
        found = self[word] = bool(self.bits[bit >> 5] >> (bit & 31) & 1)
        return found


def scanned_files(pages: DataFrame) -> DataFrame:
    """(file_index, scanned) of each file: whether a page of it is marked as from recognition."""
    return pages.groupBy("file_index").agg(F.max(F.coalesce("from_ocr", F.lit(False))).alias("scanned"))


def _name(column: str) -> F.Column:
    return F.regexp_replace(F.lower(F.trim(F.col(column))), "[^\\p{L}\\p{N}]+", " ")


class Noise:
    """What is found out about pages and chunks; each part is written to the checkpoint folder once."""

    def __init__(self, pages: DataFrame, chunks: DataFrame) -> None:
        self.spark: SparkSession = pages.sparkSession
        files = cut_lineage(scanned_files(pages))
        known = pages.where("file_name is not null and file_index is not null").select("file_index", "file_name").distinct()
        scanned = files.where("scanned").select("file_index")
        marked = spread(pages.where("text is not null").select("page_id", "file_index", "text")).join(broadcast_if_small(files, 100_000), "file_index", "left")
        self.clean_texts = marked.where("not coalesce(scanned, false)").select("text")
        counted = marked.select("text", F.coalesce("scanned", F.lit(False)).alias("scanned")).mapInArrow(_count, "word string, clean long, scanned long")
        self.words = cut_lineage(counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned")))
        top = self.words.where("clean > 0").orderBy(F.desc("clean"), "word").limit(COMMON).select("word")
        shared = self.spark.sparkContext.broadcast(frozenset(r["word"] for r in top.collect()))
        names = known.join(
            broadcast_if_small(scanned, 100_000),
            "file_index",
            "left_semi"
        ).select("file_index", _name("file_name").alias("_name")).groupBy("_name").agg(F.min("file_index").alias("file_index"))
        of_chunks = spread(
            chunks.where("raw_text is not null and source_order is not null").select("source_order", "file_name", "raw_text")
        ).withColumn("_name", _name("file_name")).join(broadcast_if_small(names, 100_000), "_name")
        of_pages = marked.where("scanned and page_id is not null")
        self.texts = of_pages.select(F.lit("pdf_pages").alias("record_table"), F.col("page_id").alias("record_id"), "file_index", "text").unionByName(
            of_chunks.select(F.lit("chunks").alias("record_table"), F.col("source_order").alias("record_id"), "file_index", F.col("raw_text").alias("text"))
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _scan(shared.value, batches)

        self.items = cut_lineage(self._settled(cut_lineage(self.texts.mapInArrow(scan, ITEM_TYPES))))
        self.fixes = cut_lineage(self._fixes())
        self.titles = self._titles(known)

    def _settled(self, items: DataFrame) -> DataFrame:
        """The items with each open line end judged by the whole vocabulary.

        It breaks a word if the joined word is known.  Else it is a compound's own hyphen if its first piece stands
        as such, if both pieces are words or if the first ends in a digit; the pieces are then words of their lines.
        What is neither stays a ``join``.
        """
        ends = items.where("kind in ('join', 'tied')")
        rest = F.expr("substring(word, length(extra) + 1)")
        forms = F.array("word", F.concat("extra", F.lit("-")), F.col("extra"), rest)
        asked = ends.select("word", "extra").distinct().select(
            F.col("word").alias("_word"),
            F.col("extra").alias("_first"),
            F.posexplode(forms).alias("_form", "word")
        )
        known = asked.join(self.words.where("clean > 0").select("word"), "word").groupBy("_word", "_first").agg(
            *(F.max(F.col("_form") == k).alias(f"_{name}") for k, name in enumerate(("whole", "own", "left", "right")))
        )
        judged = ends.join(known.withColumnsRenamed({"_word": "word", "_first": "extra"}), ["word", "extra"], "left")
        judged = judged.fillna(False, ["_whole", "_own", "_left", "_right"]).withColumn(
            "_compound",
            F.expr("not _whole and (kind = 'tied' or _own or _left and _right)")
        )
        broken = judged.where("not _compound").withColumn("kind", F.when(F.col("_whole"), "sure").otherwise("join")).withColumn(
            "word",
            F.when(F.col("_whole"), "hyphen_break").otherwise(F.col("word"))
        )
        pieces = F.array(
            F.struct(F.col("line_no").alias("line"), F.col("extra").alias("piece")),
            F.struct((F.col("line_no") + 1).alias("line"), rest.alias("piece"))
        )
        apart = judged.where("_compound").withColumn("_p", F.explode(pieces)).where("not _p.piece rlike '^[0-9]*$'")
        apart = apart.select(
            "record_table",
            "record_id",
            "file_index",
            F.col("_p.line").alias("line_no"),
            F.lit("word").alias("kind"),
            F.col("_p.piece").alias("word"),
            F.lit(None).cast("string").alias("extra")
        )
        return items.where("kind not in ('join', 'tied')").unionByName(broken.select(ITEMS)).unionByName(apart)

    def _fixes(self) -> DataFrame:
        """(word, fix, errors, times): candidates of every suspect that is a misreading.

        A number in disguise gets its digits, which reflow reads again from the shapes in the text; a name with signs gets
        the letters these stand for, null if a digit is left that stands for none.
        """
        suspects = self.items.where("kind in ('word', 'join')").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        suspects = cut_lineage(suspects.join(self.words.where("clean > 0").select("word"), "word", "left_anti"))
        letters = cut_lineage(
            self.words.where("(clean > 0 or scanned >= 5) and word rlike '^\\\\p{L}{2,}$'").select("word", (F.col("clean") + F.col("scanned")).alias("n"))
        )
        first = cut_lineage(look_up(suspects, letters).select("word", "fix", "errors", "times"))
        rest = suspects.join(first.select("word").distinct(), "word", "left_anti").join(letters.select("word"), "word", "left_anti")
        then = look_up(cut_lineage(rest), letters, plain=True)
        least = then.groupBy("word").agg(F.min("place").alias("place"))
        found = first.unionByName(then.join(least, ["word", "place"]).select("word", "fix", "errors", "times"))
        digits = F.translate(F.regexp_replace("word", "[*^~¬]", ""), "li|!os§bgqzat†e", "111105569924773")
        number = F.col("word").rlike("[0-9]") & digits.rlike("^[0-9]{2,}$") & ~F.col("word").rlike("^[0-9]+$")
        letters_of = F.length(F.regexp_replace("word", "[^\\p{L}]", ""))
        mixed = (letters_of >= 4) & F.col("word").rlike("\\p{L}[0-9]{1,2}\\p{L}|^[0-9]\\p{Ll}{3}|\\p{L}{4}[0-9]$") & ~F.col("word").rlike("[0-9]{3}")
        signs = mixed | F.col("word").rlike("[\\p{L}][*^~¬†§¢@|!€£]|[*^~¬†§¢@|!€£][\\p{L}]") & F.col("word").rlike("\\p{L}{2}")
        odd = suspects.where(number | signs).join(found.select("word").distinct(), "word", "left_anti")
        spelt = F.translate(F.regexp_replace("word", "[*^~¬]", ""), "".join(LETTERS), "".join(LETTERS.values()))
        fix = F.when(number, digits).when(spelt.rlike("^\\p{L}+$"), spelt)
        read = odd.select("word", fix.alias("fix"), F.lit(1).alias("errors"), F.lit(0).cast("long").alias("times"))
        return found.unionByName(read)

    def _titles(self, known: DataFrame) -> DataFrame:
        """(file_index, word): keys of the titles of works and chapters, and of lines that head several pages."""

        @F.pandas_udf("string")
        def key(names: pd.Series) -> pd.Series:
            return names.map(file_key)

        names = known.select("file_index", key("file_name").alias("word"))
        openings = self.items.where("kind = 'title'").select("file_index", "word")
        heads = self.items.where(
            "kind = 'head' and record_table = 'pdf_pages'"
        ).groupBy("file_index", "word").agg(F.countDistinct("record_id").alias("n")).where("n >= 3")
        return names.unionByName(openings).unionByName(heads.select("file_index", "word")).where("length(word) > 3").distinct()

    def found(self) -> DataFrame:
        items, record = self.items, ["record_table", "record_id", "line_no"]
        sure = items.where("kind = 'sure'").select(*record, F.col("word").alias("noise"))
        heads = items.where("kind = 'head'").join(self.titles, ["file_index", "word"]).select(*record, F.lit("running_head").alias("noise"))
        best = self.fixes.groupBy("word").agg(F.min(F.struct("errors", -F.col("times"), "fix")).alias("_best")).select("word", F.col("_best.fix").alias("fix"))
        misread = items.where("kind = 'word'").join(best.select("word"), "word").select(*record, F.lit("misread").alias("noise"))
        joins = items.where("kind = 'join'").join(best, "word", "left")
        broken = joins.select(*record, F.lit("hyphen_break").alias("noise"))
        spoilt = joins.where("fix is not null")
        own_first = F.col("fix").startswith(F.col("extra"))
        own_rest = F.expr("endswith(fix, substring(word, length(extra) + 1))")
        at_first = spoilt.where(~own_first | own_rest & ~own_first).select(*record, F.lit("misread").alias("noise"))
        at_rest = spoilt.where(~own_rest).select("record_table", "record_id", (F.col("line_no") + 1).alias("line_no"), F.lit("misread").alias("noise"))
        parts = (sure, heads, misread, broken, at_first, at_rest)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.distinct()


    def chosen(self) -> DataFrame:
        """(record_table, record_id, word, fix): the fix of each misread word of a record, ranked by context.

        Of the candidates with the fewest errors the one that stands most often beside the word's neighbours in
        unscanned text wins, then the most frequent.  Only pairs of neighbours that some choice needs are kept.
        """
        record = ["record_table", "record_id", "word"]
        least = self.fixes.where("fix is not null").withColumn(
            "_least",
            F.min("errors").over(Window.partitionBy("word"))
        ).where("errors = _least").select("word", "fix", "times")
        options = self.items.where("kind in ('word', 'join')").select(*record, "kind", "extra").join(least, "word")
        beside = F.split(F.when(F.col("kind") == "word", F.col("extra")).otherwise(" "), " ")
        options = cut_lineage(options.select(*record, "fix", "times", beside[0].alias("_before"), beside[1].alias("_after")))
        several = least.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word")
        wanted = least.join(several, "word").select("fix").distinct()
        shared = self.spark.sparkContext.broadcast(word_map(wanted.withColumnRenamed("fix", "word")))

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = _Mapped(shared.value)
            for batch in batches:
                counts = Counter()
                for text in batch.column(0).to_pylist():
                    words = [w for _, own, _ in _words_of(text.split("\n")) for w in own]
                    for k, word in enumerate(words):
                        if near[word]:
                            if k:
                                counts[words[k - 1], word] += 1
                            if k + 1 < len(words) and not near[words[k + 1]]:
                                counts[word, words[k + 1]] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in counts], pa.string()), pa.array([b for _, b in counts], pa.string()), pa.array([*counts.values()], pa.int64())],
                    ["a", "b", "n"]
                )

        seen = self.clean_texts.mapInArrow(pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        left = options.join(seen.select(F.col("a").alias("_before"), F.col("b").alias("fix"), F.col("n").alias("_l")), ["_before", "fix"], "left")
        both = left.join(seen.select(F.col("a").alias("fix"), F.col("b").alias("_after"), F.col("n").alias("_r")), ["fix", "_after"], "left")
        fits = F.coalesce("_l", F.lit(0)) + F.coalesce("_r", F.lit(0))
        scored = both.groupBy(*record, "fix").agg(F.sum(fits).alias("_fits"), F.max("times").alias("_times"))
        return scored.groupBy(*record).agg(F.max(F.struct("_fits", "_times", "fix"))["fix"].alias("fix"))

    def repaired(self) -> DataFrame:
        """(record_table, record_id, text): the texts of scanned files without furniture, repaired and reflowed."""
        record = ["record_table", "record_id"]
        lines = self.found().where("noise <> 'misread'").groupBy(*record).agg(F.collect_list(F.struct("line_no", "noise")).alias("_lines"))
        fixes = self.chosen().groupBy(*record).agg(F.collect_list(F.struct("word", "fix")).alias("_fixes"))
        joined = self.texts.dropDuplicates(record).join(lines, record, "left").join(fixes, record, "left").select(*record, "text", "_lines", "_fixes")
        return joined.mapInArrow(_rebuild, "record_table string, record_id long, text string")


def reflow(text: str, notes: dict[int, set[str]], fixes: dict[str, str]) -> str:
    """Paragraphs of one line each, blank lines between; rows of tables and headings keep lines of their own."""

    def mended(word: str) -> str:
        fix = fixes.get(word.strip("*^~¬\u00ad").rstrip("!").lower())
        if not fix:
            return word
        tail = "!" if word.endswith("!") else ""
        if fix.isdigit():
            return word.rstrip("!").translate(DIGITS) + tail
        shown = fix.upper() if len(word) > 1 and word.upper() == word and any(c.isalpha() for c in word) and not any(c.islower() for c in word) else fix.capitalize() if word[:1].isupper() else fix
        return shown + tail

    def mend(line: str) -> str:
        low = line.lower()
        return _RUN.sub(lambda m: mended(m[0]), line) if any(w in low for w in fixes) else line

    lines = text.split("\n")
    blocks: list[str] = []
    held, fresh = "", True
    for i, line in enumerate(lines):
        noise = notes.get(i, ())
        if "page_number" in noise or "running_head" in noise:
            continue
        bare = line.strip()
        if not bare:
            fresh = True
            continue
        broken = "hyphen_break" in noise
        if broken:
            bare = _BREAK.sub(r"\1", bare)
        if held:
            bare, held = held + bare, ""
        if broken:
            bare, _, held = bare.rpartition(" ")
            if not bare:
                continue
        bare = mend(bare)
        alone = not broken and bool(_TABLE.match(line.strip()) or _OPENING.match(line.strip()))
        if blocks and not fresh and not alone:
            own_hyphen = re.search(r"[^\W_]-$", blocks[-1])  # of a compound or a range
            blocks[-1] += ("" if own_hyphen else " ") + bare
        else:
            blocks.append(bare)
        fresh = alone
    if held:
        last = mend(held)
        blocks.append(last) if fresh or not blocks else blocks.__setitem__(-1, f"{blocks[-1]} {last}")
    return "\n\n".join(blocks)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, lines, fixes in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            notes: dict[int, set[str]] = {}
            for x in lines or ():
                notes.setdefault(x["line_no"], set()).add(x["noise"])
            texts.append(reflow(text, notes, {x["word"]: x["fix"] for x in fixes or ()}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["record_table", "record_id", "text"])


def scan_noise(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_table, record_id, line_no, noise), distinct: the noisy lines of scanned files' pages and chunks.

    A null text has no lines; rows with a null id are left out, chunks of a file whose name no page has belong to no
    scanned file.  A file without a page marked as recognised has no noise.  Repeated rows give one row a line and kind.
    """
    return Noise(pages, chunks).found()


def repaired_texts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_table, record_id, text): scanned files' pages and chunks as continuous paragraphs; other files have no noise to repair."""
    return Noise(pages, chunks).repaired()
