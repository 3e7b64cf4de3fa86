"""Problem 3: records whose words, with their counts, agree but for small edits, insertions and reordering.

Similarity of two records is twice the number of words in common over the number of words of both (a word
counts as often as it stands in both).  The k-th standing of a word is an element of its own, which makes a bag
a set, and similarity s is Jaccard similarity s / (2 - s) of the sets.  Many universal hash minima of each set
are banded; records that agree in a band are compared by a signature of one bit a minimum, then exactly.

Records with equal bags are one class, told by a 64-bit hash; the search knows each class by its least id.  Bands
travel as a key and an id, nothing else; bags travel only for the pairs that the signature lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import connected_components
from pagemill.session import broadcast_if_small, cut_lineage, spread

THRESHOLD = 0.88
#: At the threshold's Jaccard similarity, 0.786, 40 bands of 7 minima miss a pair once in 3,600, at 0.9 once in 70,000; unrelated
#: records of the bank, at about 0.15, meet in a band once in 15,000.
BANDS, ROWS = 40, 7
#: Minima of which one bit makes the signature, and the standard deviations below the expected agreement at which a pair is given up.
BITS, SIGMAS = 64, 5
#: Ids that go along with tasks, at most; more are joined.
FEW = 500_000
#: Records whose minima are taken together, so that the arrays stay in the cache.
SLICE = 1_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(records: DataFrame) -> DataFrame:
    """(question_id, words): the sorted 64-bit hashes of the words of the question and all options, as often as they stand."""
    text = F.lower(F.concat_ws(" ", F.col("question"), F.array_join("options", " ")))
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{Nd}\p{Nl}\p{No}]+", " "), " "), lambda w: w != "")
    return spread(records.where("question_id is not null").select("question_id", "question", "options")).select(
        "question_id",
        F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("words")
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _elements(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements (word, its k-th standing) of all bags, as 64-bit hashes, and the number of each bag's."""
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    sizes = np.diff(words.offsets.to_numpy()).astype(np.int64)
    place = np.arange(len(flat))
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = True
    standing = place - np.maximum.accumulate(np.where(fresh, place, 0)) if len(flat) else place
    return _mixed(flat + standing.astype(np.uint64) * _GOLDEN), sizes


def _minima(flat: np.ndarray, sizes: np.ndarray, first: int, count: int, seed: int) -> np.ndarray:
    """The least value of each bag (none may be empty) under ``count`` multiply-shift hashes, counted from ``first``."""
    factors = np.random.default_rng((seed, first)).integers(0, 1 << 63, (2, count), dtype=np.uint64)
    out = np.empty((len(sizes), count), np.uint64)
    starts = np.append(0, np.cumsum(sizes)[:-1]).astype(np.int64)
    held = np.empty_like(flat)
    for k in range(count):
        np.multiply(flat, factors[0, k] << np.uint64(1) | np.uint64(1), out=held)
        held += factors[1, k]
        out[:, k] = np.minimum.reduceat(held, starts)
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, elements, sizes) of the records that have words, few at a time."""
    for batch in batches:
        filled = batch.filter(pa.array(np.diff(batch.column(1).offsets.to_numpy()) > 0, pa.bool_()))
        for at in range(0, filled.num_rows, SLICE):
            part = filled.slice(at, SLICE)
            words = part.column(1)
            yield part.column(0), *_elements(
                pa.ListArray.from_arrays(pa.array(words.offsets.to_numpy() - words.offsets[0].as_py(), pa.int32()), words.flatten())
            )


def classes(words: DataFrame, seed: int = 3) -> DataFrame:
    """(question_id, class, n, bits) of every record with a word: its class of equal bags, number of words and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, sizes in _slices(batches):
            starts = np.append(0, np.cumsum(sizes)[:-1]).astype(np.int64)
            own = _mixed(np.add.reduceat(_mixed(flat ^ _GOLDEN), starts) + sizes.astype(np.uint64))
            odd = (_minima(flat, sizes, 1 << 20, BITS, seed) >> np.uint64(40) & np.uint64(1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(own.view(np.int64)), pa.array(sizes), pa.array(np.packbits(odd, axis=1).view(np.int64).reshape(-1))],
                ["question_id", "class", "n", "bits"]
            )

    return words.mapInArrow(run, "question_id long, class long, n long, bits long")


def bands(words: DataFrame, count: int = BANDS, rows: int = ROWS, seed: int = 3) -> DataFrame:
    """(key, rep): a hash of each band's minima and the record; the band is part of the hash, of which 48 bits are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(seed + 1).integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        for ids, flat, sizes in _slices(batches):
            minima = _minima(flat, sizes, 0, count * rows, seed).reshape(len(sizes), count, rows)
            keys = _mixed((minima * weights).sum(axis=2, dtype=np.uint64) + np.arange(count, dtype=np.uint64) * _GOLDEN) >> np.uint64(16)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids.to_numpy(), count))], ["key", "rep"])

    return words.mapInArrow(run, "key long, rep long")


def bags(words: DataFrame) -> DataFrame:
    """(rep, bag): the elements of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, sizes in _slices(batches):
            bag = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, bag], ["rep", "bag"])

    return words.mapInArrow(run, "rep long, bag array<long>")


def _only(words: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Records with (left_semi) or without (left_anti) an id among few or many."""
    return words.join(broadcast_if_small(ids, FEW), "question_id", how)


def similar_classes(words: DataFrame, members: DataFrame, threshold: float = THRESHOLD, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, similarity), a < b: every pair of classes, by their least ids, with similarity of at least the threshold.

    ``members`` is (question_id, class, n, bits, rep).  A band that is shared by very many classes is joined within its
    key, by a merge join that adaptive execution splits; it is never broadcast.
    """
    copies = members.where("question_id <> rep").select("question_id")
    banded = bands(_only(words, copies, "left_anti"), count, rows).repartition("key")
    left, right = banded.select("key", F.col("rep").alias("a")), banded.select("key", F.col("rep").alias("b"))
    pairs = left.hint("merge").join(right, "key").where("a < b").select("a", "b").distinct()
    jaccard = threshold / (2 - threshold)
    agreeing = (1 + jaccard) / 2
    least = int(BITS * agreeing - SIGMAS * (BITS * agreeing * (1 - agreeing)) ** 0.5)
    known = members.where("question_id = rep")
    x, y = (known.select(F.col("rep").alias(s), F.col("n").alias(f"_n{s}"), F.col("bits").alias(f"_x{s}")) for s in "ab")
    size = F.least("_na", "_nb") * 2 >= F.lit(threshold) * (F.col("_na") + F.col("_nb"))
    agree = BITS - F.bit_count(F.col("_xa").bitwiseXOR(F.col("_xb")))
    near = cut_lineage(pairs.join(x, "a").join(y, "b").where(size & (agree >= least)).select("a", "b", "_na", "_nb"))
    asked = near.select(F.col("a").alias("question_id")).unionByName(near.select(F.col("b").alias("question_id"))).distinct()
    held = bags(_only(words, asked, "left_semi"))
    bag_a, bag_b = (held.select(F.col("rep").alias(s), F.col("bag").alias(f"_{s}")) for s in "ab")
    checked = near.join(bag_a, "a").join(bag_b, "b").withColumn("similarity", 2 * F.size(F.array_intersect("_a", "_b")) / (F.col("_na") + F.col("_nb")))
    return checked.where(F.col("similarity") >= threshold).select("a", "b", "similarity").distinct()


def _members(words: DataFrame) -> DataFrame:
    """Every record with a word and the least id of its class; the least is an aggregate, so many copies make no hot task."""
    own = cut_lineage(classes(words).distinct())
    return cut_lineage(own.join(own.groupBy("class").agg(F.min("question_id").alias("rep")), "class"))


def near_pairs(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(question_id_a, question_id_b), a < b: every pair of records with similarity of at least the threshold.

    Null questions and null options count as no words, and records without a word are similar to none.  Null ids
    are left out.  Records with the same words are one class while pairs are searched; here its members are paired
    too, as the contract of p3_found wants every pair (near_groups does not).
    """
    words = word_hashes(records)
    members = _members(words)
    found = similar_classes(words, members, threshold).select("a", "b")
    a, b = (members.select(F.col("rep").alias(s), F.col("question_id").alias(f"_{s}")) for s in "ab")
    across = found.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("question_id_a"), F.greatest("_a", "_b").alias("question_id_b"))
    inside = a.join(b, F.col("a") == F.col("b")).where("_a < _b").select(F.col("_a").alias("question_id_a"), F.col("_b").alias("question_id_b"))
    return across.unionByName(inside).distinct()


def near_groups(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(question_id, class_id, links, group_id): a record's class of equal word bags, the class's links to other classes, and its group.

    group_id is the least question_id of the connected component; a record similar to none is a group of its own.
    Records without a word are one class, similar to none.
    """
    words = word_hashes(records)
    members = _members(words)
    pairs = cut_lineage(similar_classes(words, members, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))
    both = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u")))
    links = both.groupBy("u").agg(F.count(F.lit(1)).alias("links"))
    groups = connected_components(pairs)
    blank = words.where(F.size("words") == 0).select("question_id").distinct()
    least = blank.agg(F.min("question_id")).first()[0]
    every = members.select("question_id", "rep").unionByName(blank.withColumn("rep", F.lit(least).cast("long")))
    joined = every.join(links, F.col("rep") == F.col("u"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    return joined.select(
        "question_id",
        F.col("rep").alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("component", "rep").alias("group_id")
    )
