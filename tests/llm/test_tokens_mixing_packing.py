import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import mixing, packing
from pagemill.llm.bpe import BytePairEncoder
from pagemill.llm.ranks import cells, rank_in_cell, with_salt
from pagemill.llm.tokens import VOCABULARY, encode_corpus


@pytest.fixture(scope="module")
def encoder():
    return BytePairEncoder(Path(VOCABULARY).read_bytes())


def test_ids_as_the_public_library_gives_them(encoder):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    rng = random.Random(6)
    letters = "ab  \n\t'sdmtlvre01.,-é世界😀 \u0085\x1c\x1f​　ТЖ<|endoftext|>AB"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [
        "".join(rng.choice("etaoinshrdlu ") for _ in range(rng.randint(1, 80))) for _ in range(3000)
    ] + ["a" * 5000, "世" * 3000, " " * 400, "<|endoftext|>"]
    assert encoder.encode(texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.count(texts) == [len(x) for x in encoder.encode(texts)]


def test_greedy_alone_is_not_enough_and_the_check_finds_it(encoder):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(12)) for _ in range(3000)]
    wrong = [w for w in words if encoder._greedy(w) != encoder.exact(w)]
    assert wrong
    for w in words[:500]:
        ids = np.array(encoder._greedy(w))
        assert encoder._stays_apart(ids[:-1], ids[1:]).all() == (ids.tolist() == encoder.exact(w))


def test_every_token_encodes_itself(encoder):
    assert all(encoder.exact(token) == [i] for token, i in encoder._number.items())


def test_encode_corpus_edges(spark):
    rows = [(1, "Hello world", 5), (1, "Hello world", 5), (2, "", 5), (3, None, 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in encode_corpus(df).collect()), key=str)
    assert got == [(0, [87]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert encode_corpus(df.limit(0)).count() == 0


def brute(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + k * n for s in sums for k in range(c + 1)}
    return min(abs(s - budget) for s in sums)


def test_nearest_subset_as_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 5))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.randint(1, int((lengths * counts).sum()))
        taken = mixing.nearest_subset(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        assert abs(int((taken * lengths).sum()) - budget) == brute(lengths, counts, budget)


def test_fit_budget_uses_whole_passes_and_no_more_than_allowed():
    rng = random.Random(9)
    lengths = np.arange(5, 400)
    counts = np.array([rng.randint(1, 6) for _ in lengths])
    total = int((lengths * counts).sum())
    passes, extra = mixing.fit_budget(lengths, counts, 2 * total + 12345, 4)
    assert passes == 2 and int((lengths * extra).sum()) == 12345 and (extra <= counts).all()
    assert mixing.fit_budget(lengths, counts, 9 * total, 3)[0] == 3


def test_mix(spark):
    rng = random.Random(10)
    docs = [
        (i, " ".join(["word"] * rng.randint(1, 60)), rng.choice(["a", "A ", "b", "big", "big", "big"]), 1) for i in range(400)
    ] + [(1000, None, "a", 1), (1001, "x", None, 1), (1002, "", "b", 1), (1003, "zero", "none", 1)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens int")
    targets = spark.createDataFrame(
        [("m", "A", 1.0, 3), ("m", "b", 2.0, None), ("m", "big", 3.0, 1), ("m", "gone", 1.0, 2), ("m", "none", None, 1)],
        "mix_name string, source string, weight double, max_repeats int"
    )
    uses = mixing.mix_uses(documents, targets).collect()
    assert len(uses) == len({(r["mix_name"], r["doc_id"]) for r in uses})
    most = {"a": 3, "b": 1, "big": 1, "none": 0}
    got = dict.fromkeys(most, 0)
    for r in uses:
        assert 0 <= r["uses"] <= most[r["source"]]
        got[r["source"]] += r["uses"] * r["n_tokens"]
    total = sum(got.values())
    assert abs(got["a"] / total - 1 / 6) < 0.01 and abs(got["b"] / total - 1 / 3) < 0.01
    shares = {r["source"]: r for r in mixing.mix_shares(documents, targets).collect()}
    assert {k: shares[k]["tokens"] for k in got} == got and shares["gone"]["tokens"] == 0
    assert {r["uses"] for r in uses if r["doc_id"] in (1000, 1002)} == {0}
    assert mixing.mix_uses(documents.limit(0), targets).count() == 0
    assert mixing.mix_uses(documents, targets.limit(0)).count() == 0


def load(slots, sizes):
    """Bins as the slots fill them: {bin: used}."""
    bins, seen = {}, {}
    for length, start, end, first, each in slots:
        for rank in range(start, end):
            bins[first + (rank - start) // each] = bins.get(first + (rank - start) // each, 0) + length
            seen[length] = seen.get(length, 0) + 1
    assert seen == sizes
    return bins


def test_best_fit_places_all_within_capacity():
    rng = random.Random(11)
    for _ in range(200):
        capacity = rng.randint(3, 60)
        sizes = {n: rng.randint(1, 30) for n in rng.sample(range(0, capacity + 1), rng.randint(1, min(12, capacity)))}
        bins = load(packing.best_fit([*sizes], [*sizes.values()], capacity), sizes)
        assert max(bins.values()) <= capacity
        items = sorted((n for n, c in sizes.items() for _ in range(c)), reverse=True)
        plain = []  # best fit over single items
        for n in items:
            fits = [i for i, room in enumerate(plain) if room >= n]
            if fits:
                plain[min(fits, key=lambda i: plain[i])] -= n
            else:
                plain.append(capacity - n)
        assert len(bins) == max(len(plain), 1 if items else 0)


def test_pack_chunks(spark):
    rng = random.Random(12)
    rows = [
        (i, "x" * rng.choice([3, 40, 40, 97]), None, rng.choice([None, 0, 5, 30])) for i in range(300)
    ] + [(900, "y" * 950, "  ", 501), (901, None, None, None), (902, "z" * 50, "z" * 20, 7)]
    chunks = spark.createDataFrame(rows + rows[:50], "source_order long, raw_text string, compressed_text string, estimated_tokens int")
    limits = spark.createDataFrame(
        [(1, "tokens", 100), (2, "chars ", 200), (3, "chars", 0), (4, "pages", 9), (5, None, None)],
        "limit_id int, unit string, capacity int"
    )
    packed = packing.pack_chunks(chunks, limits)
    by = packed.groupBy("limit_id", "batch_number").agg(F.sum("size").alias("n"))
    fullest = {r["limit_id"]: r["n"] for r in by.groupBy("limit_id").agg(F.max("n").alias("n")).collect()}
    assert set(fullest) == {1, 2} and fullest[1] <= 100 and fullest[2] <= 200
    once = packed.groupBy("limit_id", "source_order").agg(F.count(F.lit(1)).alias("k"), F.max("pieces").alias("pieces"), F.sum("size").alias("n")).collect()
    assert all(r["k"] == r["pieces"] for r in once) and len(once) == 2 * 303
    assert {(r["limit_id"], r["k"], r["n"]) for r in once if r["source_order"] == 900} == {(1, 6, 501), (2, 5, 950)}
    report = {r["limit_id"]: r for r in packing.packing_report(packed, limits).collect()}
    assert all(r["batches"] <= r["least_batches"] * 1.05 + 1 for r in report.values())
    assert packing.pack_chunks(chunks.limit(0), limits).count() == 0


def test_ranks_without_gaps(spark):
    df = with_salt(spark.range(1000).select("id", F.lit("k").alias("k")), [F.col("id")], 5)
    ranked = rank_in_cell(df, ["k"], ["id"]).join(cells(df, ["k"]), ["k", "_salt"]).select((F.col("_rank") + F.col("_before")).alias("r"))
    assert sorted(r["r"] for r in ranked.collect()) == [*range(1000)]


def test_chunks_without_a_key_are_all_packed(spark):
    rows = [
        (None, "a" * 30, None, None),
        (None, "b" * 30, None, None),
        (None, "c" * 250, None, None),
        (None, "c" * 250, None, None),
        (1, "d" * 20, None, None),
        (None, None, "e" * 30, None),
        (None, "e" * 30, None, None)
    ]
    chunks = spark.createDataFrame(rows, "source_order long, raw_text string, compressed_text string, estimated_tokens int")
    limits = spark.createDataFrame([(1, "chars", 100)], "limit_id int, unit string, capacity int")
    packed = packing.pack_chunks(chunks, limits)
    assert packed.columns == ["limit_id", "source_order", "piece", "pieces", "size", "batch_number"]
    got = packed.collect()
    assert sorted((r["size"], r["piece"], r["pieces"]) for r in got) == [
        (20, 0, 1),
        (30, 0, 1),
        (30, 0, 1),
        (30, 0, 1),
        (30, 0, 1),
        (50, 2, 3),
        (100, 0, 3),
        (100, 1, 3)
    ]
    used = {}
    for r in got:
        used[r["batch_number"]] = used.get(r["batch_number"], 0) + r["size"]
    assert max(used.values()) <= 100


def test_budgets_beyond_the_knapsack_as_by_brute_force():
    rng = random.Random(9)
    for k in range(200):
        many = k % 2
        lengths = np.array(sorted(rng.sample(range(1, 40), 20 if many else rng.randint(2, 6))), np.int64)
        counts = np.array([rng.randint(3 if many else 1, 60) for _ in lengths], np.int64)
        total = int((lengths * counts).sum())
        budget = rng.randint(1, total)
        sums = 1
        for n, c in zip(lengths.tolist(), counts.tolist()):
            for _ in range(c):
                sums |= sums << n
        best = min(abs(budget - x) for x in range(total + 1) if sums >> x & 1)
        passes, extra = mixing.fit_budget(lengths, counts, budget, 5, knapsack=120)
        assert (extra >= 0).all() and (extra <= counts).all()
        gap = abs(budget - passes * total - int((extra * lengths).sum()))
        assert gap == best if many else gap <= best + lengths.max()
