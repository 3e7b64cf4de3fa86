import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.jsstr import collapse, js_round, js_trim
from pagemill.operators.chunking import chunk_array, chunk_pages, with_source_order
from pagemill.sources.readers import normalize


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


def test_normalize_extracted(spark):
    assert one(spark, "exam-\n ple  text\x00", T.normalize_extracted) == "example text"
    assert normalize("exam-\n ple  text\x00") == "example text"
    assert one(spark, None, T.normalize_extracted) is None


def test_white_space_and_rounding(spark):
    assert one(spark, "﻿ a \t b ", js_trim) == "a \t b"
    assert one(spark, " a \t b ", collapse) == "a b"
    assert [r[0] for r in spark.sql("select explode(array(-2.5, 2.5, 0.49)) as x").select(js_round(F.col("x"))).collect()] == [-2, 3, 0]


def test_sentences(spark):
    assert one(spark, "Hi. there. A 1! 2", T.chunk_sentences) == ["Hi. there.", "A 1!", "2"]
    assert one(spark, "Hi. there. A 1! 2", T.sentences) == ["Hi.", "there.", "A 1!", "2"]
    assert one(spark, "  ", T.sentences) == [""]


def test_compression(spark):
    made = one(spark, "a" * 600, T.compress)
    assert made == "a" * 417 + "..."
    assert one(spark, " short  text ", T.compress) == "short text"


def test_stop_words_only(spark):
    row = spark.createDataFrame([("the and of",)], "x string").withColumn("w", T.tokens(F.col("x"))).select(
        T.fingerprint(T.content_tokens(F.col("w"))).alias("f"),
        T.information_score(F.col("x"), F.col("w")).alias("s")
    ).first()
    assert row["f"] == "" and row["s"] > 0


def test_topic(spark):
    assert one(spark, "Cellular", lambda c: T.topic_score(c, "cell cell of")) == 16
    assert one(spark, "Cellular", lambda c: T.topic_score(c, None)) == 0


def test_slugs_stems_cells_hash(spark):
    assert one(spark, "My File (1).pdf", T.slug) == "my-file-1-pdf"
    assert one(spark, "What  is\tX?", T.stem_key) == "what is x"
    assert one(spark, "数学", T.stem_key) == ""
    assert one(spark, 'a "q", b', T.csv_cell) == '"a ""q"", b"'
    assert one(spark, "x\ny", T.csv_cell) == "x y"
    assert one(spark, "abc", T.fnv1a) == "7aigaz"
    assert one(spark, "<a href='x'>&\"", T.html_escape) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert one(spark, "<&>", T.script_safe) == "\\u003c\\u0026\\u003e"


@pytest.mark.parametrize(("n", "shown"), [(10, "10 B"), (2048, "2.0 KB"), (3 * 1048576, "3.0 MB")])
def test_bytes(spark, n, shown):
    assert spark.range(1).select(T.format_bytes(F.lit(n))).first()[0] == shown


def test_labels_and_marks(spark):
    row = spark.range(1).select(
        T.option_labels(F.lit(4)),
        T.option_range(F.lit(4)),
        T.option_range(F.lit(1)),
        T.miss_preview(F.lit(8)),
        T.choice_text(F.array(F.lit(4), F.lit(5)))
    ).first()
    assert list(row) == [["A", "B", "C", "D"], "A-D", "A", "X X X X X X +2", "4-5 answer choices"]


def chunks_by_hand(text, target=1200, overlap=220, least=320):
    import re

    if not text.strip():
        return []
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text) if p.strip()] or [text]
    out, held = [], ""
    for p in parts:
        joined = f"{held} {p}" if held else p
        if len(joined) <= target:
            held = joined
        elif len(held) >= least:
            out.append(held.strip())
            held = f"{held[-overlap:]} {p}".strip()
        elif len(p) > target:
            out += [w for i in range(0, len(p), target - overlap) if (w := p[i : i + target].strip())]
            held = ""
        else:
            held = joined
    return out + ([held.strip()] if held.strip() else [])


def test_chunk_cases(spark):
    def lengths(text):
        return [len(c) for c in one(spark, text, chunk_array)]

    assert lengths("  \n ") == []
    assert lengths("a" * 99 + ". " + "B" * 1299 + ".") == [1200, 320]
    assert lengths("a" * 399 + ". " + "B" * 2999 + ".") == [400, 3221]
    assert one(spark, None, chunk_array) is None


def test_chunks_as_by_hand(spark):
    rng = random.Random(3)
    texts = [
        " ".join(
            ("W" if rng.random() < 0.7 else "w") + "x" * rng.choice([3, 40, 300, 1400]) + rng.choice([".", "!", ""]) for _ in range(rng.randint(0, 25))
        ) for _ in range(60)
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunk_array(F.col("t")).alias("c"))
    for r in df.collect():
        assert r["c"] == chunks_by_hand(texts[r["i"]]), r["i"]


def test_chunk_ids_and_order(spark):
    rows = [(1, "B.docx", 0, None, "Body text."), (0, None, 0, 3, "First. Page."), (0, None, 1, 4, None), (1, "B.docx", 1, None, "Notes text.")]
    pages = spark.createDataFrame(rows, "file_index int, file_name string, page_seq int, page_number int, text string")
    got = [(r["source_order"], r["id"], r["chunk_id"]) for r in with_source_order(chunk_pages(pages)).orderBy("source_order").collect()]
    assert got == [(0, "file-1-p3-1", "file-1-p3-c1"), (1, "b-docx-unknown-1", "b-docx-unknown-c1"), (2, "b-docx-unknown-1", "b-docx-unknown-c1")]
    assert with_source_order(chunk_pages(pages.limit(0))).count() == 0


def test_hash_of_whole_questions(spark, tmp_path):
    from pagemill.plans import catalog

    def by_units(text):
        h, raw = 2166136261, text.encode("utf-16-le")
        for at in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[at : at + 2], "little")) * 16777619 & 0xFFFFFFFF
        out = ""
        while h:
            h, digit = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + out
        return out or "0"

    texts = ["abc", "a\nb", "Größe?", "Gräße?", "為什麼", "x 😀 y", "x 😁 y", "𝒜"]
    spark.createDataFrame(list(enumerate(texts)), "question_id long, question string").write.parquet(f"{tmp_path}/questions.parquet")
    got = dict(map(tuple, catalog.storage_key_hash(spark, str(tmp_path)).collect()))
    assert got == {i: by_units(x) for i, x in enumerate(texts)} and len(set(got.values())) == len(texts)
