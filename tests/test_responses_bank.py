import json

from pyspark.sql import functions as F

from pagemill.operators import bank, export, responses

GOOD = {"question": "Q 1?", "options": ["a", "b", "c", "d"], "correctAnswer": "b", "explanation": "e", "source": {"file": "f", "page": "7", "chunkId": "c"}}
ROW = "question_id long, question string, options array<string>, correct_answer string, explanation string, source struct<file string, page string, chunk_id string>, batch_number int, q_index int"


def payload(*questions):
    return json.dumps({"questions": list(questions)})


def parse(spark, raws, response_format="standard"):
    """Verdict and accepted rows of each raw response, all in one plan."""
    df = spark.createDataFrame([(k, raw) for k, raw in enumerate(raws)], "k int, raw string")
    verdicts = {r["k"]: r for r in responses.parse_responses(df, "k", response_format).collect()}
    rows = {k: [] for k in verdicts}
    for r in sorted(responses.accepted_questions(df, "k", response_format).collect(), key=lambda r: r["q_index"]):
        rows[r["k"]].append(r.asDict(True))
    return [(verdicts[k], rows[k]) for k in range(len(raws))]


COMPACT = json.dumps({"questions": [["Q?", ["a", "b", "c", "d"], "b", "e", ["f", " ", "c"]]]})
BAD_COMPACT = json.dumps({"questions": [["Q?", ["a", "b", "c", "d"], 1.5, "e", ["f", "1", "c"]]]})
REFUSED = [
    (payload(GOOD | {"correctAnswer": "b "}), "questions.0.correctAnswer: correctAnswer must match one of the options"),
    (payload(GOOD | {"options": ["a", "b", "c"]}), "questions.0.options: each question needs 4 options"),
    (payload(GOOD | {"question": ""}), "questions.0.question: question is required"),
    (payload(GOOD | {"source": {"file": "f", "page": " ", "chunkId": "c"}}), "questions.0.source.page: source.page is required"),
    (payload(GOOD | {"explanation": None}), "questions.0.explanation: Required"),
    (payload(GOOD, GOOD | {"question": ""}), "questions.1.question: question is required"),
    (None, responses.EMPTY),
    ("  ", responses.EMPTY),
    ("{'a': 1}", responses.NO_JSON),
    ('{"a":1} x }', responses.NO_JSON),
    ("{}", "questions: Required"),
    ('{"questions":[]}', "questions: questions must contain at least 1 item"),
]


def test_standard_responses(spark):
    seven = GOOD | {"source": {"file": "f", "page": 7, "chunkId": "c"}}
    sample = responses.sample_responses(spark, 3).first()["raw"]
    good = [f"Sure:\n```json\n{payload(GOOD)}\n```\nbye", f"text {payload(GOOD)} text", payload(GOOD), payload(GOOD | {"more": 1}, seven), COMPACT, sample]
    got = parse(spark, good + [raw for raw, _ in REFUSED])
    for (verdict, rows), wanted in zip(got, [["b"]] * 3 + [["b", "b"], ["b"], ["Sample option A1", "Sample option A2", "Sample option A3"]]):
        assert verdict["success"] and verdict["errors"] == [] and [r["correct_answer"] for r in rows] == wanted
    assert [r["source"]["page"] for _, rows in got[:5] for r in rows] == ["7", "7", "7", "7", "7", "unknown"]
    for (verdict, rows), (raw, error) in zip(got[len(good) :], REFUSED):
        assert not verdict["success"] and verdict["errors"] == [error] and rows == [], raw


def test_compact_responses(spark):
    sample = responses.sample_responses(spark, 3, "compact").first()["raw"]
    got = parse(spark, [COMPACT, BAD_COMPACT, sample, payload(GOOD), None], "compact")
    assert [v["success"] for v, _ in got] == [True, False, True, False, False]
    assert got[0][1][0]["correct_answer"] == "b" and got[0][1][0]["source"]["page"] == "unknown" and got[1][0]["errors"] == [responses.BAD_INDEX]
    assert [r["correct_answer"] for r in got[2][1]] == ["Sample option A1", "Sample option A2", "Sample option A3"]


def test_correct_index(spark):
    values = ["0", "4", '"b"', '"3"', "5", "-1", '"E"', "1.5", '"4"']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select(
        "i",
        responses.correct_index(F.try_parse_json("v"), 4).alias("x")
    )
    assert [r["x"] for r in df.orderBy("i").collect()] == [0, 3, 1, 3, None, None, None, None, 3]


def questions(spark, rows):
    return spark.createDataFrame([(i, q, o, a, "e", ("f", "1", "c"), b, k) for i, (q, o, a, b, k) in enumerate(rows)], ROW)


def golden(spark):
    o = ["a", "b", "c", "d"]
    return questions(spark, [(f"Stem {i}?", o, o[p], 1, i) for i, p in enumerate([1, 1, 1, 2, 2])])


def test_golden_positions(spark):
    before = golden(spark)
    after = bank.rebalance(before, F.col("q_index"))
    report = bank.quality_report(before, after).first()
    assert report["original_counts"] == [0, 3, 2, 0] and report["balanced_counts"] == [2, 1, 1, 1] and report["skew_detected"]
    for old, new in zip(before.orderBy("q_index").collect(), after.orderBy("q_index").collect()):
        assert sorted(old["options"]) == sorted(new["options"])
    again = bank.merge_report(before, before, ["q_index"]).first()
    assert (again["kept"], again["added"], again["duplicates"]) == (5, 0, 5)


def test_stems(spark):
    rows = questions(
        spark,
        [("What is X?", ["a"], "a", 1, 0), ("what  is x", ["a"], "a", 1, 1), ("数学", ["a"], "a", 1, 2), ("物理", ["a"], "a", 1, 3), (None, None, None, 1, 4)]
    )
    assert {r["question_id"] for r in bank.merged(None, rows, ["question_id"]).collect()} == {0, 2}
    assert bank.merged(None, rows.limit(0), ["question_id"]).count() == 0


def test_rotation_counts_questions_that_repeat(spark):
    o = ["a", "b", "c", "d"]
    rows = questions(spark, [("One?", o, "a", 1, 0), ("Two?", o, "a", 1, 1), ("One?", o, "a", 2, 0), ("Three?", o, "a", 2, 1)])
    got = {r["question_id"]: r["options"].index("a") for r in bank.accept_batches(rows).collect()}
    assert got == {0: 0, 1: 1, 3: 3}


def test_edits_and_duplicates(spark):
    rows = questions(spark, [("Q", ["A", " a"], "A", 1, 0), ("R", ["A", "b", None], None, 1, 1)])
    edits = spark.createDataFrame([(1, "new")], "question_id long, explanation string")
    assert [r["explanation"] for r in bank.with_edits(rows, edits, "question_id", ["explanation"]).orderBy("question_id").collect()] == ["e", "new"]
    assert [r["question_id"] for r in rows.where(bank.has_duplicate_options(F.col("options"))).collect()] == [0]


def test_export_round_trip(spark, tmp_path):
    rows = golden(spark)
    raw = export.payload_json(rows, ["q_index"]).first()["payload"]
    verdict, back = parse(spark, [raw])[0]
    assert verdict["success"] and [r["question"] for r in back] == [f"Stem {i}?" for i in range(5)]
    assert json.loads(export.pretty_json(raw)) == json.loads(raw)
    page = spark.createDataFrame(
        [("T <1>", raw.replace("Stem", "</script>"))],
        "t string, p string"
    ).select(export.html_page(F.col("t"), F.col("p"))).first()[0]
    assert "</script><" not in page.split("application/json")[1].split("</script>")[0] and "<h1>T &lt;1&gt;</h1>" in page and 'data-key="quiz-export-state-' in page
    lines = export.csv_lines(questions(spark, [('a "q", b', ["x", "y\nz"], "x", 1, 0)]), 3, F.lit(1))
    assert lines.first()["line"] == '1,"a ""q"", b",x,y z,,x,e,f,1,c'
    text = export.csv_text(lines, export.csv_header(3)).first()["text"]
    assert text.startswith("questionIndex,question,optionA,optionB,optionC,correctAnswer") and text.endswith("\n" + lines.first()["line"])
    many = spark.range(500).select(F.col("id").alias("number"), F.concat(F.lit("x"), F.col("id")).alias("line"))
    export.write_csv(many, "head", str(tmp_path / "out"))
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "out").glob("part-*")) if p.read_text()]
    assert all(p[0] == "head" for p in parts) and [x for p in parts for x in p[1:]] == [f"x{k}" for k in range(500)]
