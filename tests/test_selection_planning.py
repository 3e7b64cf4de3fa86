import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import planning, prompts, selection
from pagemill.settings import Limits, QuizSettings

SCHEMA = "source_order long, id string, file_name string, raw_text string, compressed_text string, score double, page int, chunk_id string"


def table(spark, rows):
    full = [(i, r[0], r[1], r[2], r[2], float(r[3]), 1, f"c{i}") for i, r in enumerate(rows)]
    return selection.with_fingerprint(spark.createDataFrame(full, SCHEMA))


def test_tie_keeps_the_earlier_and_the_first_place(spark):
    t = table(
        spark,
        [("a", "f", "Same words here", 5), ("b", "g", "Same words here", 5), ("c", "g", "Same words here", 7), ("d", "g", "of the", 1), ("d", "g", "the of", 0)]
    )
    got = {(r["source_order"], r["position"]) for r in selection.dedupe(t).collect()}
    assert got == {(2, 0), (4, 3)}
    assert {r["source_order"] for r in selection.dedupe(t, ["file_name"]).collect()} == {0, 2, 4}


def staged(rows):
    """The selection as it is told: best of each file in order of appearance, then by score, skipping ids in use."""
    order = sorted(range(len(rows)), key=lambda i: -rows[i][3])
    best = {}
    for i in order:
        best.setdefault(rows[i][1], i)
    files = list(dict.fromkeys(r[1] for r in rows))
    chosen = [best[f] for f in files]
    used = {rows[i][0] for i in chosen}
    for i in order:
        if rows[i][0] not in used:
            chosen.append(i)
            used.add(rows[i][0])
    return set(chosen)


def test_cover_as_staged(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(f"id{rng.randint(0, 9)}", f"f{rng.randint(0, 3)}", f"text {i} words", rng.randint(0, 4)) for i in range(30)]
        t = table(spark, rows).withColumn("position", F.col("source_order"))
        assert {r["source_order"] for r in selection.cover(t).collect()} == staged(rows)
        wide = selection.cover_within(t.withColumn("run", F.lit("r")), Limits())
        assert {r["source_order"] for r in wide.collect()} == staged(rows)


def test_budgets_skip_what_does_not_fit(spark):
    rows = [("a", "f", "x" * 50, 9), ("b", "f", "y" * 90, 8), ("c", "f", "z" * 40, 7), ("d", "g", "w" * 20, 1)]
    t = table(spark, rows).withColumn("position", F.col("source_order")).withColumn("run", F.lit(1))
    got = [r["source_order"] for r in selection.cover_within(t, Limits(max_prompt_chars=115)).collect()]
    assert got == [0, 3, 2]
    assert selection.cover_within(t, Limits(max_total_chunks=1)).count() == 1


def test_sequential_and_balanced():
    assert planning.balanced([5, 4, 3, 3, 3], 2) == [0, 1, 1, 0, 1]
    loads = [0] * 6
    for i in planning.sequential([100] * 60, 6):
        loads[i] += 100
    assert loads == [1000, 2000, 3000, 0, 0, 0]
    assert planning.sequential([100] * 5, 5) == [0] * 5
    assert planning.balanced([], 3) == [] and planning.sequential([], 3) == []


def test_allocation():
    assert planning.allocate(7, 3, 2) == [3, 3]
    rng = random.Random(1)
    for _ in range(300):
        target, most, used = rng.randint(0, 40), rng.randint(1, 9), rng.randint(1, 9)
        got, left = [0] * used, target
        while left and any(g < most for g in got):
            for i in range(used):
                if left and got[i] < most:
                    got[i] += 1
                    left -= 1
        assert planning.allocate(target, most, used) == got


def test_plan_scans_buckets_upward():
    rng = random.Random(2)
    for ordering in ("best_match", "page_order"):
        settings = QuizSettings(target_questions=12, questions_per_prompt=4, ordering=ordering)
        for _ in range(30):
            lengths = [rng.randint(1, 4000) for _ in range(rng.randint(1, 40))]
            spread = planning.balanced if ordering == "best_match" else planning.sequential
            n = 3
            while n < len(lengths) and max(sum(x for x, i in zip(lengths, spread(lengths, n)) if i == b) for b in range(n)) > settings.char_budget:
                n += 1
            at = spread(lengths, n)
            used = sorted(set(at))
            got = planning.plan(lengths, settings)
            assert len({b for b, _, _ in got if b}) == sum(q > 0 for q in planning.allocate(12, 4, len(used)))
            assert [x[2] for x in got] == [sum(m for m, j in zip(lengths, at) if j == i) for i in at]


def test_budget_and_questions():
    assert QuizSettings(questions_per_prompt=5).char_budget == 7150
    assert QuizSettings(questions_per_prompt=8, density="dense", response_format="compact").char_budget == 14742
    assert QuizSettings(questions_per_prompt=float("nan")).questions == 5 and QuizSettings(questions_per_prompt=500).questions == 100
    assert QuizSettings().with_density("dense").questions == 8


def test_packets_and_prompt(spark):
    rows = spark.createDataFrame(
        [(1, 0, None, "f.pdf", "c1", "One."), (1, 1, 2, "g.pdf", "c2", None)],
        "batch_number int, place int, page int, file_name string, chunk_id string, compressed_text string"
    )
    packet = prompts.source_packets(rows, ["batch_number"], ["place"])
    text = packet.first()["packet"]
    assert text == "SOURCE_1\nfile: f.pdf\npage: unknown\nchunkId: c1\ncontent: One.\n\nSOURCE_2\nfile: g.pdf\npage: 2\nchunkId: c2\ncontent: "
    made = prompts.master_prompts(
        packet.withColumn("question_count", F.lit(3)),
        QuizSettings(response_format="compact"),
        F.array(F.lit("Old {n}?")),
        F.lit("B")
    ).first()["prompt"]
    assert "Target about 3 multiple-choice" in made and "- Working batch: B." in made and "PREVIOUS_QUESTION_1: Old {n}?" in made and made.endswith("SOURCE_PACKET_END")
    assert '{"questions":[["question",["A","B","C","D"],0,"short explanation",["file","page","chunkId"]]]}' in made
    advice = spark.createDataFrame([(2,), (0,), (-1,)], "missing int").select(
        prompts.count_advice(F.col("missing"), QuizSettings(density="dense", questions_per_prompt=8))
    ).collect()
    assert advice[0][0] == "This model returned too few questions for the current batch. Try Standard mode at 5 questions per prompt. If it still struggles, turn on compact response mode." and advice[1][0] is None and "too many" in advice[2][0]


@pytest.mark.parametrize("ordering", ["best_match", "page_order", "random"])
def test_orders_and_plans_run(spark, ordering):
    t = selection.ordered(table(spark, [(f"i{k}", "f", f"text number {k}", k % 3) for k in range(8)]), ordering)
    planned = planning.plan_chunks(t, "file_name", QuizSettings(ordering=ordering))
    assert planned.count() == 8
    assert planning.batches(planned, t, "file_name").agg(F.sum("chunk_count")).first()[0] == planned.where("batch_number > 0").count()
    assert planning.plan_chunks(t.limit(0), "file_name", QuizSettings()).count() == 0


def test_batches_after_answers(spark):
    batches = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 5)], "batch_number int, question_count int")
    outcomes = spark.createDataFrame(
        [(1, True, 7, 6, 1, True, 1), (2, False, 5, 5, 0, False, 0), (3, True, 5, 5, 0, False, 0)],
        "batch_number int, success boolean, parsed long, added long, duplicates long, skewed boolean, repeated long"
    )
    got = {r["batch_number"]: r for r in planning.parsed_batches(batches, outcomes, "A-D").collect()}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == ["parsed", "pending", "parsed", "pending"] and got[3]["notes"] == [] and got[4]["added"] == 0
    assert got[1]["notes"] == [
        "Accepted 7 questions for a target of 5 (2 over target).",
        "Detected answer-position skew and redistributed correct options across A-D.",
        "Detected 1 question with duplicate option text. Review before export."
    ]
    assert planning.next_pending(planning.parsed_batches(batches, outcomes, "A-D")).first()[0] == 2


def test_queue_of_prompts(spark):
    packets = spark.createDataFrame([(1, "P1", 3, None), (2, "P2", 3, "mine")], "batch_number int, packet string, question_count int, prompt_override string")
    bank = spark.createDataFrame([(k, f"Stem {k}?") for k in range(30)], "k int, question string")
    got = {r["batch_number"]: r["prompt"] for r in prompts.prompt_queue(packets, 2, QuizSettings(), bank, ["k"]).collect()}
    assert got[2] == "mine" and "- Working batch: Prompt 1 of 2." in got[1] and "PREVIOUS_QUESTION_1: Stem 5?" in got[1] and "PREVIOUS_QUESTION_25: Stem 29?" in got[1] and "PREVIOUS_QUESTION_26" not in got[1]
    bare = prompts.prompt_queue(packets, 2, QuizSettings(), bank.limit(0), ["k"]).where("batch_number = 1").first()["prompt"]
    assert "AVOID_DUPLICATES" not in bare


def test_a_length_beyond_the_budget_has_each_its_own_batch():
    lengths = [9000, 10, 20, 30]
    assert len({b for b, _, _ in planning.plan(lengths, QuizSettings(target_questions=4, questions_per_prompt=2))}) == 4
