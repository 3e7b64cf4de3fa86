import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.streaming import sessions

SCHEMA = "event_id long, learner string, q_index int, kind string, selected string, correct boolean, ts timestamp"
START = datetime(2024, 1, 1)


def event(i, learner, q, kind, selected=None, correct=None):
    return (i, learner, q, kind, selected, correct, START + timedelta(seconds=i))


def made_up(n=300, seed=4):
    rng = random.Random(seed)
    kinds = ["answer"] * 6 + ["retry", "remove_mark", "clear_marks", "restart"]
    rows = []
    for i in range(n):
        kind = rng.choice(kinds)
        right = rng.random() < 0.5
        rows.append(
            event(
                i,
                f"l{rng.randint(0, 3)}",
                None if kind == "restart" else rng.randint(0, 5),
                kind,
                "ab"[right] if kind == "answer" else None,
                right if kind == "answer" else None
            )
        )
    return rows


def by_hand(rows):
    state = {}
    for _, learner, q, kind, selected, correct, _ in sorted(rows, key=lambda r: (r[6], r[0])):
        if kind == "restart":
            state = {k: v for k, v in state.items() if k[0] != learner}
            continue
        now = state.get((learner, q), (None, None, 0, 0, False))
        state[(learner, q)] = sessions.step(now, kind, selected.upper() if selected else None, correct)
    return state


def test_wrong_then_right_then_marks_removed(spark):
    rows = [
        event(1, "a", 0, "answer", "b", False),
        event(2, "a", 0, "Answer ", "a", True),
        event(3, "a", 0, "remove_mark"),
        event(4, "a", 0, "remove_mark"),
        event(4, "a", 0, "remove_mark"),
        event(5, None, 0, "answer"),
        event(6, "a", 0, None)
    ]
    events = sessions.clean_events(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in sessions.answers(events).collect()] == [("a", 0, "A", True, 2)]
    assert sessions.miss_marks(events).count() == 0


def test_batch_as_by_hand(spark):
    rows = made_up()
    want = by_hand(rows)
    events = sessions.clean_events(spark.createDataFrame(rows + rows[:40], SCHEMA))
    got = {(r["learner"], r["q_index"]): (r["selected"], r["correct"], r["attempts"]) for r in sessions.answers(events).collect()}
    assert got == {k: v[:3] for k, v in want.items() if v[2]}
    marks = {(r["learner"], r["q_index"]): r["marks"] for r in sessions.miss_marks(events).collect()}
    assert marks == {k: v[3] for k, v in want.items() if v[3]}
    assert {(r["learner"], r["q_index"]) for r in sessions.retrying(events).collect()} == {k for k, v in want.items() if v[4]}
    for r in sessions.question_states(events).collect():
        v = want[(r["learner"], r["q_index"])]
        assert r["locked"] == (v[0] is not None and not v[4])


def test_summary_and_next(spark):
    rows = [event(1, "a", 0, "answer", "x", False), event(2, "a", 2, "answer", "x", False), event(3, "a", 2, "answer", "y", True)]
    events = sessions.clean_events(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in sessions.missed_summary(events).collect()] == [("a", 2, 1, 1)]
    assert {tuple(r) for r in sessions.next_missed(events).collect()} == {("a", 0, 2), ("a", 2, None)}
    assert sessions.question_states(events.limit(0)).count() == 0


def test_snapshot(spark):
    saved = [("a", 0.0, "x", True, 2.6, 0.0), ("a", 0.5, "x", True, 1.0, 1.0), ("a", 1.0, "no", True, 1.0, 2.4), ("a", 9.0, "x", True, 1.0, 1.0)]
    df = spark.createDataFrame(saved, "learner string, q_index double, selected string, correct boolean, attempts double, marks double")
    bank = spark.createDataFrame([(0, ["x"]), (1, ["y"])], "q_index int, options array<string>")
    assert {tuple(r) for r in sessions.restored(df, bank).collect()} == {("a", 0, "x", True, 3, 0), ("a", 1, None, None, None, 2)}


def test_stream_equals_batch(spark, tmp_path):
    rows = made_up(120, 9)
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = sessions.stream_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option(
        "checkpointLocation",
        str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
        assert query.exception() is None
        got = {(r["learner"], r["q_index"]): tuple(r)[2:] for r in spark.table("states").collect()}
    finally:
        query.stop()
    want = by_hand(rows)
    assert {k: v for k, v in got.items() if v != (None, None, 0, 0, False)} == {k: v for k, v in want.items() if v != (None, None, 0, 0, False)}


def test_snapshots_are_saved_and_read_back(spark, tmp_path):
    rows = [
        (1, "a", 2, "answer", "B", False, 1),
        (2, "a", 2, "answer", "C", True, 2),
        (3, "a", 0, "answer", None, True, 3),
        (4, "b", 1, "retry", None, None, 4)
    ]
    events = spark.createDataFrame(
        rows,
        "event_id long, learner string, q_index int, kind string, selected string, correct boolean, t int"
    ).withColumn("ts", F.timestamp_seconds("t"))
    made = sessions.snapshots(sessions.clean_events(events))
    assert {r["learner"]: r["state"] for r in made.collect()} == {
        "a": '{"answers":[[0,{"correct":true,"attempts":1}],[2,{"selected":"C","correct":true,"attempts":2}]],"missMarks":[[2,1]]}'
    }
    sessions.save_snapshots(made, str(tmp_path / "s"))
    sessions.save_snapshots(made.withColumn("state", F.lit("later")), str(tmp_path / "s"))
    assert [tuple(r) for r in sessions.saved_snapshots(spark, str(tmp_path / "s")).collect()] == [("a", "later")]


def test_next_question(spark):
    rows = spark.createDataFrame([(1, 5), (1, 2), (2, 0)], "quiz int, q_index int")
    assert {tuple(r) for r in sessions.next_question(rows, "quiz").collect()} == {
        (1, 2, 5, "Question 1 of 2"),
        (1, 5, None, "Question 2 of 2"),
        (2, 0, None, "Question 1 of 1")
    }


def streamed(spark, tmp_path, parts, watermark):
    """The last state of each question after a stream of one file a trigger, in order of the files."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "one" / str(k)))
        for path in (tmp_path / "one" / str(k)).glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            path.rename(tmp_path / "in" / f"{k}.parquet")
            os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = sessions.stream_states(sessions.with_watermark(stream, "1 day") if watermark else stream)
    seen = {}
    query = states.writeStream.outputMode("update").foreachBatch(
        lambda df, _: seen.update({(r["learner"], r["q_index"]): tuple(r)[2:5] for r in df.collect()})
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return seen


@pytest.mark.parametrize("watermark", [False, True])
def test_stream_takes_events_as_they_come(spark, tmp_path, watermark):
    early, late = event(1, "a", 0, "answer", "B", False), event(2, "a", 0, "answer", "C", True)
    got = streamed(spark, tmp_path, [[late], [early], [late]], watermark)
    # the table has C, right, in two attempts; the stream applies B last, or the repeated C again
    assert got == {("a", 0): ("B", False, 2) if watermark else ("C", True, 3)}
    table = sessions.answers(sessions.clean_events(spark.createDataFrame([late, early, late], SCHEMA)))
    assert [tuple(r) for r in table.collect()] == [("a", 0, "C", True, 2)]
