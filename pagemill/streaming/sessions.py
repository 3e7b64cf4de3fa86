"""Quiz sessions as keyed state, over a finished table and over a stream of the same events.

Events: answer (selected, correct), retry, remove_mark, clear_marks, restart.  An answer counts an attempt and, if
wrong, a miss mark; a right one never lowers the marks; removing stops at none; a restart begins a new session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.functions import text as T
from pagemill.session import cut_lineage

KEYS = ["learner", "q_index"]


def named_events(events: DataFrame) -> DataFrame:
    """Events of a table or stream, kinds in lower case and labels in upper; those without id, learner, kind or time are left out."""
    named = events.withColumn("kind", F.lower(F.trim("kind"))).where("event_id is not null and learner is not null and kind is not null and ts is not null")
    return named.select("event_id", "learner", "q_index", "kind", F.upper(F.trim("selected")).alias("selected"), "correct", "ts")


def clean_events(events: DataFrame) -> DataFrame:
    """Each event of a table once."""
    slim = named_events(events)
    return slim.groupBy("event_id").agg(F.min(F.struct("learner", "q_index", "kind", "selected", "correct", "ts")).alias("_e")).select("event_id", "_e.*")


def last_session(events: DataFrame) -> DataFrame:
    """Events after each learner's last restart; that moment is an aggregate, so a busy learner is no hot window."""
    moment = F.struct("ts", "event_id")
    restarts = events.where("kind = 'restart'").groupBy("learner").agg(F.max(moment).alias("_last")).select(F.col("learner").alias("_who"), "_last")
    joined = events.join(restarts, F.col("learner") == F.col("_who"), "left").where((F.col("kind") != "restart") & F.col("q_index").isNotNull())
    return joined.where(F.col("_last").isNull() | (moment > F.col("_last"))).drop("_who", "_last")


def answers(events: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """(learner, q_index, selected, correct, attempts) of the last session: the last answer and how many there were.

    ``session`` is what last_session makes of the events, where the caller has it already.
    """
    rows = (last_session(events) if session is None else session).where("kind = 'answer'")
    last = F.max(F.struct("ts", "event_id", "selected", F.coalesce("correct", F.lit(False)).alias("correct")))
    return rows.groupBy(*KEYS).agg(last.alias("_l"), F.count(F.lit(1)).alias("attempts")).select(*KEYS, "_l.selected", "_l.correct", "attempts")


def miss_marks(events: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """(learner, q_index, marks) above 0 of the last session.

    Marks are a walk that stops at zero: its end is the sum of steps less the lowest running sum, if that is below
    zero.  A clearing begins the walk anew.
    """
    wrong = (F.col("kind") == "answer") & ~F.coalesce("correct", F.lit(False))
    steps = (last_session(events) if session is None else session).withColumn(
        "_step",
        F.when(wrong, 1).when(F.col("kind") == "remove_mark", -1)
    ).where("_step is not null or kind = 'clear_marks'")
    cleared = steps.where("kind = 'clear_marks'").groupBy(*KEYS).agg(F.max(F.struct("ts", "event_id")).alias("_clear"))
    rest = steps.join(cleared, KEYS, "left").where(F.col("_step").isNotNull() & (F.col("_clear").isNull() | (F.struct("ts", "event_id") > F.col("_clear"))))
    running = F.sum("_step").over(Window.partitionBy(*KEYS).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    ends = rest.withColumn("_run", running).groupBy(*KEYS).agg((F.sum("_step") - F.least(F.lit(0), F.min("_run"))).alias("marks"))
    return ends.where("marks > 0")


def retrying(events: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """(learner, q_index) whose last of retry and answer is retry: an answer there may be given again."""
    rows = (last_session(events) if session is None else session).where("kind in ('retry', 'answer')")
    return rows.groupBy(*KEYS).agg(F.max(F.struct("ts", "event_id", "kind"))["kind"].alias("_kind")).where("_kind = 'retry'").select(*KEYS)


def status_text(marks: Column, correct: Column) -> Column:
    missed = F.when(correct.isNull(), "Queued for retry").when(correct, "Corrected after retry").otherwise("Still incorrect")
    marked = F.concat(F.lit("Miss marks: "), T.miss_preview(marks), F.lit(" • "), missed)
    return F.when(marks > 0, marked).when(correct.isNull(), "Not answered yet").when(correct, "Answered correctly").otherwise("Answered incorrectly")


def question_states(events: DataFrame) -> DataFrame:
    """Answers and marks side by side, with the text shown for each question."""
    session = cut_lineage(last_session(events))
    both = answers(events, session).join(miss_marks(events, session), KEYS, "full").join(
        retrying(events, session).withColumn("retry", F.lit(True)),
        KEYS,
        "left"
    )
    return both.withColumn("marks", F.coalesce("marks", F.lit(0))).withColumn(
        "locked",
        F.col("selected").isNotNull() & F.col("retry").isNull()
    ).drop("retry").withColumn("status", status_text(F.col("marks"), F.col("correct")))


def missed_summary(events: DataFrame) -> DataFrame:
    """(learner, missed, pending, corrected) over questions with marks."""
    right = F.coalesce("correct", F.lit(False))
    session = cut_lineage(last_session(events))
    states = miss_marks(events, session).join(answers(events, session).select(*KEYS, "correct"), KEYS, "left")
    return states.groupBy("learner").agg(F.count(F.lit(1)).alias("missed"), F.count_if(~right).alias("pending"), F.count_if(right).alias("corrected"))


def next_missed(events: DataFrame) -> DataFrame:
    """(learner, q_index, next_index): the next question with marks, null where the list ends."""
    return miss_marks(events).select(*KEYS, F.lead("q_index").over(Window.partitionBy("learner").orderBy("q_index")).alias("next_index"))


def next_question(questions: DataFrame, quiz: str) -> DataFrame:
    """(quiz, q_index, next_index, label) of the questions of each quiz: the next in order, null where it ends, and the place in it.

    A quiz is bounded by what one learner answers.
    """
    whole = Window.partitionBy(quiz)
    place = F.row_number().over(whole.orderBy("q_index")).cast("string")
    label = F.concat(F.lit("Question "), place, F.lit(" of "), F.count(F.lit(1)).over(whole).cast("string"))
    return questions.select(quiz, "q_index", F.lead("q_index").over(whole.orderBy("q_index")).alias("next_index"), label.alias("label"))


def snapshots(events: DataFrame) -> DataFrame:
    """(learner, state): what a session saves, {"answers":[[index,{"selected","correct","attempts"}]],"missMarks":[[index,n]]}, by index.

    A learner's state is bounded by the questions of a bank, not by events.
    """
    answer = F.to_json(F.struct("selected", "correct", "attempts"))
    pair = lambda value: F.concat(F.lit("["), F.col("q_index").cast("string"), F.lit(","), value, F.lit("]"))
    session = cut_lineage(last_session(events))
    own = answers(events, session).select("learner", "q_index", pair(answer).alias("answer"), F.lit(None).cast("string").alias("mark"))
    marks = miss_marks(events, session).select(
        "learner",
        "q_index",
        F.lit(None).cast("string").alias("answer"),
        pair(F.col("marks").cast("string")).alias("mark")
    )
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.filter(F.collect_list(F.struct("q_index", c)), lambda x: x[c].isNotNull())), lambda x: x[c]), ",")
    made = own.unionByName(marks).groupBy("learner").agg(listed("answer").alias("_a"), listed("mark").alias("_m"))
    return made.select("learner", F.concat(F.lit('{"answers":['), F.col("_a"), F.lit('],"missMarks":['), F.col("_m"), F.lit("]}")).alias("state"))


def save_snapshots(states: DataFrame, path: str) -> None:
    """A batch of snapshots beside those saved before, one folder a batch; the last of a learner counts when it is read back."""
    states.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def saved_snapshots(spark, path: str) -> DataFrame:
    """(learner, state): the last snapshot of each learner."""
    return spark.read.parquet(path).groupBy("learner").agg(F.max(F.struct("saved_at", "state"))["state"].alias("state"))


def restored(saved: DataFrame, questions: DataFrame) -> DataFrame:
    """A saved snapshot (learner, q_index double, selected, correct, attempts double, marks double) checked against the bank.

    Kept are answers with a whole index of a question that has the selected option, attempts of at least one, rounded,
    and marks above zero, rounded.
    """
    bank = questions.select(F.col("q_index").cast("long").alias("_i"), "options")
    whole = saved.where(F.col("q_index") == F.floor("q_index")).withColumn("q_index", F.col("q_index").cast("long"))
    joined = whole.join(bank, F.col("q_index") == F.col("_i"))
    known = F.array_contains("options", F.col("selected"))
    rounded = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    attempts = F.when(known, F.greatest(F.lit(1), F.coalesce(F.when(~F.isnan("attempts"), rounded("attempts")), F.lit(1))))
    marks = F.greatest(F.lit(0), F.coalesce(F.when(~F.isnan("marks"), rounded("marks")), F.lit(0)))
    made = joined.select(
        "learner",
        "q_index",
        F.when(known, F.col("selected")).alias("selected"),
        F.when(known, F.coalesce("correct", F.lit(False))).alias("correct"),
        attempts.alias("attempts"),
        marks.alias("marks")
    )
    return made.where("selected is not null or marks > 0")


STATE = "selected string, correct boolean, attempts int, marks int, retry boolean"
OUTPUT = "learner string, q_index int, selected string, correct boolean, attempts int, marks int, retry boolean"


#: A question that was never answered.
FRESH = (None, None, 0, 0, False)


def step(state: tuple, kind: str, selected: str | None, correct: bool | None) -> tuple:
    """One event on the state (selected, correct, attempts, marks, retry) of a question."""
    chosen, right, attempts, marks, retry = state
    if kind == "answer":
        return selected, bool(correct), attempts + 1, marks + (not correct), False
    if kind == "restart":
        return FRESH
    if kind == "retry":
        return chosen, right, attempts, marks, True
    if kind == "remove_mark":
        return chosen, right, attempts, max(0, marks - 1), retry
    if kind == "clear_marks":
        return chosen, right, attempts, 0, retry
    return state


class SessionProcessor(StatefulProcessor):
    """Keeps a learner's questions in a map state, as a restart touches all of them; emits the questions that changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._questions = handle.getMapState("questions", "q_index int", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        touched: dict[int, tuple] = {}
        for e in events.itertuples(index=False):
            kind = e.kind
            if kind == "restart":
                known = {q for (q,), _ in self._questions.iterator()} | set(touched)
                self._questions.clear()
                touched.update(dict.fromkeys(known, FRESH))
                continue
            if pd.isna(e.q_index):
                continue
            q = int(e.q_index)
            now = touched.get(q)
            if now is None:
                now = tuple(self._questions.getValue((q,))) if self._questions.containsKey((q,)) else FRESH
            now = step(now, kind, None if pd.isna(e.selected) else e.selected, None if pd.isna(e.correct) else bool(e.correct))
            touched[q] = now
            self._questions.updateValue((q,), now)
        out = [(key[0], q, *state) for q, state in sorted(touched.items())]
        frame = pd.DataFrame(out, columns=["learner", "q_index", "selected", "correct", "attempts", "marks", "retry"])
        yield frame.astype({"q_index": "int32", "attempts": "int32", "marks": "int32", "selected": object, "correct": object, "retry": bool})

    def close(self) -> None:
        pass


def stream_states(events: DataFrame) -> DataFrame:
    """Changed states of a stream of events, in update mode; needs the RocksDB state store.

    Unlike a table, a stream is read as it comes: events are in order within a trigger, but one that arrives after
    younger ones were handled is applied then, and a repeated one counts again unless ``with_watermark`` is put before.
    """
    return named_events(events).groupBy("learner").transformWithStateInPandas(SessionProcessor(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def with_watermark(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Extension: drops repeated event ids within the watermark and what comes later than that."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
