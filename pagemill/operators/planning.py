"""Chunks distributed over prompts, and questions over prompts.

A plan is made for each run or file: its ordered lengths, numbers only, are folded where they meet.  What meets is
bounded by the limits of a run (files and bytes a file); different plans are made in parallel.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.settings import QuizSettings

# fixed values
ORDERINGS = {"page_order": "page order", "random": "randomized"}


def balanced(lengths: list[int], buckets: int) -> list[int]:
    """Each length, in order, to the bucket with the fewest characters, the first of equals."""
    loads = [(0, i) for i in range(buckets)]
    out = []
    for n in lengths:
        load, i = loads[0]
        heapq.heapreplace(loads, (load + n, i))
        out.append(i)
    return out


def sequential(lengths: list[int], buckets: int) -> list[int]:
    """Lengths in order; a bucket ends before the length with which it would exceed its threshold.

    Thresholds grow by an even share from bucket to bucket, but only a bucket's own characters count, so later buckets
    grow; a bucket is begun only while more lengths than buckets are left.  Each end is found in the prefix sums.
    """
    ends = [0, *accumulate(lengths)]
    share = ends[-1] / max(buckets, 1)
    starts, threshold = [0], 0.0
    for left in range(buckets - 1, 0, -1):
        threshold += share
        over = bisect_right(ends, ends[starts[-1]] + math.floor(threshold)) - 1
        start = max(over, starts[-1] + 1)
        if len(lengths) - start <= left:
            break
        starts.append(start)
    sizes = [b - a for a, b in zip(starts, [*starts[1:], len(lengths)], strict=True)]
    return [i for i, n in enumerate(sizes) for _ in range(n)]


def allocate(target: int, most: int, used: int) -> list[int]:
    """Questions of each used bucket: round robin, at most ``most`` each, in closed form."""
    given = min(target, used * most)
    return [given // used + (i < given % used) for i in range(used)] if used else []


def plan(lengths: list[int], settings: QuizSettings) -> list[tuple[int, int, int]]:
    """(batch number or 0 for none, questions, characters of the batch) of each length.

    Buckets are added one by one until the fullest fits the budget or each length has its own; the fullest is not
    monotone in the number of buckets, so none but those below the average's bound are passed over.  Where one length
    alone is beyond the budget no number below that of the lengths fits, so none is tried.
    """
    if not lengths or settings.target_questions <= 0:
        return [(0, 0, 0)] * len(lengths)
    spread = balanced if settings.ordering == "best_match" else sequential
    budget = settings.char_budget
    buckets = max(1, -(-settings.target_questions // settings.questions))
    if buckets < len(lengths):
        buckets = len(lengths) if max(lengths) > budget else max(buckets, min(len(lengths), -(-sum(lengths) // budget)))
    while True:
        at = spread(lengths, buckets)
        loads = [0] * buckets
        for i, n in zip(at, lengths, strict=True):
            loads[i] += n
        if buckets >= len(lengths) or max(loads) <= budget:
            break
        buckets += 1
    used = sorted(set(at))
    questions = dict(zip(used, allocate(settings.target_questions, settings.questions, len(used)), strict=True))
    number = {b: k + 1 for k, b in enumerate(b for b in used if questions[b])}
    return [(number.get(i, 0), questions[i], loads[i]) for i in at]


def _by_group(chunks: DataFrame, by: str, make, columns: str) -> DataFrame:
    """Calls ``make`` with each plan's rows, by (_first, _then)."""
    kind = chunks.schema[by].dataType.simpleString()
    length = F.col("length") if "length" in chunks.columns else F.length(F.coalesce("compressed_text", F.lit("")))
    slim = chunks.select(by, "source_order", "_first", "_then", length.alias("length"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["_first", "_then"], kind="stable")
        return pd.DataFrame(
            {by: rows[by].to_numpy(), "source_order": rows["source_order"].to_numpy(), "length": rows["length"].to_numpy()} | make(rows["length"].tolist())
        )

    return slim.groupBy(by).applyInPandas(run, f"{by} {kind}, source_order long, length int, {columns}")


def distribute(chunks: DataFrame, by: str, buckets: int, how: str = "balanced") -> DataFrame:
    """(by, source_order, length, bucket) with a given number of buckets; ``chunks`` comes from ``selection.ordered``."""
    spread = {"balanced": balanced, "sequential": sequential}[how]
    return _by_group(chunks, by, lambda lengths: {"bucket": spread(lengths, buckets)}, "bucket int")


def plan_chunks(chunks: DataFrame, by: str, settings: QuizSettings) -> DataFrame:
    """(by, source_order, length, batch_number, question_count, estimated_chars); batch 0 holds what is left out for want of questions."""

    def make(lengths: list[int]) -> dict:
        made = plan(lengths, settings)
        return dict(zip(("batch_number", "question_count", "estimated_chars"), map(list, zip(*made, strict=True)), strict=True))

    return _by_group(chunks, by, make, "batch_number int, question_count int, estimated_chars int")


def batches(planned: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """(by, batch_number, question_count, chunk_count, estimated_chars, source_files): one row a batch, files in order of appearance."""
    joined = planned.where("batch_number > 0").join(chunks.select("source_order", F.col("file_name").alias("_file"), "_first", "_then"), "source_order")
    files = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("_first", "_then", "_file"))), lambda x: x["_file"]))
    return joined.groupBy(by, "batch_number").agg(
        F.max("question_count").alias("question_count"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.max("estimated_chars").alias("estimated_chars"),
        files.alias("source_files")
    )


def questions_of(rank: Column, used: Column, target: int, most: int) -> Column:
    """Questions of the bucket at ``rank`` (from 0) of ``used`` buckets, in closed form."""
    given = F.least(F.lit(target), used * most)
    return F.floor(given / used).cast("int") + F.when(rank < given % used, 1).otherwise(0)


def queue_metrics(batch_rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row: planned questions, parsed batches, the next pending batch (the first of that state), source files and bytes."""
    none = F.lit(None).cast("long")
    rows = batch_rows.select(
        F.col("question_count").cast("long").alias("q"),
        (F.col("status") == "parsed").alias("done"),
        F.when(F.col("status") == "pending", F.col("batch_number").cast("long")).alias("next"),
        none.alias("bytes"),
        F.lit(0).alias("file")
    )
    sizes = files.select(
        none.alias("q"),
        F.lit(False).alias("done"),
        none.alias("next"),
        F.col("file_size").cast("long").alias("bytes"),
        F.lit(1).alias("file")
    )
    return rows.unionByName(sizes).agg(
        F.sum("q").alias("planned_questions"),
        F.count_if("done").alias("parsed_batches"),
        F.min("next").alias("next_pending"),
        F.sum("file").alias("files"),
        F.sum("bytes").alias("source_bytes")
    )


def next_pending(batch_rows: DataFrame) -> DataFrame:
    return batch_rows.where("status = 'pending'").agg(F.min("batch_number").alias("batch_number"))


def prepared_note(planned: Column, questions: Column, settings: QuizSettings) -> Column:
    """What a run says of its prompts, and if its sources need more of them than its questions would."""
    more = planned - max(1, -(-settings.target_questions // settings.questions))
    several = lambda n: F.when(n == 1, "").otherwise("s")
    form = "compact" if settings.response_format == "compact" else "standard"
    rest = f" planned questions at {settings.questions} per prompt in {settings.density.capitalize()} mode using {form} JSON with {settings.options} choices per question and "
    extra = F.concat(F.lit(" Source volume required "), more.cast("string"), F.lit(" extra prompt"), several(more), F.lit(" to keep each batch usable."))
    told = F.concat(
        F.lit("Prepared "),
        planned.cast("string"),
        F.lit(" prompt"),
        several(planned),
        F.lit(" for "),
        questions.cast("string"),
        F.lit(rest),
        F.lit(ORDERINGS.get(settings.ordering, "best-match order")),
        F.lit(".")
    )
    return F.concat(told, F.when(more > 0, extra).otherwise(""))


def new_batches(planned: DataFrame, settings: QuizSettings) -> DataFrame:
    """Planned batches as a queue keeps them: unanswered, with the settings they were planned under."""
    text = lambda x: F.lit(x).cast("string")
    fresh = {
        "response": text(""),
        "prompt_override": text(None),
        "status": text("pending"),
        "added": F.lit(0).cast("long"),
        "duplicates": F.lit(0).cast("long"),
        "notes": F.array().cast("array<string>")
    }
    kept = {
        "difficulty": settings.difficulty,
        "topic_focus": settings.topic_focus,
        "response_format": settings.response_format,
        "question_style": settings.question_style,
        "custom_instructions": settings.custom_instructions
    }
    return planned.withColumns(fresh | {k: text(v) for k, v in kept.items()} | {"option_count": F.lit(settings.options)})


def parsed_batches(batch_rows: DataFrame, outcomes: DataFrame, option_range: str) -> DataFrame:
    """Adds status, added, duplicates, notes and next_pending to (batch_number, question_count), by what came back.

    ``outcomes`` is (batch_number, success, parsed, added, duplicates, skewed, repeated): questions in the response, new
    to the bank and known there, whether positions were skewed, questions with repeated options.  A batch without an
    outcome, or with one that failed, stays pending.
    """
    gap = F.col("parsed") - F.col("question_count")
    target = F.concat(
        F.lit("Accepted "),
        F.col("parsed").cast("string"),
        F.lit(" questions for a target of "),
        F.col("question_count").cast("string"),
        F.lit(" ("),
        F.abs(gap).cast("string")
    )
    repeated = F.concat(
        F.lit("Detected "),
        F.col("repeated").cast("string"),
        F.when(F.col("repeated") == 1, " question").otherwise(" questions"),
        F.lit(" with duplicate option text. Review before export.")
    )
    notes = F.array(
        F.when(gap > 0, F.concat(target, F.lit(" over target)."))).when(gap < 0, F.concat(target, F.lit(" under target)."))),
        F.when(F.col("skewed"), F.lit(f"Detected answer-position skew and redistributed correct options across {option_range}.")),
        F.when(F.col("repeated") > 0, repeated),
    )
    taken = F.coalesce("success", F.lit(False))
    before = batch_rows.drop("status", "added", "duplicates", "notes")
    rows = before.join(outcomes, "batch_number", "left").withColumn("status", F.when(taken, "parsed").otherwise("pending"))
    told = F.when(taken, F.filter(notes, lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>"))
    return rows.select(
        *before.columns,
        "status",
        *(F.when(taken, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("added", "duplicates")),
        told.alias("notes")
    )
