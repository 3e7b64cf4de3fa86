"""The question bank: quality of answer positions, rebalancing, merging and keyed edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.jsstr import js_trim
from pagemill.operators.running import running

# fixed value: share of one position from which the answers count as skewed
SKEW = 0.6


def correct_position(options: Column, answer: Column) -> Column:
    """The place, from 0, of the first option that is the answer, or -1."""
    return F.coalesce(F.array_position(options, answer), F.lit(0)).cast("int") - 1


def position_counts(questions: DataFrame) -> DataFrame:
    """(position, n) for every position up to the largest number of options, 0 where none is right."""
    rows = questions.select(F.coalesce(F.size("options"), F.lit(0)).alias("k"), correct_position(F.col("options"), F.col("correct_answer")).alias("position"))
    counted = rows.groupBy("k", "position").agg(F.count(F.lit(1)).alias("n"))
    every = counted.agg(F.max("k").alias("k")).where("k > 0").select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("position"))
    sums = counted.where("position >= 0").groupBy("position").agg(F.sum("n").alias("n"))
    return every.join(sums, "position", "left").fillna(0, ["n"])


def has_duplicate_options(options: Column) -> Column:
    plain = F.transform(options, lambda o: F.lower(js_trim(o)))
    return F.coalesce(F.size(F.array_distinct(plain)) < F.size(options), F.lit(False))


def moved_options(options: Column, answer: Column, target: Column) -> Column:
    """The answer's first option at the target place, the others in their order; unchanged if the answer is none of them."""
    at = correct_position(options, answer)
    others = F.filter(options, lambda o, i: i != at)
    moved = F.concat(F.slice(others, F.lit(1), target), F.array(answer), F.slice(others, target + 1, F.size(options)))
    return F.when(at < 0, options).otherwise(moved)


def rebalance(questions: DataFrame, place: Column) -> DataFrame:
    """Moves right answers round the positions; ``place`` is the question's number, with those of the bank before it."""
    target = F.when(F.size("options") > 0, F.pmod(place, F.size("options")).cast("int"))
    return questions.withColumn(
        "options",
        F.when(F.size("options") > 0, moved_options(F.col("options"), F.col("correct_answer"), target)).otherwise(F.col("options"))
    )


def quality_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: position counts before and after, whether they were skewed, questions with options that repeat."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "n"))), lambda x: x["n"])
        return position_counts(df).agg(listed.alias(name)).withColumn("_one", F.lit(1))

    size = before.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(has_duplicate_options(F.col("options"))).alias("duplicate_option_questions")
    ).withColumn("_one", F.lit(1))
    joined = counts(before, "original_counts").join(counts(after, "balanced_counts"), "_one").join(size, "_one")
    width = F.size("original_counts")
    skew = (width > 0) & (F.col("_n") >= width) & (F.array_max("original_counts") / F.col("_n") >= SKEW)
    return joined.select("original_counts", "balanced_counts", F.coalesce(skew, F.lit(False)).alias("skew_detected"), "duplicate_option_questions")


def merged(existing: DataFrame | None, incoming: DataFrame, order: list[str]) -> DataFrame:
    """The bank and what comes in, without questions whose stem stands before; adds ``stem``.

    Stems are compared by letters a-z and digits, so questions in other scripts all have the empty stem and only the
    first stays.  One exchange on the stem; the first of each is an aggregate, not a window over a hot stem.
    """
    rows = incoming.withColumn("_side", F.lit(1)) if existing is None else existing.withColumn("_side", F.lit(0)).unionByName(
        incoming.withColumn("_side", F.lit(1))
    )
    rows = rows.withColumn("stem", T.stem_key(F.coalesce("question", F.lit(""))))
    first = rows.groupBy("stem").agg(F.min(F.struct("_side", *order)).alias("_first"))
    same = [rows["stem"] == first["stem"], *(rows[c].eqNullSafe(first[f"_first.{c}"]) for c in ("_side", *order))]
    condition = same[0]
    for x in same[1:]:
        condition = condition & x
    return rows.join(first, condition, "left_semi").drop("_side")


def merge_report(existing: DataFrame | None, incoming: DataFrame, order: list[str]) -> DataFrame:
    """One row: questions kept, added (negative if edits made stems of the bank equal) and found to repeat."""
    kept = merged(existing, incoming, order).agg(F.count(F.lit(1)).alias("kept")).withColumn("_one", F.lit(1))
    sides = incoming.select(F.lit(1).alias("_new")) if existing is None else existing.select(F.lit(0).alias("_new")).unionByName(
        incoming.select(F.lit(1).alias("_new"))
    )
    sizes = sides.agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_new") == 0).alias("_old")).withColumn("_one", F.lit(1))
    return kept.join(sizes, "_one").select("kept", (F.col("kept") - F.col("_old")).alias("added"), (F.col("_all") - F.col("kept")).alias("duplicates"))


def offsets_before(questions: DataFrame, order: list[str]) -> DataFrame:
    """(batch_number, offset): the bank's size before each batch, as the number of stems first seen in earlier ones."""
    rows = questions.withColumn("stem", T.stem_key(F.coalesce("question", F.lit(""))))
    first = rows.groupBy("stem").agg(F.min("batch_number").alias("batch_number")).groupBy("batch_number").agg(F.count(F.lit(1)).alias("_new"))
    every = rows.select("batch_number").distinct().join(first, "batch_number", "left").select("batch_number", F.coalesce("_new", F.lit(0)).alias("_new"))
    totals = running(every, [], [F.asc("batch_number")], {"_held": F.col("_new")})
    return totals.select("batch_number", (F.col("_held") - F.col("_new")).alias("offset"))


def accept_batches(questions: DataFrame) -> DataFrame:
    """All batches of accepted questions, in order, rebalanced against the bank before them and merged.

    The rotation of a batch starts at the bank's size before it and counts also questions that then turn out to repeat.
    """
    keyed = questions.join(offsets_before(questions, ["batch_number", "q_index"]), "batch_number")
    turned = rebalance(keyed, F.col("offset") + F.col("q_index")).drop("offset")
    return merged(None, turned, ["batch_number", "q_index"])


def with_edits(questions: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keyed updates: a field that an edit names replaces the question's; one edit a key."""
    renamed = edits.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    joined = questions.join(renamed, key, "left")
    return joined.withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).drop(*(f"_new_{f}" for f in fields))


def option_counts(questions: DataFrame) -> DataFrame:
    """(option_count) distinct sizes of the options, in order."""
    return questions.where("options is not null").select(F.size("options").alias("option_count")).distinct()
