"""Problem 7: documents of several sources combined so that each source has its share of all tokens.

The total of a mix is the largest at which no source must be used beyond its ``max_repeats``.  A source's budget
is met by whole passes over all its documents and, for the rest of the budget, a subset of them, planned over the
counts of documents by exact token length: a proportional draft, then a bounded knapsack over what is left.
Documents then take the planned uses by their seeded rank within source and length.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.ranks import cells, rank_in_cell, with_salt
from pagemill.llm.tokens import VOCABULARY, count_tokens
from pagemill.session import broadcast_if_small, cut_lineage

#: Tokens up to which the rest of a budget is left to the exact knapsack; what is beyond is drafted over counts first, so
#: that the knapsack's work doesn't grow with the budget.  With many different lengths the sum still comes as near the budget
#: as counts allow; with very few it may miss that by less than the greatest length.
KNAPSACK = 1 << 15


def nearest_subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes as near as possible to the budget, by dynamic programming.

    A bit of ``reach`` stands for a sum; each length's count is split into powers of two.  Sums up to the budget
    plus the greatest length are looked at, so that a sum over it may win.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return taken
    width = budget + min(int(lengths.max()), budget) + 1
    mask, steps, reach = (1 << width) - 1, [], 1
    for i in np.argsort(-lengths):
        left, power = min(int(counts[i]), width // int(lengths[i])), 1
        while left > 0 and not reach >> budget & 1:
            step = min(power, left)
            steps.append((int(i), step, reach))
            reach |= reach << step * int(lengths[i]) & mask
            left, power = left - step, power * 2
        if reach >> budget & 1:
            break
    below = (reach & (1 << budget + 1) - 1).bit_length() - 1
    above = reach >> budget + 1
    over = budget + 1 + (above & -above).bit_length() - 1 if above else width * 2
    at = below if budget - below <= over - budget else over
    for i, step, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += step
            at -= step * int(lengths[i])
    return taken


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int, knapsack: int = KNAPSACK) -> tuple[int, np.ndarray]:
    """Whole passes over all documents, and how many documents of each length are used once more."""
    total = int((lengths * counts).sum())
    passes = min(most, budget // total) if total else 0
    rest = budget - passes * total
    if not total or passes == most or not rest:
        return passes, np.zeros(len(lengths), np.int64)
    draft = (counts * (rest / total)).astype(np.int64)
    gap = rest - int((draft * lengths).sum())
    for i in np.argsort(-lengths):  # what rounding down left over, but for the knapsack's part
        more = min(int(counts[i] - draft[i]), max(0, gap - knapsack) // int(lengths[i]))
        draft[i] += more
        gap -= more * int(lengths[i])
    for i in np.argsort(lengths):  # room for the knapsack to choose in
        if gap >= min(rest, 4 * int(lengths.max()), knapsack):
            break
        back = min(int(draft[i]), -(-(min(rest, 4 * int(lengths.max()), knapsack) - gap) // int(lengths[i])))
        draft[i] -= back
        gap += back * int(lengths[i])
    return passes, draft + nearest_subset(lengths, counts - draft, gap)


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = group["n_tokens"].to_numpy(np.int64), group["_docs"].to_numpy(np.int64)
    passes, extra = fit_budget(lengths, counts, int(group["_budget"].iloc[0]), int(group["_most"].iloc[0]))
    return pd.DataFrame({"mix_name": group["mix_name"], "source": group["source"], "n_tokens": lengths, "_docs": counts, "_passes": passes, "_extra": extra})


def clean_source(name: str) -> F.Column:
    return F.lower(F.trim(F.col(name)))


def plan_mix(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uses planned by mix, source and length; the targets with what is there and the budget).

    ``sizes`` has (source, n_tokens, _docs), the number of documents by exact length, and is far smaller than the documents.
    """
    there = sizes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("_docs")).alias("_tokens"))
    mix = Window.partitionBy("mix_name")
    goals = (
        targets.join(there, "source", "left")
        .withColumn("_most", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("long"))
        .withColumn("_usable", (F.coalesce("_tokens", F.lit(0)) > 0) & (F.col("_most") > 0) & (F.coalesce("weight", F.lit(0.0)) > 0))
        .withColumn("target_share", F.col("weight") / F.sum("weight").over(mix))
        .withColumn("_share", F.when(F.col("_usable"), F.col("weight") / F.sum(F.when(F.col("_usable"), F.col("weight"))).over(mix)))
        .withColumn("_total", F.min(F.col("_tokens") * F.col("_most") / F.col("_share")).over(mix))
        .withColumn("_budget", F.round(F.col("_share") * F.col("_total")).cast("long"))
    )
    wanted = goals.where("_usable").select("mix_name", "source", "_budget", "_most")
    plan = (
        sizes.where("n_tokens > 0")
        .join(broadcast_if_small(wanted), "source")
        .groupBy("mix_name", "source")
        .applyInPandas(_fit, "mix_name string, source string, n_tokens long, _docs long, _passes long, _extra long")
    )
    return plan, goals


def _prepared(documents: DataFrame, targets: DataFrame, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    goals = targets.select(F.col("mix_name"), clean_source("source").alias("source"), F.col("weight").cast("double"), F.col("max_repeats"))
    goals = goals.groupBy("mix_name", "source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    named = goals.select("source").distinct()
    docs = documents.select("doc_id", clean_source("source").alias("source"), "text").join(broadcast_if_small(named), "source", "left_semi")
    return cut_lineage(count_tokens(docs, ["doc_id", "source"], vocabulary=vocabulary)), goals


def mix_uses(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """(mix_name, doc_id, source, n_tokens, uses) of every document of a mix's sources, 0 uses included.

    Sources are compared in lower case without outer blanks; rows with a null source belong to no mix.  A source
    without documents, or with a null or zero weight, takes no part and the others share its weight.  Texts
    without a token are never used.  Repeated rows count as documents of their own.
    """
    sized, goals = _prepared(documents, targets, vocabulary)
    salted = with_salt(sized, [F.col("doc_id")], seed)
    keys = ["source", "n_tokens"]
    places = cells(salted, keys)
    sizes = places.groupBy(*keys).agg(F.sum("_count").alias("_docs"))
    plan, _ = plan_mix(sizes, goals)
    slots = places.join(plan.drop("_docs"), keys).select(*keys, "_salt", "mix_name", "_passes", (F.col("_extra") - F.col("_before")).alias("_first"))
    ranked = rank_in_cell(salted, keys, ["doc_id"])
    used = ranked.join(slots, [*keys, "_salt"]).withColumn("uses", F.col("_passes") + (F.col("_rank") < F.col("_first")).cast("long"))
    empty = sized.where("n_tokens = 0").join(broadcast_if_small(goals.select("mix_name", "source")), "source").withColumn("uses", F.lit(0).cast("long"))
    columns = ["mix_name", "doc_id", "source", "n_tokens", "uses"]
    idle_goals = goals.join(plan.select("mix_name", "source").distinct(), ["mix_name", "source"], "left_anti").select("mix_name", "source")
    idle = sized.where("n_tokens > 0").join(idle_goals, "source").withColumn("uses", F.lit(0).cast("long"))
    return used.select(columns).unionByName(empty.select(columns)).unionByName(idle.select(columns))


def mix_shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(mix_name, source, weight, target_share, documents, tokens, actual_share) of every target; 0 for a source without documents."""
    sized, goals = _prepared(documents, targets, vocabulary)
    sizes = sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("_docs"))
    plan, budgets = plan_mix(sizes, goals)
    tokens = F.sum(F.col("n_tokens") * (F.col("_passes") * F.col("_docs") + F.col("_extra")))
    used = F.sum(F.when(F.col("_passes") > 0, F.col("_docs")).otherwise(F.col("_extra")))
    got = plan.groupBy("mix_name", "source").agg(tokens.alias("tokens"), used.alias("documents"))
    joined = budgets.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents"])
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mix_name"))
    return joined.withColumn("actual_share", share).select("mix_name", "source", "weight", "target_share", "documents", "tokens", "actual_share")
