"""Duplicate chunks removed, and chunks chosen so that every file is covered before the best of the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators.running import ranked
from pagemill.session import broadcast_if_small, cut_lineage
from pagemill.settings import UNLIMITED, Limits


def once(table: DataFrame, key: str) -> DataFrame:
    """One row of each key of a table read from files, the first by place in the files; rows without a key are left out.

    Only the key is read to find keys that repeat, and only these are joined, so whole rows don't travel to be told apart.
    """
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
    keyed = table.where(F.col(key).isNotNull())
    repeated = keyed.select(key, place.alias("_p")).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_p").alias("_first")
    ).where("_n > 1").select(key, "_first")
    joined = keyed.withColumn("_p", place).join(broadcast_if_small(repeated, 200_000), key, "left")
    return joined.where(F.col("_first").isNull() | (F.col("_first") == F.col("_p"))).drop("_p", "_first")


def with_fingerprint(chunks: DataFrame) -> DataFrame:
    """Adds the fingerprint of raw_text; a null text has the empty one."""
    words = T.tokens(F.coalesce("raw_text", F.lit("")))
    return chunks.withColumn("_words", words).withColumn("fingerprint", T.fingerprint(T.content_tokens(F.col("_words")))).drop("_words")


def winners(chunks: DataFrame, within: list[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(within, source_order, position, carry): the best chunk of each fingerprint, the first of equals, and the fingerprint's first place.

    ``chunks`` has source_order, id, score and fingerprint.  Chunks with an empty fingerprint count by id, and the
    last of them stays.  One exchange: winner and first place come from one aggregate over slim columns, which combines
    before the shuffle, so a fingerprint shared by most rows makes no hot task.
    """
    key = F.when(F.col("fingerprint") == "", F.concat(F.lit("id "), F.col("id"))).otherwise(F.concat(F.lit("fp "), F.col("fingerprint")))
    # the largest struct wins: score, then the earlier place; for an empty fingerprint the later place alone
    rank = F.when(F.col("fingerprint") == "", F.struct(F.lit(0.0).alias("a"), F.col("source_order").alias("b"))).otherwise(
        F.struct(F.coalesce("score", F.lit(float("-inf"))).alias("a"), (-F.col("source_order")).alias("b"))
    )
    groups = [*(within or []), "_key", "_key2"]
    own = [*(within or []), "source_order", *(c for c in carry if c not in (within or []))]
    keyed = chunks.select(*own, F.xxhash64(key).alias("_key"), F.hash(key).alias("_key2"), rank.alias("_rank"))
    best = keyed.groupBy(*groups).agg(
        F.max(F.struct("_rank", *(c for c in own if c not in (within or [])))).alias("_best"),
        F.min("source_order").alias("position")
    )
    return best.select(*(within or []), *(f"_best.{c}" for c in own if c not in (within or [])), "position")


def dedupe(chunks: DataFrame, within: list[str] | None = None) -> DataFrame:
    """The whole rows of the winners, with ``position``: one join on source_order, by which texts are chosen last."""
    return chunks.join(winners(chunks, within).select("source_order", "position"), "source_order")


def best_of_file(chunks: DataFrame, k: int = UNLIMITED) -> DataFrame:
    """Each file's chunks with ``file_rank`` up to k, by score, then position.

    A top k is cut before the shuffle; a full ranking goes by ranges, as one file may hold most chunks.
    """
    order = [F.desc("score"), F.asc("position")]
    if k < UNLIMITED:
        rank = F.row_number().over(Window.partitionBy("file_name").orderBy(*order))
        return chunks.withColumn("file_rank", rank).where(F.col("file_rank") <= k)
    return ranked(chunks, ["file_name"], order, "file_rank").withColumn("file_rank", F.col("file_rank").cast("int"))


def cover(chunks: DataFrame) -> DataFrame:
    """(source_order, covers): selection without budgets of (source_order, id, file_name, score, position).

    Each file's best chunk covers it; of every other id, the best chunk fills up.  Two aggregates over slim rows; the
    texts of the chosen are for the caller to join.  The order of the result is (score descending, covers descending, position).
    """
    slim = cut_lineage(chunks.select("source_order", "id", "file_name", "score", "position"))
    place = F.struct("score", (-F.col("position")).alias("p"), F.col("source_order").alias("o"))
    firsts = slim.groupBy("file_name").agg(F.max(place)["o"].alias("source_order")).select("source_order", F.lit(True).alias("covers"))
    by_id = slim.join(broadcast_if_small(firsts, 100_000), "source_order", "left").groupBy("id").agg(
        F.max("covers").alias("_covered"),
        F.max(place)["o"].alias("source_order")
    )
    filling = by_id.where("_covered is null").select("source_order", F.lit(False).alias("covers"))
    return firsts.unionByName(filling)


def compression_warning(before: int, after: int) -> str | None:
    """What a run says if its selection left chunks out."""
    return f"Compressed source set from {before} to {after} chunks to fit the planned prompt set." if before > after else None


def cover_within(chunks: DataFrame, limits: Limits, by: str = "run") -> DataFrame:
    """Selection under finite budgets for each run in ``by``: the file's best chunks first, then by score, skipping what does not fit.

    Only (source_order, id, file_name, score, position, length) of a run meet in a task, in order of the fold; a run
    has at most ``max_files`` files of ``max_file_bytes`` each.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(file_name=group["file_name"].fillna("\x00"))
        rows = group.sort_values(["score", "position"], ascending=[False, True], kind="stable")
        firsts = rows.drop_duplicates("file_name")
        seen = group.groupby("file_name")["position"].min()
        used, chosen, chars = set(), [], 0

        def offer(items: pd.DataFrame, covers: bool) -> Iterator[tuple]:
            nonlocal chars
            for r in items.itertuples(index=False):
                if not covers and r.id in used:
                    continue
                if len(chosen) >= limits.max_total_chunks or chars + r.length > limits.max_prompt_chars:
                    continue
                chosen.append(r.source_order)
                used.add(r.id)
                chars += r.length
                yield r.source_order, covers

        made = [*offer(firsts.assign(_s=firsts["file_name"].map(seen)).sort_values("_s"), True)]
        made += offer(rows, False)
        return pd.DataFrame({by: group[by].iloc[0], "source_order": [a for a, _ in made], "covers": [c for _, c in made]})

    kind = chunks.schema[by].dataType.simpleString()
    slim = chunks.select(by, "source_order", "id", "file_name", "score", "position", F.length("compressed_text").alias("length"))
    return slim.groupBy(by).applyInPandas(fold, f"{by} {kind}, source_order long, covers boolean")


def ordered(chunks: DataFrame, ordering: str = "best_match", seed: int = 1) -> DataFrame:
    """Adds ``_first`` and ``_then``, by which chunks are planned; random order is seeded by id and place."""
    first = {
        "page_order": F.col("source_order").cast("double"),
        "random": F.xxhash64(F.lit(seed), "id", "source_order").cast("double")
    }.get(ordering, -F.col("score"))
    return chunks.withColumn("_first", first).withColumn("_then", F.col("position") if "position" in chunks.columns else F.col("source_order"))
