"""Ranks and running totals over groups of any size, or over a whole table, with no task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import broadcast_if_small, cut_lineage


def running(rows: DataFrame, by: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Adds the running total, the row's own included, of each of ``totals`` within ``by`` (all rows if empty), in ``order``.

    Rows are cut into ranges of (by, order), so a group that holds most rows is spread over many; totals are taken
    within a range, and what the ranges before it hold is added: a few sums a range.  Null keys form groups of their
    own.  ``order`` has to be unique within ``by`` for a defined result.
    """
    named = rows.withColumns({f"_own_{k}": c for k, c in totals.items()})
    placed = cut_lineage(named.repartitionByRange(*(F.col(c).asc() for c in by), *order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy(*by, "_part").agg(*(F.sum(f"_own_{k}").alias(f"_sum_{k}") for k in totals))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        *(F.col(c).alias(f"_by_{c}") for c in by),
        F.col("_part").alias("_at"),
        *(F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in totals)
    )
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = placed.join(broadcast_if_small(before), same)
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = joined.withColumns({k: F.col(f"_before_{k}") + F.sum(f"_own_{k}").over(inside) for k in totals})
    return made.select(*rows.columns, *totals)


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row, from 1, within ``by`` in ``order``."""
    return running(rows, by, order, {name: F.lit(1).cast("long")})
