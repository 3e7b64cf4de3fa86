"""Ranks inside groups of any size, and slots handed out by rank, without one task holding a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each group is cut by hash into 2 ** SALT_BITS parts, each ranked on its own.
SALT_BITS = 6


def with_salt(df: DataFrame, unique: list[Column], seed: int = 0, bits: int = SALT_BITS) -> DataFrame:
    """Adds ``_hash``, a seeded hash of the unique columns, and ``_salt``, its leading bits."""
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), *unique))
    return hashed.withColumn("_salt", F.shiftrightunsigned("_hash", 64 - bits).cast("int"))


def cells(salted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each group and salt (``_count``), and how many of the group come before (``_before``)."""
    counted = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))


def rank_in_cell(salted: DataFrame, keys: list[str], unique: list[str]) -> DataFrame:
    """Adds ``_rank``, from 0, within group and salt, in the order of the seeded hash."""
    return salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy("_hash", *unique)).cast("long") - 1)
