"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (large) or other smaller (small) neighbours are linked to its least neighbour, itself included."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("_low")).select("u", F.least("u", "_low").alias("_low"))
    linked = near.join(least, "u")
    if large:
        made = linked.where("v > u").select(F.col("v").alias("u"), F.col("_low").alias("v"))
    else:
        own = least.where("_low < u").select("u", F.col("_low").alias("v"))
        made = linked.where("v <> _low").select(F.col("v").alias("u"), F.col("_low").alias("v")).unionByName(own)
    return made.where("u <> v").distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the links (u, v), component being its least node.

    Stars of a hub are joined through its least neighbour, an aggregate, so no neighbourhood is gathered in one
    task; joins on a hub are split by adaptive execution.  Each round is written to the checkpoint folder.  Links
    with a null end and of a node to itself are left out.
    """
    edges = cut_lineage(links.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        edges = cut_lineage(_stars(_stars(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
