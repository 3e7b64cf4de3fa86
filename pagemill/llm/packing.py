"""Problem 2: chunks put into batches of fixed capacity with little unused space, planned over counts by length.

Only the histogram of lengths is planned, by best fit over counts in descending length; it has at most as many
rows as the capacity, however many chunks there are.  A chunk alone beyond the capacity is divided into full
pieces and a rest.  Pieces then take the planned slots by their rank within length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.ranks import cells, rank_in_cell, with_salt

#: Characters a token stands for where a chunk has no estimate of its own.
CHARS_PER_TOKEN = 4


def best_fit(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, rank after the last, first bin, items of this length a bin), bins counted from 0.

    Bins with the same room are handled as ranges, so the work grows with distinct lengths and rooms, not items.
    """
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    slots, bins = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not ranges[room]:
                insort(rooms, room)
            ranges[room].append((first, n))

    for length, count in sorted(zip(lengths, counts, strict=True), reverse=True):
        rank = 0
        if not length:
            slots.append((0, 0, count, 0, count))
            bins = max(bins, 1)
            continue
        while rank < count and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, n = ranges[room].pop()
            if not ranges[room]:
                rooms.pop(at)
            each = min(room // length, count - rank)
            use = min(n, (count - rank) // each)
            slots.append((length, rank, rank + use * each, first, each))
            rank += use * each
            leave(room, first + use, n - use)
            leave(room - each * length, first, use)
        each = capacity // length
        for use, own in ((count - rank) // each, each), (1, (count - rank) % each):
            if use and own:
                slots.append((length, rank, rank + use * own, bins, own))
                leave(capacity - own * length, bins, use)
                rank, bins = rank + use * own, bins + use
    return slots


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    slots = best_fit(group["size"].tolist(), group["_n"].tolist(), int(group["capacity"].iloc[0]))
    made = np.array(slots, np.int64).reshape(-1, 5)
    return pd.DataFrame(
        {"limit_id": group["limit_id"].iloc[0], "size": made[:, 0], "_from": made[:, 1], "_to": made[:, 2], "_bin": made[:, 3], "_each": made[:, 4]}
    )


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """(source_order, _own, tokens, chars) of each chunk once; ``_own`` is null but for a null source_order.

    Characters are those of compressed_text, or of raw_text where that is null or blank.  Tokens are
    estimated_tokens, or a quarter of the characters, rounded up, where that is null or not positive.  Rows
    delivered again count once; of differing rows with one key the larger sizes count.  Rows without a key are told
    apart by their content, the hash of which is ``_own``.
    """
    used = F.when(F.length(F.trim("compressed_text")) > 0, F.col("compressed_text")).otherwise(F.coalesce("raw_text", F.lit("")))
    chars = F.length(used).cast("long")
    tokens = F.when(F.col("estimated_tokens") > 0, F.col("estimated_tokens").cast("long")).otherwise(F.ceil(chars / CHARS_PER_TOKEN))
    content = [c for c in ("id", "chunk_id", "file_name", "page", "raw_text", "compressed_text", "estimated_tokens") if c in chunks.columns]
    parts = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content))  # a hash leaves nulls out
    own = F.when(F.col("source_order").isNull(), F.xxhash64(parts))
    return chunks.select(
        "source_order",
        own.alias("_own"),
        tokens.alias("_t"),
        chars.alias("_c")
    ).groupBy("source_order", "_own").agg(F.max("_t").alias("tokens"), F.max("_c").alias("chars"))


def pack_chunks(chunks: DataFrame, limits: DataFrame, seed: int = 2) -> DataFrame:
    """(limit_id, source_order, piece, pieces, size, batch_number): the batch, from 1, of every piece of every chunk under every limit.

    ``piece`` counts from 0; ``pieces`` is 1 but for a chunk beyond the capacity alone.  A chunk without any text
    has size 0 and goes to the first batch.  Chunks with a null source_order are packed like others, each different
    one on its own.  Limits with a null or non-positive capacity or an unknown unit give no rows.
    """
    sizes = chunk_sizes(chunks)
    known = limits.where("capacity > 0").select(
        "limit_id",
        F.lower(F.trim("unit")).alias("unit"),
        F.col("capacity").cast("long")
    ).where("unit in ('tokens', 'chars')")
    by_unit = sizes.select("source_order", "_own", F.expr("stack(2, 'tokens', tokens, 'chars', chars) as (unit, whole)"))
    cut = by_unit.join(known, "unit").withColumn("pieces", F.greatest(F.ceil(F.col("whole") / F.col("capacity")), F.lit(1)).cast("long"))
    pieces = cut.select(
        "limit_id",
        "capacity",
        "source_order",
        "_own",
        "pieces",
        "whole",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")
    )
    pieces = pieces.withColumn("size", F.least(F.col("capacity"), F.col("whole") - F.col("piece") * F.col("capacity"))).drop("whole")
    keys = ["limit_id", "size"]
    salted = with_salt(pieces, [F.col("source_order"), F.col("piece"), F.col("_own")], seed)
    places = cells(salted.select("limit_id", "size", "_salt"), keys)
    histogram = places.groupBy(*keys).agg(F.sum("_count").alias("_n")).join(known.select("limit_id", "capacity"), "limit_id")
    plan = histogram.groupBy("limit_id").applyInPandas(_plan, "limit_id int, size long, _from long, _to long, _bin long, _each long")
    slots = places.join(plan, keys).where("_from < _before + _count and _to > _before").drop("_count")
    placed = rank_in_cell(salted, keys, ["source_order", "piece", "_own"]).join(slots, [*keys, "_salt"]).withColumn("_at", F.col("_rank") + F.col("_before"))
    placed = placed.where("_at >= _from and _at < _to")
    number = F.col("_bin") + F.floor((F.col("_at") - F.col("_from")) / F.col("_each")) + 1
    return placed.select("limit_id", "source_order", "piece", "pieces", "size", number.cast("long").alias("batch_number"))


def packing_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, batches, least_batches, fill): how many batches were made, the fewest that could hold all, the share of space used."""
    batches = packed.groupBy("limit_id", "batch_number").agg(F.sum("size").alias("_used"))
    per = batches.groupBy("limit_id").agg(F.count(F.lit(1)).alias("batches"), F.sum("_used").alias("_used"), F.max("_used").alias("fullest"))
    joined = per.join(limits.select("limit_id", F.col("capacity").cast("long")), "limit_id")
    return joined.select(
        "limit_id",
        "batches",
        F.ceil(F.col("_used") / F.col("capacity")).alias("least_batches"),
        "fullest",
        (F.col("_used") / (F.col("batches") * F.col("capacity"))).alias("fill")
    )
