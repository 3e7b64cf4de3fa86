"""Problem 5: lines that stand on a large share of one file's pages, and the pages without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.session import broadcast_if_small, cut_lineage, spread

#: Fixed values of the test-data contract.
LEAST_PAGES, LEAST_SHARE = 10, 0.25
#: White space as Unicode has it, but for the blank and the line feed.
_ODD = r"\t\x0B\f\r\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: What collapsing changes: runs of white space within a line, and single white space that is no blank.
_LOOSE = f"[ {_ODD}]{{2,}}|[{_ODD}]"


def line_keys(text: Column) -> Column:
    """The normalized lines of a text as 64-bit hashes, 0 for a blank one; the text is normalized as a whole, once."""
    lines = F.split(F.lower(F.regexp_replace(text, _LOOSE, " ")), "\n", -1)
    return F.transform(F.transform(lines, lambda x: F.trim(x)), lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x)))


def _keys(pages: DataFrame) -> DataFrame:
    """page_id, file_index and the keys of every page that has a line; made once, for counting and for finding."""
    given = spread(pages.where("text is not null").select("page_id", "file_index", "text"))
    return cut_lineage(given.select("page_id", "file_index", line_keys(F.col("text")).alias("_keys")).where(F.exists("_keys", lambda k: k != 0)))


def _frequent(keyed: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """(_file, _key) of the lines that stand on a large share of the pages of a file with pages enough."""
    pages_of = keyed.groupBy("file_index").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= least_pages)
    once = keyed.select("file_index", F.explode(F.array_distinct("_keys")).alias("_key")).where("_key <> 0")
    on_pages = once.groupBy("file_index", "_key").agg(F.count(F.lit(1)).alias("_on"))
    same_file = on_pages["file_index"].eqNullSafe(pages_of["file_index"])
    return on_pages.join(pages_of, same_file).where(F.col("_on") >= F.lit(least_share) * F.col("_pages")).select(on_pages["file_index"].alias("_file"), "_key")


def repeated_lines(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, line_no) of every line to be removed, line_no from 0 over all lines.

    A file is one file_index (pages without one form one file).  Pages with a null or blank text count nowhere
    and lose nothing.  Lines are hashed to 64 bits within their file, counted once a page and aggregated before
    the shuffle, so one file with most pages, or one line on most pages, adds no hot task.
    """
    keyed = _keys(pages)
    frequent = _frequent(keyed, least_pages, least_share)
    lines = keyed.select("page_id", "file_index", F.posexplode("_keys").alias("line_no", "_line")).where("_line <> 0")
    return lines.join(frequent, lines["file_index"].eqNullSafe(frequent["_file"]) & (lines["_line"] == frequent["_key"])).select("page_id", "line_no")


def clean_pages(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, text) of every page without its repeated lines; a null text stays null.

    Texts stay where they are if the files' frequent lines are few: a file has at most as many as four pages have lines.
    """
    frequent = _frequent(_keys(pages), least_pages, least_share).groupBy("_file").agg(F.collect_set("_key").alias("_gone"))
    known = pages.select("page_id", "file_index", "text").join(broadcast_if_small(frequent, 100_000), F.col("file_index").eqNullSafe(F.col("_file")), "left")
    lines = F.arrays_zip(F.split("text", "\n", -1).alias("line"), line_keys(F.col("text")).alias("key"))
    kept = F.transform(F.filter(lines, lambda x: ~F.array_contains("_gone", x["key"])), lambda x: x["line"])
    return known.select("page_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))


def without_lines(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """(page_id, text) of every page without the removed lines; a null text stays null."""
    gone = removed.groupBy("page_id").agg(F.collect_set("line_no").alias("_gone"))
    joined = pages.select("page_id", "text").join(gone, "page_id", "left")
    kept = F.expr("filter(split(text, '\\n', -1), (x, i) -> not array_contains(_gone, i))")
    return joined.select("page_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
