"""Pages cut into overlapping chunks of whole sentences, with ids and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.jsstr import js_trim, let
from pagemill.operators.running import ranked

# fixed values
TARGET, OVERLAP, LEAST = 1200, 220, 320


def _windows(sentence: Column, target: int, overlap: int) -> Column:
    """Pieces of an over-long sentence; each begins ``target - overlap`` after the last."""
    starts = F.sequence(F.lit(0), F.length(sentence) - 1, F.lit(max(target - overlap, 1)))
    return F.filter(F.transform(starts, lambda at: js_trim(F.substring(sentence, at + 1, F.lit(target)))), lambda s: s != "")


def chunk_array(text: Column, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """The chunks of one text as an array, by a fold over its sentences.

    Kept as they are in the source of these rules: a short buffer before an over-long sentence is dropped, a
    flushed buffer's overlap plus the next sentence may exceed the target, and the last window of an over-long
    sentence may repeat the end of the one before.
    """
    nothing = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("held"), nothing.alias("out"))

    def fold(state: Column, sentence: Column) -> Column:
        held, out = state["held"], state["out"]

        def of(joined: Column) -> Column:
            fits = F.length(joined) <= target
            flush = F.length(held) >= least
            carried = F.when(F.length(held) <= overlap, held).otherwise(F.right(held, F.lit(overlap))) if overlap > 0 else held
            flushed = F.struct(js_trim(F.concat(carried, F.lit(" "), sentence)).alias("held"), F.concat(out, F.array(js_trim(held))).alias("out"))
            windows = F.struct(F.lit("").alias("held"), F.concat(out, _windows(sentence, target, overlap)).alias("out"))
            kept = F.struct(joined.alias("held"), out.alias("out"))
            return F.when(fits, kept).when(flush, flushed).when(F.length(sentence) > target, windows).otherwise(kept)

        return let(F.when(held == "", sentence).otherwise(F.concat(held, F.lit(" "), sentence)), of)

    def finish(state: Column) -> Column:
        last = js_trim(state["held"])
        return F.concat(state["out"], F.when(last == "", nothing).otherwise(F.array(last)))

    return F.when(js_trim(text) == "", nothing).when(text.isNotNull(), F.aggregate(T.chunk_sentences(text), start, fold, finish))


def chunk_pages(pages: DataFrame, focus: str | None = None) -> DataFrame:
    """Chunks of (file_index, file_name, page_seq, page_number, text), scored, with ids that need no global order.

    The order of chunks is (file_index, page_seq, chunk_index); ``with_source_order`` numbers it where asked for.
    A page with a null or blank text gives no chunk.
    """
    cut = pages.where("text is not null").select(
        "file_index",
        "file_name",
        "page_seq",
        "page_number",
        F.posexplode(chunk_array(T.normalize_extracted(F.col("text")))).alias("chunk_index", "raw_text")
    )
    own = T.slug(F.coalesce("file_name", F.lit("")))
    file_id = F.when(own == "", F.concat(F.lit("file-"), (F.col("file_index") + 1).cast("string"))).otherwise(own)
    label = F.when(F.col("page_number").isNull(), "unknown").otherwise(F.concat(F.lit("p"), F.col("page_number").cast("string")))
    number = (F.col("chunk_index") + 1).cast("string")
    return (
        cut.withColumn("_words", T.tokens(F.col("raw_text")))
        .withColumn("score", T.information_score(F.col("raw_text"), F.col("_words")) + T.topic_score(F.col("raw_text"), focus))
        .withColumn("compressed_text", T.compress(F.col("raw_text")))
        .withColumn("estimated_tokens", T.estimated_tokens(F.col("compressed_text")))
        .withColumn("fingerprint", T.fingerprint(T.content_tokens(F.col("_words"))))
        .withColumn("id", F.concat_ws("-", file_id, label, number))
        .withColumn("chunk_id", F.concat_ws("-", file_id, label, F.concat(F.lit("c"), number)))
        .drop("_words")
    )


def with_source_order(chunks: DataFrame) -> DataFrame:
    """Numbers chunks from 0 by (file_index, page_seq, chunk_index), range by range."""
    numbered = ranked(chunks, [], [F.asc("file_index"), F.asc("page_seq"), F.asc("chunk_index")], "source_order")
    return numbered.withColumn("source_order", F.col("source_order") - 1)
