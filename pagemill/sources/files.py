"""Source files: intake, dispatch by format, limits and status, as a table of paths and sizes before any byte is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.jsstr import js_round, lookup
from pagemill.operators.running import running
from pagemill.settings import Limits

# fixed values
SUPPORTED = r"(?i)\.(pdf|docx|png|jpe?g|webp|gif|bmp|tiff?)$"
TOO_MANY = "Skipped because max file limit was reached."
UNSUPPORTED = "Unsupported file type (PDF, DOCX, and common image files only)."
LOW_TEXT = "Very little extractable text found."
NO_FILES = "Upload at least one PDF, DOCX, or image before generating a prompt."
NO_TEXT = "No valid source text could be extracted from the uploaded PDFs, DOCX files, or images."
STAGES = {
    "idle": "Ready",
    "uploading": "Uploading files",
    "extracting": "Extracting file text",
    "analyzing": "Analyzing and compressing chunks",
    "building_prompt": "Building prompt queue",
    "waiting_for_ai": "Waiting for pasted AI batch output",
    "parsed_success": "Quiz parsed successfully",
    "failed": "Failed"
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, length, modified, content); type and size filters on it reach the scan, content is read last."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.col("modificationTime").alias("modified"), "content")


def intake(files: DataFrame) -> DataFrame:
    """The first of files with the same name, size and time of change."""
    same = ["file_name", "file_size", "modified"]
    first = files.groupBy(*same).agg(F.min("file_index").alias("file_index"))
    return files.join(first.select("file_index"), "file_index", "left_semi")


def file_format(name: Column, mime: Column | None = None) -> Column:
    kind = F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    low = F.lower(F.coalesce(name, F.lit("")))
    docx = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    return F.when((kind == "application/pdf") | low.endswith(".pdf"), "pdf").when((kind == docx) | low.endswith(".docx"), "docx").otherwise("image")


def supported(name: Column, mime: Column | None = None) -> Column:
    kind = F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    return F.coalesce(name, F.lit("")).rlike(SUPPORTED) | kind.startswith("image/") | kind.isin(
        "application/pdf",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    )


def rejected(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Adds ``message``: why a file of (file_index, file_name, file_size) is not read, or null; the first reason counts."""
    size = F.concat(F.lit(f"File is too large (>{(limits.max_file_bytes + 524288) // 1048576} MB)."))
    reason = F.when(
        F.col("file_index") >= limits.max_files,
        TOO_MANY
    ).when(~supported(F.col("file_name")), UNSUPPORTED).when(F.col("file_size") > limits.max_file_bytes, size)
    return files.withColumn("message", reason)


def file_totals(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """(file_index, pages, text_length, low_text) over pages with text."""
    filled = pages.where("length(text) > 0")
    return filled.groupBy("file_index").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.length("text")).alias("text_length")
    ).withColumn("low_text", F.col("text_length") < limits.low_text_chars)


def ocr_note(pages: Column) -> Column:
    return F.when(pages > 0, F.concat(F.lit(" OCR used on "), pages.cast("string"), F.when(pages == 1, " page.").otherwise(" pages."))).otherwise("")


def final_state(chunks: Column, warnings: Column, ocr_pages: Column) -> Column:
    """(state, message) of a file that was read."""
    note = ocr_note(ocr_pages)
    count = chunks.cast("string")
    none = F.struct(F.lit("warning").alias("state"), F.concat(F.lit("No usable chunks extracted from this file."), note).alias("message"))
    warned = F.struct(F.lit("warning").alias("state"), F.concat(F.lit("Completed with warning ("), count, F.lit(" chunks)."), note).alias("message"))
    done = F.struct(F.lit("completed").alias("state"), F.concat(F.lit("Completed ("), count, F.lit(" chunks)."), note).alias("message"))
    return F.when(chunks == 0, none).when(F.size(warnings) > 0, warned).otherwise(done)


def run_message(total: Column, chunks: Column, limits: Limits = Limits()) -> Column:  # noqa: B008
    """What stops a run of ``total`` files or, if none, warns of it; null where neither is the case."""
    many = F.concat(
        F.lit("Received "),
        total.cast("string"),
        F.lit(f" files. Only the first {limits.max_files} files were processed to keep performance stable.")
    )
    return F.when(total == 0, NO_FILES).when(chunks == 0, NO_TEXT).when(total > limits.max_files, many)


def progress(done: Column, total: Column) -> Column:
    """Percent of bytes, at least 1."""
    return F.greatest(F.lit(1), js_round(done / total * 100)).cast("int")


def progress_events(files: DataFrame) -> DataFrame:
    """(file_index, processed_files, processed_bytes, total_bytes, percent) after each file, in order of the run's files."""
    sums = {"processed_files": F.lit(1).cast("long"), "processed_bytes": F.col("file_size")}
    rows = running(files.select("file_index", "file_size"), [], [F.asc("file_index")], sums)
    total = files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
    return rows.select(
        "file_index",
        F.col("processed_files").cast("int").alias("processed_files"),
        "processed_bytes",
        F.lit(total).cast("long").alias("total_bytes")
    ).withColumn("percent", progress(F.col("processed_bytes"), F.col("total_bytes")))


def stage_label(stage: Column) -> Column:
    return lookup(stage, STAGES, "Working")
