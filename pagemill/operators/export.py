"""Banks as JSON, CSV and a standalone page's data; lines are built in Spark and ordered by the writer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pagemill.functions import text as T
from pagemill.operators.prompts import labels
from pagemill.operators.responses import standard_json

FIELDS = ("question", "options", "correct_answer", "explanation", "source")


def csv_header(most_options: int) -> str:
    return ",".join(
        [
            "questionIndex",
            "question",
            *(f"option{x}" for x in labels(most_options)[:most_options]),
            "correctAnswer",
            "explanation",
            "sourceFile",
            "sourcePage",
            "sourceChunkId"
        ]
    )


def csv_lines(questions: DataFrame, most_options: int, number: Column) -> DataFrame:
    """(number, line) of each question, short option lists padded with empty cells; nulls are empty cells."""
    cell = lambda c: T.csv_cell(F.coalesce(c.cast("string"), F.lit("")))
    options = [cell(F.try_element_at("options", F.lit(i + 1))) for i in range(most_options)]
    cells = [
        number.cast("string"),
        cell(F.col("question")),
        *options,
        cell(F.col("correct_answer")),
        cell(F.col("explanation")),
        *(cell(F.col(f"source.{x}")) for x in ("file", "page", "chunk_id"))
    ]
    return questions.select(number.alias("number"), F.concat_ws(",", *cells).alias("line"))


def payload_json(questions: DataFrame, order: list[str]) -> DataFrame:
    """One row: the bank in order as compact JSON; a bank is bounded by what one person answers."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*FIELDS).alias("q")))), lambda x: x["q"])
    return questions.agg(listed.alias("_q")).select(standard_json(F.col("_q")).alias("payload"))


def pretty_json(payload: str) -> str:
    """The downloadable form: two blanks of indentation, other scripts as they are."""
    return json.dumps(json.loads(payload), indent=2, ensure_ascii=False)


def storage_key(title: Column, payload: Column) -> Column:
    """Name under which a page keeps its answers, with a hash of the title and the data, so that another bank starts anew."""
    return F.concat(F.lit("quiz-export-state-"), T.fnv1a(F.concat(title, F.lit("|"), payload)))


def html_page(title: Column, payload: Column) -> Column:
    """A plain page that carries the bank as data, under the key of its title and data; presentation and sounds are left to the reader's own template."""
    shown = T.html_escape(title)
    head = F.concat(
        F.lit('<!doctype html>\n<html lang="en">\n<head><meta charset="utf-8"><title>'),
        shown,
        F.lit("</title></head>\n<body>\n<h1>"),
        shown,
        F.lit("</h1>\n")
    )
    return F.concat(
        head,
        F.lit('<script type="application/json" id="quiz" data-key="'),
        storage_key(title, payload),
        F.lit('">'),
        T.script_safe(payload),
        F.lit("</script>\n</body>\n</html>\n")
    )


def csv_text(lines: DataFrame, header: str) -> DataFrame:
    """One row: the header and the lines (number, line) in order, without a newline at the end; a bank is bounded by what one person answers."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("number", "line"))), lambda x: x["line"])
    return lines.agg(listed.alias("_l")).select(F.array_join(F.concat(F.array(F.lit(header)), F.col("_l")), "\n").alias("text"))


def write_csv(lines: DataFrame, header: str, path: str) -> None:
    """Writes (number, line) in order as text files of one folder, by the executors; each file begins with the header.

    Ranges of numbers make the files, whose names are in the order of the ranges; reading them as CSV with a header gives the bank.
    """
    schema = StructType([StructField("value", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            held = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([header, *held] if first else held, pa.string())], ["value"])
            first = False

    lines.repartitionByRange("number").sortWithinPartitions("number").select("line").mapInArrow(run, schema).write.mode("overwrite").text(path)
