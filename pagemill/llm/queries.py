"""The queries of the training-data problems and, where SQL can tell, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import mixing, near_duplicates, packing, pair_defects, residue, scan_noise, site_lines, tokens
from pagemill.session import read_table as _t

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.scan_noise(_t(spark, d, "pdf_pages"), _t(spark, d, "chunks"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired_texts(_t(spark, d, "pdf_pages"), _t(spark, d, "chunks"))


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_chunks(_t(spark, d, "chunks"), _t(spark, d, "prompt_limits"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p2_batches(spark, d), _t(spark, d, "prompt_limits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_pairs(_t(spark, d, "questions"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_groups(_t(spark, d, "questions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects.pair_defects(_t(spark, d, "questions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(_t(spark, d, "pdf_pages"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.clean_pages(_t(spark, d, "pdf_pages"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_t(spark, d, "documents"))


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_uses(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    shares = mixing.mix_shares(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))
    return shares.withColumns({c: F.round(c, 6) for c in ("target_share", "actual_share")})


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(_t(spark, d, "documents"))


def p8_corpus(spark: SparkSession, d: str) -> DataFrame:
    return residue.corpus(_t(spark, d, "documents"), ["doc_id", "source", "text"])


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the classifier against weak labels on sources it never saw."""
    _, report = residue.train(_t(spark, d, "documents"))
    return spark.createDataFrame([(k, round(v, 6)) for k, v in report.items()], "measure string, value double")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f for f in (
            p1_found,
            p1_texts,
            p2_batches,
            p2_report,
            p3_found,
            p3_groups,
            p4_found,
            p5_found,
            p5_clean,
            p6_ids,
            p7_uses,
            p7_shares,
            p8_found,
            p8_corpus,
            p8_validation
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            WITH w AS (SELECT question_id, unnest(regexp_extract_all(lower(concat_ws(' ', question, array_to_string(options, ' '))), '[\\p{L}\\p{Nd}\\p{Nl}\\p{No}]+')) AS word FROM questions WHERE question_id IS NOT NULL),
            k AS (SELECT question_id, word, row_number() OVER (PARTITION BY question_id, word) AS k FROM w),
            n AS (SELECT question_id, count(*) AS n FROM w GROUP BY 1),
            c AS (SELECT a.question_id AS question_id_a, b.question_id AS question_id_b, count(*) AS c FROM k a JOIN k b ON a.word = b.word AND a.k = b.k AND a.question_id < b.question_id GROUP BY 1, 2)
            SELECT question_id_a, question_id_b FROM c JOIN n x ON x.question_id = question_id_a JOIN n y ON y.question_id = question_id_b WHERE 2 * c / (x.n + y.n) >= 0.88""",
        "p5_found": """
            WITH pages AS (SELECT page_id, file_index, string_split(text, chr(10)) AS lines FROM pdf_pages WHERE text IS NOT NULL AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
            l AS (SELECT page_id, file_index, unnest(range(len(lines))) AS line_no, lower(trim(regexp_replace(unnest(lines), '\\s+', ' ', 'g'))) AS line FROM pages),
            n AS (SELECT file_index, count(*) AS n FROM pages GROUP BY 1),
            f AS (SELECT file_index, line FROM l JOIN n USING (file_index) WHERE line <> '' AND n >= 10 GROUP BY 1, 2, n HAVING count(DISTINCT page_id) >= 0.25 * n)
            SELECT page_id, CAST(line_no AS INTEGER) AS line_no FROM l JOIN f USING (file_index, line)""",
    }
