"""Every query of the question pipeline by name; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.jsstr import collapse
from pagemill.operators import bank, chunking, export, planning, prompts, recognition, responses, selection
from pagemill.operators.running import ranked
from pagemill.plans.sql import ORACLES
from pagemill.session import read_table as _t
from pagemill.session import broadcast_if_small, cut_lineage, spread
from pagemill.settings import Limits, QuizSettings
from pagemill.sources import files
from pagemill.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "top_chunks"
FOCUS = "river the port"
#: Buckets of the plain packing queries, and finite budgets of the budgeted selection.
BUCKETS = 4
BUDGETS = Limits(max_total_chunks=120, max_prompt_chars=20_000)
SETTINGS = QuizSettings(
    target_questions=40,
    questions_per_prompt=5,
    topic_focus="port",
    question_style="scenario",
    custom_instructions="Keep it short.\n\nNo trick questions."
)
COMPACT_SETTINGS = QuizSettings(target_questions=40, questions_per_prompt=5, response_format="compact", option_count=5, difficulty="mixed")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return spread(_t(s, d, "pdf_pages").select("page_id", "file_index", "file_name", "page_seq", "page_number", "text"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Each chunk of the table once, with its fingerprint; a missing score counts as 0."""
    columns = ["source_order", "id", "chunk_id", "file_name", "page", "raw_text", "compressed_text", "score"]
    whole = selection.once(_t(s, d, "chunks"), "source_order").select(*columns)
    return selection.with_fingerprint(whole.withColumn("score", F.coalesce("score", F.lit(0.0))))


def _in_runs(s: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """Chunks with the run of their file: as many files as one run takes, by their index; -1 for files that no page has."""
    named = _t(s, d, "pdf_pages").where("file_name is not null and file_index is not null").groupBy("file_name").agg(F.min("file_index").alias("_file"))
    run = F.floor(F.col("_file") / Limits().max_files).cast("int")
    return chunks.join(broadcast_if_small(named, 100_000), "file_name", "left").withColumn("run", F.coalesce(run, F.lit(-1))).drop("_file")


def _questions(s: SparkSession, d: str) -> DataFrame:
    return spread(_t(s, d, "questions").where("question_id is not null"))


def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return _pages(s, d).select("page_id", T.normalize_extracted(F.col("text")).alias("text"))


def tokenize_stats(s: SparkSession, d: str) -> DataFrame:
    words = _pages(s, d).select("page_id", T.tokens(F.col("text")).alias("w"))
    return words.select(
        "page_id",
        F.size("w").alias("tokens"),
        F.size(F.array_distinct("w")).alias("distinct_tokens"),
        F.size(T.content_tokens(F.col("w"))).alias("content_tokens")
    ).where("tokens >= 0")


def sentence_split(s: SparkSession, d: str) -> DataFrame:
    flat = _pages(s, d).where("text is not null").select("page_id", collapse(F.col("text")).alias("t"))
    return flat.select("page_id", F.size(T.sentences(F.col("t"))).alias("sentences"), F.size(T.chunk_sentences(F.col("t"))).alias("chunk_sentences"))


def sentence_scores(s: SparkSession, d: str) -> DataFrame:
    parts = _chunks(s, d).select("source_order", F.posexplode(T.sentences(collapse(F.col("raw_text")))).alias("i", "sentence"))
    return parts.select("source_order", "i", F.round(T.sentence_score(F.col("sentence")), 6).alias("score"))


def chunk_pages(s: SparkSession, d: str) -> DataFrame:
    pages = _pages(s, d).where("text is not null").select(
        "page_id",
        F.posexplode(chunking.chunk_array(T.normalize_extracted(F.col("text")))).alias("chunk_index", "chunk")
    )
    return pages.select("page_id", "chunk_index", "chunk")


def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    docs = spread(_t(s, d, "documents").where("text is not null").select("doc_id", "text"))
    cut = docs.select("doc_id", F.explode(chunking.chunk_array(T.normalize_extracted(F.col("text")))).alias("chunk"))
    return cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.max(F.length("chunk")).alias("longest"))


def top_chunks(s: SparkSession, d: str) -> DataFrame:
    """Pages to chunks, scored and without duplicates; the ten best by score."""
    slim = chunking.chunk_pages(_pages(s, d)).select(
        "file_index",
        "page_seq",
        "chunk_index",
        "id",
        "chunk_id",
        "score",
        "fingerprint",
        F.length("raw_text").alias("chars")
    )
    best = selection.winners(chunking.with_source_order(slim), carry=("chunk_id", "score", "chars"))
    return best.orderBy(F.desc("score"), "source_order").limit(10).select("chunk_id", F.round("score", 6).alias("score"), "chars")


def chunk_ids(s: SparkSession, d: str) -> DataFrame:
    made = chunking.with_source_order(chunking.chunk_pages(_pages(s, d)).select("file_index", "page_seq", "chunk_index", "id", "chunk_id"))
    return made.select("source_order", "id", "chunk_id")


def info_scores(s: SparkSession, d: str) -> DataFrame:
    rows = _chunks(s, d).where("raw_text is not null").withColumn("w", T.tokens(F.col("raw_text")))
    return rows.select("source_order", F.round(T.information_score(F.col("raw_text"), F.col("w")), 6).alias("score"))


def fingerprints(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select("source_order", "fingerprint")


def compress_chunks(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).where("raw_text is not null").select(
        "source_order",
        T.compress(F.col("raw_text")).alias("compressed")
    ).withColumn("tokens", T.estimated_tokens(F.col("compressed")))


def topic_scores(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).where("raw_text is not null").select("source_order", T.topic_score(F.col("raw_text"), FOCUS).alias("points"))


def file_totals(s: SparkSession, d: str) -> DataFrame:
    return files.file_totals(_pages(s, d))


def source_files(s: SparkSession, d: str) -> DataFrame:
    """The files of the folder of tables, by name and size, no byte of them read."""
    return files.read_files(s, d).where("length > 0").select("file_name", "length")


def low_text_files(s: SparkSession, d: str) -> DataFrame:
    """The warning of each file with very little text."""
    return files.file_totals(_pages(s, d)).where("low_text").select("file_index", "text_length", F.lit(files.LOW_TEXT).alias("warning"))


def run_failures(s: SparkSession, d: str) -> DataFrame:
    """What stops or warns of each run of files: too many of them in one, or no chunk in the end."""
    named = _t(s, d, "file_status").groupBy("file_index").agg(F.max("chunks").alias("chunks"))
    runs = named.groupBy(F.floor(F.col("file_index") / 100).cast("int").alias("run")).agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")
    )
    return runs.select("run", files.run_message(F.col("files"), F.col("chunks")).alias("message"))


def ocr_fallback(s: SparkSession, d: str) -> DataFrame:
    """Pages with a short text layer take recognised text, until recognition breaks in their file."""
    pages = _pages(s, d).where("text is not null and file_index is not null")
    whole = T.normalize_extracted(F.col("text"))
    layer = F.when(F.col("page_id") % 3 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    given = pages.select(
        "page_id",
        "file_index",
        "page_seq",
        layer.alias("layer"),
        whole.alias("ocr_text"),
        (F.col("page_id") % 5 > 0).alias("ocr_usable"),
        (F.col("page_id") % 31 == 0).alias("ocr_failed")
    )
    return recognition.ocr_fallback(given).select("page_id", "text", "from_ocr")


def file_filter_status(s: SparkSession, d: str) -> DataFrame:
    once = _t(s, d, "file_status").groupBy("file_index").agg(F.max(F.struct("file_name", "file_size")).alias("f")).select("file_index", "f.*")
    ranked = files.rejected(once)
    return ranked.select("file_index", files.file_format(F.col("file_name")).alias("format"), "message", T.format_bytes(F.col("file_size")).alias("size"))


def file_formats(s: SparkSession, d: str) -> DataFrame:
    """The format of each file by its media type or its name, and whether it is read; every other name has lost its extension."""
    once = _t(s, d, "file_status").groupBy("file_index").agg(F.max("file_name").alias("file_name"))
    kinds = F.array(
        *map(F.lit, ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "image/png", "text/plain")),
        F.lit(None)
    )
    rows = once.select(
        "file_index",
        F.when(F.col("file_index") % 2 == 0, F.regexp_replace("file_name", r"\.\w+$", "")).otherwise(F.col("file_name")).alias("name"),
        F.get(kinds, F.col("file_index") % 5).alias("mime")
    )
    return rows.select(
        "file_index",
        files.file_format(F.col("name"), F.col("mime")).alias("format"),
        files.supported(F.col("name"), F.col("mime")).alias("supported")
    )


def stage_labels(s: SparkSession, d: str) -> DataFrame:
    """The label of each state that files are in."""
    return _t(s, d, "file_status").select(F.lower(F.trim("state")).alias("state")).distinct().select("state", files.stage_label(F.col("state")).alias("label"))


def intake_files(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "file_status").select("file_index", "file_name", "file_size", F.col("updated_at").alias("modified"))
    return files.intake(rows.distinct()).select("file_index", "file_name", "file_size")


def file_states(s: SparkSession, d: str) -> DataFrame:
    """The final state of each file from its chunks and warnings, by the rules of a finished run."""
    once = _t(s, d, "file_status").where("chunks is not null").select(
        "file_index",
        "chunks",
        F.coalesce(F.size("warnings"), F.lit(0)).alias("n")
    ).groupBy("file_index").agg(F.max("chunks").alias("chunks"), F.max("n").alias("n"))
    made = once.withColumn("w", F.array_repeat(F.lit("w"), F.greatest(F.col("n"), F.lit(0))))
    return made.select("file_index", files.final_state(F.col("chunks"), F.col("w"), F.lit(0)).alias("f")).select("file_index", "f.state", "f.message")


def progress_events(s: SparkSession, d: str) -> DataFrame:
    once = _t(s, d, "file_status").groupBy("file_index").agg(F.max(F.coalesce("file_size", F.lit(0))).alias("file_size"))
    return files.progress_events(once)


def dedupe_within_file(s: SparkSession, d: str) -> DataFrame:
    return selection.winners(_chunks(s, d), ["file_name"]).select("source_order", "position")


def dedupe_global(s: SparkSession, d: str) -> DataFrame:
    return selection.winners(_chunks(s, d)).select("source_order", "position")


def chunks_per_file(s: SparkSession, d: str) -> DataFrame:
    return selection.winners(_chunks(s, d), ["file_name"]).groupBy("file_name").agg(F.count(F.lit(1)).alias("chunks"))


def _selectable(s: SparkSession, d: str) -> DataFrame:
    return selection.winners(_chunks(s, d), carry=("id", "file_name", "score"))


def top_chunks_per_file(s: SparkSession, d: str) -> DataFrame:
    return selection.best_of_file(_selectable(s, d), 5).select("file_name", "source_order", "file_rank")


def coverage_selection(s: SparkSession, d: str) -> DataFrame:
    return selection.cover(_selectable(s, d))


def compression_note(s: SparkSession, d: str) -> DataFrame:
    """How many chunks are left of all after selection, and what the run says of it."""
    slim = cut_lineage(_selectable(s, d))
    before, after = slim.count(), selection.cover(slim).count()
    return s.createDataFrame([(before, after, selection.compression_warning(before, after))], "deduped long, selected long, warning string")


def coverage_selection_budget(s: SparkSession, d: str) -> DataFrame:
    chunks = _in_runs(
        s,
        d,
        selection.dedupe(_chunks(s, d)).select(
            "source_order",
            "id",
            "file_name",
            "score",
            "position",
            F.coalesce("compressed_text", F.lit("")).alias("compressed_text")
        )
    )
    return selection.cover_within(chunks, BUDGETS, "run").select("run", "source_order", "covers")


def order_best_match(s: SparkSession, d: str) -> DataFrame:
    """Each file's chunks ranked by score."""
    slim = _chunks(s, d).select("source_order", "file_name", "score", F.col("source_order").alias("position"))
    return selection.best_of_file(slim).select("source_order", "file_rank")


def order_random(s: SparkSession, d: str) -> DataFrame:
    return selection.ordered(_chunks(s, d), "random", 7).select("source_order", F.col("_first").alias("order_key"))


def order_page(s: SparkSession, d: str) -> DataFrame:
    """Each file's chunks in order of their pages, whatever order they were delivered in."""
    return ranked(
        _t(s, d, "chunks").where("source_order is not null").select("file_name", "source_order").distinct(),
        ["file_name"],
        [F.asc("source_order")],
        "page_rank"
    ).select("source_order", "page_rank")


def _spread(s: SparkSession, d: str, ordering: str, how: str) -> DataFrame:
    return planning.distribute(_in_runs(s, d, selection.ordered(_chunks(s, d), ordering)), "run", BUCKETS, how).select("run", "source_order", "bucket")


def pack_balanced(s: SparkSession, d: str) -> DataFrame:
    return _spread(s, d, "best_match", "balanced")


def pack_sequential(s: SparkSession, d: str) -> DataFrame:
    return _spread(s, d, "page_order", "sequential")


def batch_plan(s: SparkSession, d: str) -> DataFrame:
    """The prompt batches of every run, with their files in order of appearance."""
    chunks = cut_lineage(
        _in_runs(s, d, selection.ordered(_chunks(s, d))).select(
            "run",
            "source_order",
            "file_name",
            F.length(F.coalesce("compressed_text", F.lit(""))).alias("length"),
            "_first",
            "_then"
        )
    )
    made = planning.batches(planning.plan_chunks(chunks, "run", SETTINGS), chunks, "run")
    return made.withColumn("source_files", F.array_join("source_files", "|", "<null>"))


def question_allocation(s: SparkSession, d: str) -> DataFrame:
    """Questions of each bucket of the balanced packing of every run."""
    used = pack_balanced(s, d).select("run", "bucket").distinct()
    ranks = used.withColumn(
        "r",
        F.row_number().over(Window.partitionBy("run").orderBy("bucket")) - 1
    ).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run")))
    return ranks.select("run", "bucket", planning.questions_of(F.col("r"), F.col("n"), 7, 3).alias("questions"))


def new_batches(s: SparkSession, d: str) -> DataFrame:
    """The existing plan as a queue of unanswered batches."""
    made = planning.new_batches(_t(s, d, "prompt_batches").select("batch_number", "question_count"), SETTINGS)
    return made.withColumn("notes", F.size("notes"))


def char_budgets(s: SparkSession, d: str) -> DataFrame:
    """Questions and characters of a prompt under every density and format, for numbers of questions in and out of range."""
    asked = [-3.0, 0.4, 0.5, 2.5, *map(float, range(1, 101)), 250.0]
    made = [
        (
            q,
            density,
            form,
            QuizSettings(questions_per_prompt=q, density=density, response_format=form)
        ) for q in asked for density in ("light", "standard", "dense") for form in ("standard", "compact")
    ]
    return s.createDataFrame(
        [(q, density, form, x.questions, x.char_budget) for q, density, form, x in made],
        "asked double, density string, format string, questions int, chars int"
    )


def prepared_notes(s: SparkSession, d: str) -> DataFrame:
    """What each run says of its prompts."""
    runs = batch_plan(s, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("question_count").alias("q"))
    return runs.select("run", planning.prepared_note(F.col("n"), F.col("q"), SETTINGS).alias("note"))


def queue_metrics(s: SparkSession, d: str) -> DataFrame:
    batches = _t(s, d, "prompt_batches").select(
        "batch_number",
        "question_count",
        F.when(F.col("batch_number") % 3 == 0, "parsed").otherwise("pending").alias("status")
    )
    sizes = _t(s, d, "file_status").groupBy("file_index").agg(F.max("file_size").alias("file_size"))
    return planning.queue_metrics(batches, sizes)


def source_packets(s: SparkSession, d: str) -> DataFrame:
    """The packets of the existing batches."""
    rows = _t(s, d, "prompt_batches").select("batch_number", F.posexplode(F.array_distinct("chunk_ids")).alias("place", "id"))
    first = _chunks(s, d).groupBy("id").agg(F.min("source_order").alias("source_order"))
    chunks = _chunks(s, d).select("source_order", "page", "file_name", "chunk_id", "compressed_text")
    return prompts.source_packets(rows.join(first, "id").join(chunks, "source_order"), ["batch_number"], ["place"])


def master_prompts(s: SparkSession, d: str) -> DataFrame:
    counts = _t(s, d, "prompt_batches").select("batch_number", F.coalesce("question_count", F.lit(5)).alias("question_count"))
    rows = source_packets(s, d).join(counts, "batch_number")
    return prompts.master_prompts(rows, SETTINGS, None, F.concat(F.lit("Batch "), F.col("batch_number").cast("string"))).select("batch_number", "prompt")


def prompt_queue(s: SparkSession, d: str) -> DataFrame:
    """The prompts of the existing batches in the compact format with five options, with the last questions accepted; every tenth is overridden."""
    table = _t(s, d, "prompt_batches")
    override = F.when(F.col("batch_number") % 10 == 0, F.concat(F.lit("My own prompt "), F.col("batch_number").cast("string")))
    rows = source_packets(s, d).join(
        table.select("batch_number", F.coalesce("question_count", F.lit(5)).alias("question_count"), override.alias("prompt_override")),
        "batch_number"
    )
    bank_rows = _questions(s, d).where("question is not null").select("question_id", "question")
    return prompts.prompt_queue(rows, table.count(), COMPACT_SETTINGS, bank_rows, ["question_id"])


def count_advice(s: SparkSession, d: str) -> DataFrame:
    """What is advised for each existing batch by the questions that came back for it."""
    back = _questions(s, d).groupBy("batch_number").agg(F.count(F.lit(1)).alias("back"))
    rows = _t(s, d, "prompt_batches").where("question_count is not null").join(back, "batch_number")
    return rows.select("batch_number", prompts.count_advice(F.col("question_count") - F.col("back"), SETTINGS).alias("advice"))


def _grouped(s: SparkSession, d: str) -> DataFrame:
    """(response, i, the question's fields): three questions a response."""
    rows = _questions(s, d).select(F.floor(F.col("question_id") / 3).cast("long").alias("response"), "question_id", *export.FIELDS)
    return rows


def _compact_question(q, index):
    """A question as a list of five, its index written by ``index`` from the right option's place."""
    inner = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    source = [inner(q["source"][c]) for c in ("file", "page", "chunk_id")]
    options = F.coalesce(F.to_json(q["options"]), F.lit("null"))
    parts = [
        inner(q["question"]),
        options,
        index(bank.correct_position(q["options"], q["correct_answer"])),
        inner(q["explanation"]),
        F.concat(F.lit("["), F.concat_ws(",", *source), F.lit("]"))
    ]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _responses(s: SparkSession, d: str) -> DataFrame:
    """Standard responses of three questions, in seven ways: plain, fenced, with a number page, with words around, cut off, empty, and compact."""
    asked = F.transform(F.sort_array(F.collect_list(F.struct("question_id", F.struct(*export.FIELDS).alias("q")))), lambda x: x["q"])
    rows = _grouped(s, d).groupBy("response").agg(asked.alias("q")).withColumn("raw", responses.standard_json(F.col("q")))
    compact = F.concat(
        F.lit('{"questions":['),
        F.array_join(F.transform("q", lambda q: _compact_question(q, lambda place: place.cast("string"))), ","),
        F.lit("]}")
    )
    kind = F.col("response") % 7
    made = (
        F.when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), F.col("raw"), F.lit("\n```\nDone.")))
        .when(kind == 2, F.regexp_replace("raw", r'"page":"(\d{1,9})"', r'"page":$1'))
        .when(kind == 3, F.concat(F.lit("Sure. "), F.col("raw"), F.lit(" That is all.")))
        .when(kind == 4, F.expr("left(raw, length(raw) - 2)"))
        .when(kind == 5, F.lit(" "))
        .when(kind == 6, compact)
        .otherwise(F.col("raw"))
    )
    return rows.select("response", made.alias("raw"))


def _compact_responses(s: SparkSession, d: str) -> DataFrame:
    """Compact responses of three questions; the index is a number, fenced, a letter, a number as text, or out of range."""
    asked = F.transform(F.sort_array(F.collect_list(F.struct("question_id", F.struct(*export.FIELDS).alias("q")))), lambda x: x["q"])
    rows = _grouped(s, d).groupBy("response").agg(asked.alias("q"))
    kind = F.col("response") % 5

    def index(place):
        letter = F.when(place >= 0, F.char(place + 97)).otherwise(place.cast("string"))
        quoted = F.concat(F.lit('"'), F.when(kind == 2, letter).otherwise(place.cast("string")), F.lit('"'))
        return F.when(kind == 4, "9").when(kind.isin(2, 3), quoted).otherwise(place.cast("string"))

    listed = F.array_join(F.transform("q", lambda q: _compact_question(q, index)), ",")
    raw = F.concat(F.lit('{"questions":['), listed, F.lit("]}"))
    return rows.select("response", F.when(kind == 1, F.concat(F.lit("```\n"), raw, F.lit("\n```"))).otherwise(raw).alias("raw"))


def parse_standard(s: SparkSession, d: str) -> DataFrame:
    rows = responses.accepted_questions(_responses(s, d), "response")
    return rows.select("response", "q_index", "question", F.array_join("options", "|").alias("options"), "correct_answer", F.col("source.page").alias("page"))


def parse_compact(s: SparkSession, d: str) -> DataFrame:
    rows = responses.accepted_questions(_compact_responses(s, d), "response", "compact")
    return rows.select("response", "q_index", "question", F.array_join("options", "|").alias("options"), "correct_answer", F.col("source.page").alias("page"))


def compact_errors(s: SparkSession, d: str) -> DataFrame:
    """Every message of every compact response that is not accepted."""
    parsed = responses.parse_responses(_compact_responses(s, d), "response", "compact")
    return parsed.where("not success").select("response", F.array_join("errors", "\n").alias("errors"))


def parse_errors(s: SparkSession, d: str) -> DataFrame:
    """Every message of every response that is not accepted."""
    parsed = responses.parse_responses(_responses(s, d), "response")
    return parsed.where("not success").select("response", F.array_join("errors", "\n").alias("errors"))


def correct_index(s: SparkSession, d: str) -> DataFrame:
    """The index that values of several kinds stand for, with four options."""
    value = F.expr(
        "CASE pmod(q_index, 4) WHEN 0 THEN cast(pmod(question_id, 7) - 1 as string) WHEN 1 THEN concat('\"', char(cast(97 + pmod(question_id, 6) as int)), '\"') WHEN 2 THEN concat('\"', pmod(question_id, 6), '\"') ELSE concat(pmod(question_id, 5), '.5') END"
    )
    rows = _questions(s, d).where("q_index is not null").select("question_id", F.try_parse_json(value).alias("v"))
    return rows.select("question_id", responses.correct_index(F.col("v"), 4).alias("correct_index"))


def rebalance_answers(s: SparkSession, d: str) -> DataFrame:
    rows = bank.rebalance(_questions(s, d), F.col("question_id"))
    return rows.select("question_id", F.array_join("options", "|", "<null>").alias("options"))


def position_histogram(s: SparkSession, d: str) -> DataFrame:
    return bank.position_counts(_questions(s, d))


def quality_report(s: SparkSession, d: str) -> DataFrame:
    before = _questions(s, d)
    made = bank.quality_report(before, bank.rebalance(before, F.col("question_id")))
    return made.select(
        F.array_join("original_counts", ",").alias("original_counts"),
        F.array_join("balanced_counts", ",").alias("balanced_counts"),
        "skew_detected",
        "duplicate_option_questions"
    )


def duplicate_options(s: SparkSession, d: str) -> DataFrame:
    """Questions with options that repeat, in a bank where every fifth has its first option again, with blanks round it, as its second."""
    again = F.concat(F.slice("options", 1, 1), F.array(F.concat(F.lit(" "), F.col("options")[0], F.lit(" "))), F.slice("options", 3, 99))
    rows = _questions(s, d).withColumn("options", F.when((F.col("question_id") % 5 == 0) & (F.size("options") > 1), again).otherwise(F.col("options")))
    return rows.where(bank.has_duplicate_options(F.col("options"))).select("question_id")


def merge_bank(s: SparkSession, d: str) -> DataFrame:
    return bank.merged(None, _questions(s, d), ["question_id"]).select("question_id", "stem")


def merge_report(s: SparkSession, d: str) -> DataFrame:
    rows = _questions(s, d)
    old = F.col("batch_number") <= 20
    return bank.merge_report(rows.where(old), rows.where(~F.coalesce(old, F.lit(False))), ["question_id"])


def accept_batches(s: SparkSession, d: str) -> DataFrame:
    """The bank after all batches: rotation by the bank's size before each, the first of each stem."""
    rows = _questions(s, d).where("batch_number is not null").withColumn("q_index", F.col("question_id").cast("int"))
    return bank.accept_batches(rows).select("question_id", F.array_join("options", "|", "<null>").alias("options"))


def batch_notes(s: SparkSession, d: str) -> DataFrame:
    """The existing batches after the questions of the bank came back: status, new and known questions, notes; every seventh batch failed."""
    rows = _questions(s, d).where("batch_number is not null")
    stem = T.stem_key(F.coalesce("question", F.lit("")))
    first = rows.groupBy(stem.alias("_stem")).agg(F.min("batch_number").alias("_first"))
    size = F.size("options")
    place = bank.correct_position(F.col("options"), F.col("correct_answer"))
    same = rows.select(
        "batch_number",
        stem.alias("_stem"),
        F.coalesce(size, F.lit(0)).alias("k"),
        place.alias("place"),
        bank.has_duplicate_options(F.col("options")).cast("int").alias("repeated")
    )
    new = same.groupBy("batch_number", "_stem").agg(F.count(F.lit(1)).alias("n")).join(first, "_stem").groupBy("batch_number").agg(
        F.sum((F.col("_first") == F.col("batch_number")).cast("long")).alias("added")
    )
    counts = same.groupBy("batch_number").agg(F.count(F.lit(1)).alias("parsed"), F.max("k").alias("k"), F.sum("repeated").alias("repeated"))
    most = same.where("place >= 0").groupBy("batch_number", "place").agg(F.count(F.lit(1)).alias("n")).groupBy("batch_number").agg(F.max("n").alias("most"))
    outcomes = counts.join(new, "batch_number").join(most, "batch_number", "left")
    skewed = F.coalesce((F.col("parsed") >= F.col("k")) & (F.col("most") / F.col("parsed") >= bank.SKEW), F.lit(False))
    outcomes = outcomes.select(
        "batch_number",
        (F.col("batch_number") % 7 > 0).alias("success"),
        "parsed",
        "added",
        (F.col("parsed") - F.col("added")).alias("duplicates"),
        skewed.alias("skewed"),
        "repeated"
    )
    made = planning.parsed_batches(_t(s, d, "prompt_batches").where("question_count is not null").select("batch_number", "question_count"), outcomes, "A-D")
    return made.withColumn("notes", F.array_join("notes", " "))


def option_counts(s: SparkSession, d: str) -> DataFrame:
    return bank.option_counts(_questions(s, d))


def choice_texts(s: SparkSession, d: str) -> DataFrame:
    """How the options of each batch are described: their numbers, and the labels of the longest list."""
    sizes = _questions(s, d).where("batch_number is not null and size(options) > 0").groupBy("batch_number").agg(
        F.sort_array(F.collect_set(F.size("options"))).alias("n")
    )
    return sizes.select("batch_number", T.choice_text(F.col("n")).alias("text"), T.option_range(F.array_max("n")).alias("labels"))


def sample_questions(s: SparkSession, d: str) -> DataFrame:
    """The questions of a made-up response in the compact format, read back in the standard mode."""
    return responses.accepted_questions(responses.sample_responses(s, 40, "compact"), "raw").select(
        "q_index",
        "question",
        F.array_join("options", "|").alias("options"),
        "correct_answer",
        F.col("source.page").alias("page")
    )


def keyed_edits(s: SparkSession, d: str) -> DataFrame:
    edits = _questions(s, d).where("question_id % 10 = 0").select("question_id", F.lit("Edited.").alias("explanation"))
    return bank.with_edits(_questions(s, d).select("question_id", "question", "explanation"), edits, "question_id", ["explanation"])


def export_csv_lines(s: SparkSession, d: str) -> DataFrame:
    return export.csv_lines(_questions(s, d), 5, F.col("question_id") + 1)


def export_json(s: SparkSession, d: str) -> DataFrame:
    """The payload of each batch as one JSON text."""
    rows = _questions(s, d).where("batch_number is not null")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("question_id", F.struct(*export.FIELDS).alias("q")))), lambda x: x["q"])
    return rows.groupBy("batch_number").agg(responses.standard_json(listed).alias("payload"))


def storage_key_hash(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).where("question is not null").select("question_id", T.fnv1a(F.col("question")).alias("hash"))


def storage_keys(s: SparkSession, d: str) -> DataFrame:
    """The names under which pages of each batch keep their answers."""
    return export_json(s, d).select("batch_number", export.storage_key(F.lit("Quiz"), F.col("payload")).alias("key"))


def html_pages(s: SparkSession, d: str) -> DataFrame:
    """A page of each batch."""
    title = F.concat(F.lit("Quiz <"), F.col("batch_number").cast("string"), F.lit("> & \"more\""))
    return export_json(s, d).select("batch_number", export.html_page(title, F.col("payload")).alias("page"))


def text_escapes(s: SparkSession, d: str) -> DataFrame:
    rows = _questions(s, d).where("explanation is not null")
    return rows.select(
        "question_id",
        T.html_escape(F.col("explanation")).alias("html"),
        T.script_safe(F.col("explanation")).alias("script"),
        T.slug(F.coalesce("source.file", F.lit(""))).alias("slug")
    )


def quiz_state(s: SparkSession, d: str) -> DataFrame:
    return sessions.answers(sessions.clean_events(_t(s, d, "quiz_events")))


def miss_marks(s: SparkSession, d: str) -> DataFrame:
    return sessions.miss_marks(sessions.clean_events(_t(s, d, "quiz_events")))


def missed_summary(s: SparkSession, d: str) -> DataFrame:
    return sessions.missed_summary(sessions.clean_events(_t(s, d, "quiz_events")))


def next_missed(s: SparkSession, d: str) -> DataFrame:
    return sessions.next_missed(sessions.clean_events(_t(s, d, "quiz_events")))


def next_question(s: SparkSession, d: str) -> DataFrame:
    """The next question of a quiz of each batch, null at its end."""
    rows = _questions(s, d).where("batch_number is not null and q_index is not null").select("batch_number", "q_index").distinct()
    return sessions.next_question(rows, "batch_number")


def state_snapshot(s: SparkSession, d: str) -> DataFrame:
    """What is saved of each learner: answers and miss marks as JSON lists of pairs."""
    return sessions.snapshots(sessions.clean_events(_t(s, d, "quiz_events")))


def restored_states(s: SparkSession, d: str) -> DataFrame:
    """Saved answers and marks as they come back for a bank in which every question has four options."""
    events = sessions.clean_events(_t(s, d, "quiz_events"))
    whole = [F.col(c).cast("double").alias(c) for c in ("q_index", "attempts", "marks")]
    saved = sessions.answers(events).join(sessions.miss_marks(events), sessions.KEYS, "full").select("learner", "selected", "correct", *whole)
    bank_rows = _questions(s, d).where("q_index is not null").select("q_index").distinct().withColumn("options", F.array(*map(F.lit, "ABCD")))
    return sessions.restored(saved, bank_rows)


def question_states(s: SparkSession, d: str) -> DataFrame:
    return sessions.question_states(sessions.clean_events(_t(s, d, "quiz_events"))).select("learner", "q_index", "status", "locked")


def _histogram(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").groupBy("p_brand", F.col("p_size").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def otsu_threshold(s: SparkSession, d: str) -> DataFrame:
    return recognition.otsu_threshold(_histogram(s, d), ["p_brand"])


def histogram_percentile(s: SparkSession, d: str) -> DataFrame:
    low = recognition.histogram_percentile(_histogram(s, d), 0.02, ["p_brand"]).withColumnRenamed("value", "low")
    return low.join(recognition.histogram_percentile(_histogram(s, d), 0.98, ["p_brand"]).withColumnRenamed("value", "high"), "p_brand")


def _pixels(s: SparkSession, d: str) -> DataFrame:
    colour = lambda c: F.pmod(c, F.lit(256))
    return _t(s, d, "part").select(
        "p_brand",
        F.col("p_partkey").alias("place"),
        colour(F.col("p_size") * 5).alias("red"),
        colour(F.col("p_partkey") * 7).alias("green"),
        colour(F.col("p_size") * 11).alias("blue")
    )


def contrast(s: SparkSession, d: str) -> DataFrame:
    return recognition.contrast(_pixels(s, d), ["p_brand"])


def contrast_binary(s: SparkSession, d: str) -> DataFrame:
    return recognition.contrast(_pixels(s, d), ["p_brand"], True)


def scale_factors(s: SparkSession, d: str) -> DataFrame:
    """How much images of these widths are enlarged before recognition."""
    return _t(s, d, "part").select("p_partkey", F.round(recognition.scale_factor(F.col("p_size") * 53), 6).alias("factor"))


def _recognised(s: SparkSession, d: str, confidence) -> DataFrame:
    """Pages as recognition output, with confidences of words derived from their length."""
    pages = _pages(s, d).where("text is not null").select("page_id", "text", confidence(F.pmod("page_id", F.lit(50))).alias("confidence"))
    word = lambda w: F.struct(w.alias("text"), (F.lit(30.0) + F.length(w) * 5).alias("confidence"), (F.length(w) % 2 == 0).alias("in_dictionary"))
    return recognition.page_quality(pages.withColumn("words", F.transform(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""), word)))


def ocr_quality(s: SparkSession, d: str) -> DataFrame:
    """How usable each page is as recognition output."""
    return _recognised(s, d, lambda k: F.lit(40.0) + k).select("page_id", "usable", F.round("quality_score", 6).alias("quality_score"))


def best_attempts(s: SparkSession, d: str) -> DataFrame:
    """The better of two attempts at each page."""
    first, second = _recognised(s, d, lambda k: F.lit(40.0) + k), _recognised(s, d, lambda k: F.lit(90.0) - k)
    return recognition.best_attempt(first, second, "page_id").select(
        "page_id",
        "confidence",
        "usable",
        F.length("text").alias("chars"),
        F.round("quality_score", 6).alias("quality_score")
    )


QUERIES: list[Query] = [
    normalize_text, tokenize_stats, sentence_split, sentence_scores, chunk_pages, chunk_documents, top_chunks, chunk_ids, info_scores, fingerprints, compress_chunks, topic_scores, source_files, file_totals, low_text_files, run_failures, ocr_fallback, file_filter_status, file_formats, stage_labels, intake_files, file_states,
    progress_events, dedupe_within_file, dedupe_global, chunks_per_file, top_chunks_per_file, coverage_selection, compression_note, coverage_selection_budget, order_best_match, order_page, order_random, pack_balanced, pack_sequential, batch_plan, new_batches, char_budgets, prepared_notes, question_allocation, queue_metrics,
    source_packets, master_prompts, prompt_queue, count_advice, parse_standard, parse_compact, compact_errors, parse_errors, correct_index, rebalance_answers, position_histogram, quality_report, duplicate_options, merge_bank, merge_report, accept_batches, batch_notes, option_counts, choice_texts, sample_questions, keyed_edits, export_csv_lines,
    export_json, storage_key_hash, storage_keys, html_pages, text_escapes, quiz_state, miss_marks, missed_summary, next_missed, next_question, state_snapshot, restored_states, question_states, otsu_threshold, histogram_percentile, contrast, contrast_binary, scale_factors, ocr_quality, best_attempts,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return ORACLES
