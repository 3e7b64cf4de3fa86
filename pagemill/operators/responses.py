"""Responses parsed and validated as VARIANT columns: one bad question rejects the whole response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.jsstr import js_trim, let

# fixed values: messages
EMPTY = "Paste the AI JSON output before parsing."
NO_JSON = "JSON parse error: not one JSON value"
BAD_INDEX = "Compact JSON uses an invalid correct answer index."
_FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
_NUMBER = r"^(?:BIGINT|DOUBLE|DECIMAL.*)$"


def candidate_json(raw: Column) -> Column:
    """The first code fence's content if there is one, then from the first opening to the last closing brace."""

    def braces(text: Column) -> Column:
        end = F.length(text) - F.instr(F.reverse(text), "}") + 1
        cut = F.substring(text, F.instr(text, "{"), end - F.instr(text, "{") + 1)
        return F.when((F.instr(text, "{") > 0) & (F.instr(text, "}") > 0) & (end > F.instr(text, "{")), cut).otherwise(text)

    def unfenced(text: Column) -> Column:
        return let(js_trim(F.regexp_extract(text, _FENCE, 1)), lambda inner: let(F.when(inner != "", inner).otherwise(text), braces))

    return let(js_trim(F.coalesce(raw, F.lit(""))), unfenced)


def parse_json(text: Column) -> Column:
    """A VARIANT of strict JSON, or null; what follows a value makes it invalid."""
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(F.try_variant_get(both, "$", "array<variant>"), lambda items: F.when(F.size(items) == 1, items[0]))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _text_or_number(v: Column) -> Column:
    number = F.regexp_replace(F.try_variant_get(v, "$", "string"), r"\.0$", "")
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(_kind(v).rlike(_NUMBER), number)


def correct_index(value: Column, options: int) -> Column:
    """The place of the right option from a VARIANT: a number from 0, the number of options for the last, or a letter; else null."""
    number = F.when(_kind(value).rlike(_NUMBER), F.try_variant_get(value, "$", "double"))
    word = F.upper(js_trim(_text(value)))
    digits = F.when(word.rlike("^[0-9]+$"), word.cast("double"))
    plain = F.coalesce(number, digits)
    by_number = F.when((plain >= 0) & (plain < options), plain).when((plain >= 1) & (plain <= options), plain - 1)
    whole = F.when(by_number == F.floor(by_number), by_number.cast("int"))
    letter = F.when(F.length(word) == 1, F.ascii(word) - 65)
    return F.when((letter >= 0) & (letter < options), letter).otherwise(whole)


def _at(i: Column, path: str, message: str) -> Column:
    return F.concat(F.lit("questions."), i.cast("string"), F.lit(f".{path}: {message}"))


def _missing(i: Column, value: Column, path: str, message: str) -> Column:
    """A message if a text is absent, of another type or empty."""
    return F.when(value.isNull(), _at(i, path, "Required")).when(value == "", _at(i, path, message))


def _fields(item: Column, paths: dict[str, str], use) -> Column:
    """``use`` of the typed fields of one question; each is read once, in a struct that its lambda binds."""
    read = {k: let(_get(item, p), _text_or_number if k == "page" else _text) for k, p in paths.items() if k not in ("items", "index")}
    read["page"] = js_trim(read["page"])
    read["items"] = F.try_variant_get(item, paths["items"], "array<variant>")
    if "index" in paths:
        read |= {
            "index": _get(item, paths["index"]),
            "five": F.size(F.try_variant_get(item, "$", "array<variant>")),
            "three": F.size(F.try_variant_get(item, "$[4]", "array<variant>"))
        }
    whole = F.struct(*(c.alias(k) for k, c in read.items()))
    return let(whole, lambda f: let(F.transform(f["items"], _text), lambda options: use(f, options)))


def _checked(i: Column, f: Column, options: Column, errors: Column, answer: Column) -> Column:
    """(errors, row) of one question."""
    source = F.struct(
        js_trim(f["file"]).alias("file"),
        F.when(f["page"] == "", "unknown").otherwise(f["page"]).alias("page"),
        js_trim(f["chunk"]).alias("chunk_id")
    )
    row = F.struct(
        i.alias("q_index"),
        js_trim(f["question"]).alias("question"),
        F.transform(options, js_trim).alias("options"),
        js_trim(answer).alias("correct_answer"),
        js_trim(f["explanation"]).alias("explanation"),
        source.alias("source")
    )
    return F.struct(errors.alias("errors"), row.alias("row"))


def _told(*errors: Column) -> Column:
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def _standard(item: Column, i: Column, n: int) -> Column:
    """(errors, row) of a question in the standard format."""

    def use(f: Column, options: Column) -> Column:
        untyped = f["question"].isNull() | f["explanation"].isNull() | f["file"].isNull() | f["chunk"].isNull() | f["page"].isNull() | f["answer"].isNull() | f["items"].isNull() | F.exists(options, lambda o: o.isNull())
        errors = _told(
            _missing(i, f["question"], "question", "question is required"),
            F.when(f["items"].isNull(), _at(i, "options", "Required")).when(F.size(f["items"]) != n, _at(i, "options", f"each question needs {n} options")),
            F.when(F.exists(options, lambda o: o.isNull()), _at(i, "options", "Expected string")).when(
                F.exists(options, lambda o: o == ""),
                _at(i, "options", "options cannot be empty")
            ),
            _missing(i, f["answer"], "correctAnswer", "correctAnswer is required"),
            _missing(i, f["explanation"], "explanation", "explanation is required"),
            _missing(i, f["file"], "source.file", "source.file is required"),
            _missing(i, f["page"], "source.page", "source.page is required"),
            _missing(i, f["chunk"], "source.chunkId", "source.chunkId is required"),
            F.when(~untyped & ~F.array_contains(options, f["answer"]), _at(i, "correctAnswer", "correctAnswer must match one of the options")),
        )
        return _checked(i, f, options, errors, f["answer"])

    paths = {
        "question": "$.question",
        "items": "$.options",
        "answer": "$.correctAnswer",
        "explanation": "$.explanation",
        "file": "$.source.file",
        "page": "$.source.page",
        "chunk": "$.source.chunkId"
    }
    return _fields(item, paths, use)


def _compact(item: Column, i: Column, n: int) -> Column:
    """(errors, row) of a question in the compact format, a list of five."""

    def use(f: Column, options: Column) -> Column:
        early = _told(
            F.when(F.coalesce(f["five"], F.lit(-1)) != 5, F.concat(F.lit("questions."), i.cast("string"), F.lit(": Expected array of 5"))),
            _missing(i, f["question"], "0", "compact question text is required"),
            F.when(f["items"].isNull(), _at(i, "1", "Required")).when(F.size(f["items"]) != n, _at(i, "1", f"compact question needs {n} options")),
            F.when(F.exists(options, lambda o: o.isNull() | (o == "")), _at(i, "1", "compact options cannot be empty")),
            F.when(_text_or_number(f["index"]).isNull(), _at(i, "2", "Invalid input")),
            _missing(i, f["explanation"], "3", "compact explanation is required"),
            F.when(
                (F.coalesce(f["three"], F.lit(-1)) != 3) | (F.coalesce(f["file"], F.lit("")) == "") | (
                    F.coalesce(f["chunk"], F.lit("")) == ""
                ) | f["page"].isNull(),
                _at(i, "4", "Invalid source")
            ),
        )

        def with_index(index: Column) -> Column:
            errors = let(early, lambda told: F.when((F.size(told) == 0) & index.isNull(), F.array(F.lit(BAD_INDEX))).otherwise(told))
            return _checked(i, f, options, errors, F.try_element_at(options, index + 1))

        return let(correct_index(f["index"], n), with_index)

    return _fields(
        item,
        {"question": "$[0]", "items": "$[1]", "index": "$[2]", "explanation": "$[3]", "file": "$[4][0]", "page": "$[4][1]", "chunk": "$[4][2]"},
        use
    )


def _computed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The same rows with all columns but ``keep`` as output of a generator, past which the optimizer copies no expression."""
    made = [c for c in rows.columns if c not in keep]
    return rows.select(*keep, F.inline(F.array(F.struct(*made))))


def verdicts(responses: DataFrame, key: str, response_format: str = "standard", options: int = 4, raw: str = "raw") -> DataFrame:
    """(key, errors, compact, rows): the verdict on each response with its questions, made in its row, without a join.

    In the standard format a response that is only valid in the compact one is taken, and else the standard errors
    are told.  Null and blank responses, invalid JSON and responses without a question have defined errors; keys
    beyond the schema are dropped; the last of repeated keys counts (spark.sql.variant.allowDuplicateKeys).
    """
    nothing = F.array().cast("array<string>")
    rows = _computed(responses.select(key, candidate_json(F.col(raw)).alias("_json")), [key])
    rows = _computed(rows.withColumn("_v", parse_json(F.col("_json"))), [key])

    def judged(check, few: str) -> Column:
        def of(questions: Column) -> Column:
            none = F.when(F.col("_json") == "", F.array(F.lit(EMPTY))).when(F.col("_v").isNull(), F.array(F.lit(NO_JSON))).when(
                questions.isNull(),
                F.array(F.lit("questions: Required"))
            ).when(F.size(questions) == 0, F.array(F.lit(few)))
            told = let(
                F.transform(questions, lambda item, i: check(item, i, options)),
                lambda each: F.struct(F.flatten(F.transform(each, lambda x: x["errors"])).alias("errors"), F.transform(each, lambda x: x["row"]).alias("rows"))
            )
            return let(told, lambda t: F.struct(F.coalesce(none, t["errors"], nothing).alias("errors"), t["rows"].alias("rows")))

        return let(F.try_variant_get("_v", "$.questions", "array<variant>"), of)

    compact = judged(_compact, "questions: compact questions must contain at least 1 item")
    tagged = lambda v, kind: F.struct(v["errors"].alias("errors"), F.lit(kind).alias("compact"), v["rows"].alias("rows"))
    if response_format == "compact":
        verdict = let(compact, lambda c: F.struct(c["errors"].alias("errors"), (F.size(c["errors"]) == 0).alias("compact"), c["rows"].alias("rows")))
    else:
        standard = judged(_standard, "questions: questions must contain at least 1 item")
        otherwise = lambda s: let(compact, lambda c: F.when(F.size(c["errors"]) == 0, tagged(c, True)).otherwise(tagged(s, False)))
        verdict = let(standard, lambda s: F.when(F.size(s["errors"]) == 0, tagged(s, False)).otherwise(otherwise(s)))
    return _computed(rows.select(key, verdict.alias("_verdict")), [key]).select(key, "_verdict.*")


def parse_responses(responses: DataFrame, key: str, response_format: str = "standard", options: int = 4, raw: str = "raw") -> DataFrame:
    """(key, success, errors, compact): the verdict on each response, one row a key; ``compact`` tells in which format it was taken."""
    made = verdicts(responses, key, response_format, options, raw)
    return made.select(key, (F.size("errors") == 0).alias("success"), "errors", "compact")


def accepted_questions(responses: DataFrame, key: str, response_format: str = "standard", options: int = 4, raw: str = "raw") -> DataFrame:
    """(key, q_index, question, options, correct_answer, explanation, source) of the responses that are accepted."""
    return verdicts(responses, key, response_format, options, raw).where(F.size("errors") == 0).select(key, F.inline("rows"))


def standard_json(questions: Column) -> Column:
    """A response in the standard format from an array of question structs."""
    return F.to_json(
        F.struct(
            F.transform(
                questions,
                lambda q: F.struct(
                    q["question"].alias("question"),
                    q["options"].alias("options"),
                    q["correct_answer"].alias("correctAnswer"),
                    q["explanation"].alias("explanation"),
                    F.struct(q["source"]["file"].alias("file"), q["source"]["page"].alias("page"), q["source"]["chunk_id"].alias("chunkId")).alias("source")
                )
            ).alias("questions")
        )
    )


def sample_responses(spark, count: int, response_format: str = "standard", options: int = 4) -> DataFrame:
    """One made-up response with ``count`` questions, the first option right."""
    number = (F.col("id") + 1).cast("string")
    made = [F.concat(F.lit(f"Sample option {chr(65 + k)}"), number) for k in range(options)]
    say = lambda before, after="": F.concat(F.lit(before), number, F.lit(after))
    if response_format == "compact":
        quoted = lambda c: F.to_json(F.array(c))
        inner = lambda c: F.regexp_extract(quoted(c), r"^\[(.*)\]$", 1)
        line = F.concat(
            F.lit("["),
            inner(say("Sample question ", "?")),
            F.lit(","),
            F.to_json(F.array(*made)),
            F.lit(",0,"),
            inner(say("Sample explanation ", ".")),
            F.lit(","),
            F.to_json(F.array(F.lit("Sample.pdf"), number, say("sample-chunk-"))),
            F.lit("]")
        )
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", line.alias("s")))), lambda x: x["s"]), ",")
        return spark.range(count).agg(F.concat(F.lit('{"questions":['), listed, F.lit("]}")).alias("raw"))
    row = F.struct(
        "id",
        say("Sample question ", "?").alias("question"),
        F.array(*made).alias("options"),
        made[0].alias("correct_answer"),
        say("Sample explanation ", ".").alias("explanation"),
        F.struct(F.lit("Sample.pdf").alias("file"), number.alias("page"), say("sample-chunk-").alias("chunk_id")).alias("source")
    )
    return spark.range(count).agg(F.sort_array(F.collect_list(row)).alias("q")).select(standard_json(F.col("q")).alias("raw"))
