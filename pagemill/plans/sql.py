"""The SQL that each query is compared with, written from the rules and for another engine; nothing of the engine is used.

Fragments in capitals are filled in by ``_sql``; lambdas fold lists where the rules are sequential.
"""

from __future__ import annotations

W = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# fixed values: words without content
STOP_WORDS = "the and or to a of in for on with at is are was were be this that an it as by from can will if not but into about".split()
_STOPS = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}+', ' ', 'g'))"


def normal(x: str) -> str:
    joined = f"regexp_replace({x}, '-{W}*\\n{W}*', '', 'g')"
    return f"trim(replace(regexp_replace({joined}, '{W}+', ' ', 'g'), chr(0), ''))"


def tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1)"


def content(x: str) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains({_STOPS}, w))"


def count(x: str, condition: str) -> str:
    return f"len(list_filter({x}, lambda w: {condition}))"


def sentences(x: str) -> str:
    cut = f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]){W}+', '\\1' || chr(1), 'g'), chr(1)), lambda v: trim(v)), lambda v: v <> '')"
    return f"CASE WHEN len({cut}) > 0 THEN {cut} ELSE [trim({x})] END"


def chunk_sentences(x: str) -> str:
    cut = f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]){W}+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda v: trim(v)), lambda v: v <> '')"
    return f"CASE WHEN len({cut}) > 0 THEN {cut} ELSE [{x}] END"


def sentence_score(s: str) -> str:
    c = content(tokens(s))
    return (
        f"(len({c}) + {count(c, 'length(w) >= 7')} * 1.6::DOUBLE + {count(c, chr(39).join(['regexp_matches(w, ', '[0-9]', ')']))} * 1.3::DOUBLE"
        f" + CASE WHEN len({tokens(s)}) > 0 THEN len(regexp_extract_all({s}, '[A-Z]{{2,}}')) ELSE 0 END * 1.8::DOUBLE)"
    )


CHUNKS = """chunk_rows AS (SELECT source_order, any_value(id) AS id, any_value(chunk_id) AS chunk_id, any_value(file_name) AS file_name,
  any_value(page) AS page, any_value(raw_text) AS raw_text,
  any_value(compressed_text) AS compressed_text, coalesce(any_value(score), 0) AS score FROM chunks WHERE source_order IS NOT NULL GROUP BY source_order)"""
FINGERPRINT = f"""prints AS (SELECT *, CASE WHEN n = 0 THEN '' ELSE concat(n, ':', array_to_string(k[1:18], '|'), '::', array_to_string(k[m:m+11],
  '|'), '::', array_to_string(k[greatest(n-11,1):n], '|')) END AS fingerprint
  FROM (SELECT *, len(k) AS n, greatest(1, len(k) // 2 - 5) AS m FROM (SELECT *, {content(tokens("coalesce(raw_text, '')"))} AS k FROM chunk_rows)))"""
KEYED = "keyed AS (SELECT *, CASE WHEN fingerprint = '' THEN 'id ' || id ELSE 'fp ' || fingerprint END AS key FROM prints)"


def deduped(by: str = "") -> str:
    part = f"PARTITION BY {by}key"
    order = "CASE WHEN fingerprint = '' THEN 0 ELSE -score END, CASE WHEN fingerprint = '' THEN -source_order ELSE source_order END"
    return f"deduped AS (SELECT *, min(source_order) OVER ({part}) AS position FROM keyed QUALIFY row_number() OVER ({part} ORDER BY {order}) = 1)"


HEAD = f"WITH {CHUNKS}, {FINGERPRINT}, {KEYED}, "

_CHUNK_FOLD = f"""list_reduce(list_transform(s, lambda v: {{'held': v, 'out': []::VARCHAR[]}}), lambda a, b:
  CASE WHEN length(CASE WHEN a.held = '' THEN b.held ELSE a.held || ' ' || b.held END) <= 1200
       THEN {{'held': CASE WHEN a.held = '' THEN b.held ELSE a.held || ' ' || b.held END, 'out': a.out}}
       WHEN length(a.held) >= 320
       THEN {{'held': trim(right(a.held, 220) || ' ' || b.held), 'out': list_append(a.out, trim(a.held))}}
       WHEN length(b.held) > 1200
       THEN {{'held': '', 'out': list_concat(a.out, list_filter(list_transform(range(0, length(b.held), 980), lambda i: trim(substring(b.held,
         (i + 1)::BIGINT, 1200))), lambda v: v <> ''))}}
       ELSE {{'held': CASE WHEN a.held = '' THEN b.held ELSE a.held || ' ' || b.held END, 'out': a.out}} END,
  {{'held': '', 'out': []::VARCHAR[]}})"""


def chunked(table: str, key: str) -> str:
    return f"""t AS (SELECT {key}, {normal("text")} AS t FROM {table} WHERE text IS NOT NULL),
 u AS (SELECT {key}, {_CHUNK_FOLD} AS r FROM (SELECT {key}, {chunk_sentences("t")} AS s FROM t WHERE t <> '')),
 v AS (SELECT {key}, CASE WHEN trim(r.held) = '' THEN r.out ELSE list_append(r.out, trim(r.held)) END AS c FROM u),
 cut AS (SELECT {key}, unnest(range(len(c)))::INTEGER AS chunk_index, unnest(c) AS chunk FROM v)"""


_COMPRESS = f"""WITH {CHUNKS}, f AS (SELECT source_order, {flat("raw_text")} AS t FROM chunk_rows WHERE raw_text IS NOT NULL),
 p AS (SELECT source_order, t, unnest(range(len(s))) AS i, unnest(s) AS s FROM (SELECT *, {sentences("t")} AS s FROM f)),
 k AS (SELECT source_order, any_value(t) AS t, list(s ORDER BY i) AS s FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source_order
   ORDER BY {sentence_score("s")} DESC, i) <= 4) GROUP BY 1),
 o AS (SELECT *, list_reduce(s, lambda a, b: CASE WHEN length(CASE WHEN a = '' THEN b ELSE a || ' ' || b END) > 420 THEN a WHEN a = '' THEN b
   ELSE a || ' ' || b END, '') AS o FROM k),
 r AS (SELECT source_order, CASE WHEN length(t) <= 420 THEN t WHEN length(o) >= 140 THEN trim(o) ELSE trim(left(t, 417)) || '...' END AS compressed FROM o)
 SELECT source_order, compressed, ceil(length(compressed) / 4)::INTEGER AS tokens FROM r"""

EVENTS = """ev AS (SELECT event_id, learner, q_index, lower(trim(kind)) AS kind, upper(trim(selected)) AS selected, correct, ts FROM quiz_events
  WHERE event_id IS NOT NULL AND learner IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY learner, q_index NULLS FIRST, kind, selected NULLS FIRST, correct NULLS FIRST, ts) = 1),
 re AS (SELECT learner, max((ts, event_id)) AS last FROM ev WHERE kind = 'restart' GROUP BY 1),
 se AS (SELECT ev.* FROM ev LEFT JOIN re USING (learner) WHERE kind <> 'restart' AND q_index IS NOT NULL AND (last IS NULL OR (ts, event_id) > last)),
 an AS (SELECT learner, q_index, arg_max({'s': selected}, (ts, event_id)).s AS selected, arg_max(coalesce(correct, false), (ts, event_id)) AS correct,
   count(*) AS attempts FROM se WHERE kind = 'answer' GROUP BY 1, 2),
 st AS (SELECT *, CASE WHEN kind = 'answer' AND NOT coalesce(correct, false) THEN 1 WHEN kind = 'remove_mark' THEN -1
   WHEN kind = 'clear_marks' THEN 0 END AS step FROM se),
 mm AS (SELECT learner, q_index, list_reduce(list({'m': step, 'k': kind} ORDER BY ts, event_id), lambda a,
   b: {'m': CASE WHEN b.k = 'clear_marks' THEN 0 ELSE greatest(0, a.m + b.m) END, 'k': ''}, {'m': 0, 'k': ''}).m AS marks FROM st WHERE step IS NOT NULL
   GROUP BY 1, 2),
 ma AS (SELECT learner, q_index, marks::BIGINT AS marks FROM mm WHERE marks > 0)"""

VALID = f"""qs AS (SELECT * FROM questions WHERE question_id IS NOT NULL),
 ok AS (SELECT * FROM qs WHERE question <> '' AND len(options) = 4 AND list_count(options) = 4 AND NOT list_contains(options, '')
   AND correct_answer <> '' AND explanation <> '' AND source.file <> '' AND source.chunk_id <> ''
   AND {trimmed("source.page")} <> '' AND list_contains(options, correct_answer))"""


# fixed values: messages
_EMPTY, _NO_JSON, _BAD_INDEX = "Paste the AI JSON output before parsing.", "JSON parse error: not one JSON value", "Compact JSON uses an invalid correct answer index."


def _message(i: str, value: str, path: str, text: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'questions.' || {i} || '.{path}: Required' WHEN {value} = '' THEN 'questions.' || {i} || '.{path}: {text}' END"


_RESPONSES = f"""q AS (SELECT question_id // 3 AS response, row_number() OVER (PARTITION BY question_id // 3 ORDER BY question_id) - 1 AS i, question,
  options, correct_answer AS answer, explanation, source.file AS file, source.chunk_id AS chunk, {trimmed("source.page")} AS page,
  source.page AS raw_page,
   list_position(options, correct_answer) AS pos, len(options) <> list_count(options) AS gap, list_contains(options, '') AS blank FROM questions
     WHERE question_id IS NOT NULL),
 m AS (SELECT *, response % 7 AS kind, list_filter([
   {_message("i", "question", "question", "question is required")},
   CASE WHEN options IS NULL THEN 'questions.' || i || '.options: Required'
     WHEN len(options) <> 4 THEN 'questions.' || i || '.options: each question needs 4 options' END,
   CASE WHEN gap THEN 'questions.' || i || '.options: Expected string' WHEN blank THEN 'questions.' || i || '.options: options cannot be empty' END,
   {_message("i", "answer", "correctAnswer", "correctAnswer is required")},
   {_message("i", "explanation", "explanation", "explanation is required")},
   {_message("i", "file", "source.file", "source.file is required")},
   {_message("i", "page", "source.page", "source.page is required")},
   {_message("i", "chunk", "source.chunkId", "source.chunkId is required")},
   CASE WHEN question IS NOT NULL AND explanation IS NOT NULL AND file IS NOT NULL AND chunk IS NOT NULL AND page IS NOT NULL AND answer IS NOT NULL
     AND options IS NOT NULL AND NOT gap AND pos IS NULL THEN 'questions.' || i || '.correctAnswer: correctAnswer must match one of the options' END
  ], lambda v: v IS NOT NULL) AS told,
  question <> '' AND len(options) = 4 AND NOT gap AND NOT blank AND explanation <> '' AND file <> '' AND chunk <> '' AND raw_page IS NOT NULL
    AND pos IS NOT NULL AS compact FROM q),
 v AS (SELECT response, any_value(kind) AS kind, flatten(list(told ORDER BY i)) AS told, bool_and(coalesce(compact, false)) AS compact FROM m GROUP BY 1),
 judged AS (SELECT *, CASE WHEN kind = 4 THEN false WHEN kind = 5 THEN false WHEN kind = 6 THEN compact ELSE len(told) = 0 END AS ok FROM v)"""
_COMPACT = f"""{_RESPONSES},
 ce AS (SELECT *, list_filter([
   {_message("i", "question", "0", "compact question text is required")},
   CASE WHEN options IS NULL THEN 'questions.' || i || '.1: Required'
     WHEN len(options) <> 4 THEN 'questions.' || i || '.1: compact question needs 4 options' END,
   CASE WHEN gap OR blank THEN 'questions.' || i || '.1: compact options cannot be empty' END,
   {_message("i", "explanation", "3", "compact explanation is required")},
   CASE WHEN coalesce(file, '') = '' OR coalesce(chunk, '') = '' OR page IS NULL THEN 'questions.' || i || '.4: Invalid source' END],
     lambda v: v IS NOT NULL) AS early FROM q),
 cm AS (SELECT response, i, question, options, answer, page, CASE WHEN len(early) = 0 AND (pos IS NULL OR pos = 0
   OR response % 5 = 4) THEN ['{_BAD_INDEX}'] ELSE early END AS t FROM ce),
 cv AS (SELECT response, flatten(list(t ORDER BY i)) AS told FROM cm GROUP BY 1)"""
_TRIM_OPTIONS = f"array_to_string(list_transform(options, lambda v: {trimmed('v')}), '|')"
STEM = f"{trimmed('''regexp_replace(lower(coalesce(question, '')), '[^a-z0-9]+', ' ', 'g')''')}"
MOVED = """CASE WHEN options IS NULL OR len(options) = 0 THEN options WHEN coalesce(list_position(options, correct_answer), 0) = 0 OR correct_answer IS NULL THEN options ELSE list_concat(list_concat(o[1:t], [correct_answer]), o[t+1:]) END"""


def moved(place: str, source: str) -> str:
    return f"""(SELECT *, {MOVED} AS new_options FROM (SELECT *, ({place}) % len(options) AS t, list_filter(options, lambda v, i: i <> list_position(options, correct_answer)) AS o FROM {source}))"""


def _cell(x: str) -> str:
    plain = trimmed(f"regexp_replace(coalesce({x}, ''), '\\r?\\n', ' ', 'g')")
    return f"""CASE WHEN regexp_matches({plain}, '[",]') THEN '"' || replace({plain}, '"', '""') || '"' ELSE {plain} END"""


_CSV = " || ',' || ".join(
    [
        "(question_id + 1)::VARCHAR",
        _cell("question"),
        *(_cell(f"options[{i}]") for i in range(1, 6)),
        _cell("correct_answer"),
        _cell("explanation"),
        _cell("source.file"),
        _cell("source.page"),
        _cell("source.chunk_id")
    ]
)

_RUNS = """fi AS (SELECT file_name, min(file_index) AS fx FROM pdf_pages WHERE file_name IS NOT NULL AND file_index IS NOT NULL GROUP BY 1)"""
_RUN = "coalesce(fx // 60, -1)::INTEGER AS run"
_LENGTHS = f"WITH {CHUNKS}, {_RUNS}, l AS (SELECT {_RUN}, c.file_name, source_order, score, length(coalesce(compressed_text, '')) AS n FROM chunk_rows c LEFT JOIN fi ON c.file_name = fi.file_name)"
_BALANCED = f"""{_LENGTHS},
 p AS (SELECT run, list(source_order ORDER BY -score, source_order) AS ids, list({{'n': n, 'l': [0, 0, 0, 0]::BIGINT[], 'a': []::BIGINT[]}}
   ORDER BY -score, source_order) AS s FROM l GROUP BY 1),
 r AS (SELECT run, ids, list_reduce(s, lambda x, y: {{'n': 0, 'l': list_transform(x.l, lambda v, i: CASE WHEN i = list_position(x.l,
   list_min(x.l)) THEN v + y.n ELSE v END), 'a': list_append(x.a, list_position(x.l, list_min(x.l)) - 1)}},
   {{'n': 0, 'l': [0, 0, 0, 0]::BIGINT[], 'a': []::BIGINT[]}}).a AS a FROM p),
 packed AS (SELECT run, unnest(ids) AS source_order, unnest(a)::INTEGER AS bucket FROM r)"""
# budget of characters of a prompt of five questions at standard density: 6500 * (0.6 + 5 / 10)
_PLAN = f"""{_LENGTHS},
 o AS (SELECT run, list(file_name ORDER BY -score, source_order) AS files, list(n ORDER BY -score, source_order) AS ns, sum(n) AS total, count(*) AS k
   FROM l GROUP BY 1),
 c AS (SELECT run, files, ns, k, unnest(CASE WHEN list_max(ns) > 7150 THEN [greatest(8, k)] ELSE range(greatest(8, CASE WHEN k > 8 THEN least(k,
   ceil(total / 7150)::BIGINT) ELSE 8 END), greatest(8, CASE WHEN k > 8 THEN least(k, ceil(total / 7150)::BIGINT) ELSE 8 END) + 40) END) AS b FROM o),
 t AS (SELECT run, files, ns, k, b, list_reduce(list_transform(ns, lambda v: {{'n': v::BIGINT, 'l': list_transform(range(b), lambda i: 0::BIGINT),
   'a': []::BIGINT[]}}), lambda x, y: {{'n': 0::BIGINT, 'l': list_transform(x.l, lambda v, i: CASE WHEN i = list_position(x.l,
   list_min(x.l)) THEN v + y.n ELSE v END), 'a': list_append(x.a, list_position(x.l, list_min(x.l)))}},
   {{'n': 0::BIGINT, 'l': list_transform(range(b), lambda i: 0::BIGINT), 'a': []::BIGINT[]}}) AS r FROM c),
 f AS (SELECT * FROM t WHERE b >= k OR list_max(r.l) <= 7150 QUALIFY row_number() OVER (PARTITION BY run ORDER BY b) = 1),
 u AS (SELECT run, unnest(range(len(ns))) AS i, unnest(ns) AS n, unnest(files) AS file_name, unnest(r.a) AS bucket FROM f),
 w AS (SELECT run, bucket, count(*) AS chunk_count, sum(n)::INTEGER AS estimated_chars, list(coalesce(file_name, '<null>') ORDER BY i) AS files FROM u
   GROUP BY 1, 2),
 x AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY bucket) AS batch_number, count(*) OVER (PARTITION BY run) AS used FROM w)
 SELECT run, batch_number::INTEGER AS batch_number, (least(40, used * 5) // used + CASE WHEN batch_number - 1 < least(40, used * 5) % used THEN 1
   ELSE 0 END)::INTEGER AS question_count, chunk_count, estimated_chars,
  array_to_string(list_filter(files, lambda v, i: list_position(files, v) = i), '|') AS source_files FROM x WHERE least(40, used * 5) // used + CASE
    WHEN batch_number - 1 < least(40, used * 5) % used THEN 1 ELSE 0 END > 0"""

# fixed values: the prompts, word for word
_PROMPT = """You are a strict quiz-generation engine.

TASK
- Target about <n> multiple-choice questions (MCQs). A slightly lower or higher count is acceptable if it improves source-grounded quality.
- Difficulty target: medium.
- Prioritize this topic focus when selecting question material: "port".
- Preferred question style: scenario.
- Working batch: Batch <b>.

HARD CONSTRAINTS
1) Use ONLY facts that are explicitly present in SOURCE_PACKET. Do not infer facts that are not stated.
2) Return JSON only. Do not use Markdown, code fences, commentary, or additional keys.
3) Output must match the schema exactly.
4) Aim for roughly <n> items in the "questions" array.
5) Each question must contain exactly 4 options.
6) "correctAnswer" must exactly match one of the 4 options.
7) "explanation" must be concise and must reference why the correct option is supported by source text.
8) "source.file" and "source.chunkId" are mandatory.
9) If page is unknown, set "source.page" to "unknown" but still provide chunkId.
10) Preserve source grounding. No hallucinations.
11) Avoid generating question stems that substantially overlap with any prior accepted question listed below.


CUSTOM INSTRUCTIONS
- Keep it short.
- No trick questions.


REQUIRED JSON SCHEMA
{
  "questions": [
    {
      "question": "string",
      "options": ["Option A", "Option B", "Option C", "Option D"],
      "correctAnswer": "string",
      "explanation": "string",
      "source": {
        "file": "string",
        "page": "string",
        "chunkId": "string"
      }
    }
  ]
}

QUALITY CHECK BEFORE YOU RETURN
- Verify the response stays reasonably close to the target of <n> questions.
- Verify every question has 4 options.
- Verify each correctAnswer equals one of that question's options.
- Verify each question includes source.file, source.page, and source.chunkId.


SOURCE_PACKET_START
"""
_COMPACT_PROMPT = """You are a strict quiz-generation engine.

TASK
- Target about <n> multiple-choice questions (MCQs). A slightly lower or higher count is acceptable if it improves source-grounded quality.
- Difficulty target: mixed levels (1-2 easy, 2-3 medium, up to 1 hard).
- No explicit topic focus was supplied. Choose the most central concepts from the source packet.

- Working batch: Prompt <b> of <all>.

HARD CONSTRAINTS
1) Use ONLY facts that are explicitly present in SOURCE_PACKET. Do not infer facts that are not stated.
2) Return JSON only. Do not use Markdown, code fences, commentary, or additional keys.
3) Output must match the schema exactly.
4) Aim for roughly <n> items in the "questions" array.
5) Each question must contain exactly 5 options.
6) "correctAnswer" must exactly match one of the 5 options.
7) "explanation" must be concise and must reference why the correct option is supported by source text.
8) "source.file" and "source.chunkId" are mandatory.
9) If page is unknown, set "source.page" to "unknown" but still provide chunkId.
10) Preserve source grounding. No hallucinations.
11) Avoid generating question stems that substantially overlap with any prior accepted question listed below.
12) Use compact response mode.
13) Return minified JSON on as few lines as possible.
14) In compact mode, each question must be: ["question", ["A", "B", "C", "D", "E"], correctIndex, "short explanation", ["file","page","chunkId"]].
15) "correctIndex" must be 0 through 4.
16) Keep explanations short and factual.


REQUIRED JSON SCHEMA
{"questions":[["question",["A","B","C","D","E"],0,"short explanation",["file","page","chunkId"]]]}

QUALITY CHECK BEFORE YOU RETURN
- Verify the response stays reasonably close to the target of <n> questions.
- Verify every question has 5 options.
- Verify each correctIndex points to the intended correct option.
- Verify each question includes source.file, source.page, and source.chunkId in the compact tuple.
<previous>

SOURCE_PACKET_START
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PACKETS = f"""WITH {CHUNKS}, b AS (SELECT batch_number, question_count, unnest(ids) AS id, unnest(range(len(ids))) AS place
  FROM (SELECT batch_number, question_count, list_filter(chunk_ids, lambda v, i: list_position(chunk_ids, v) = i) AS ids FROM prompt_batches)),
 f AS (SELECT id, min(source_order) AS source_order FROM chunk_rows GROUP BY 1),
 j AS (SELECT b.*, c.page, c.file_name, c.chunk_id, c.compressed_text, row_number() OVER (PARTITION BY batch_number ORDER BY place) AS k FROM b
   JOIN f USING (id) JOIN chunk_rows c USING (source_order)),
 packets AS (SELECT batch_number, coalesce(any_value(question_count), 5) AS n, string_agg('SOURCE_' || k || chr(10) || 'file: ' || coalesce(file_name,
   '') || chr(10) || 'page: ' || CASE WHEN coalesce(page, 0) = 0 THEN 'unknown' ELSE page::VARCHAR END || chr(10) || 'chunkId: ' || coalesce(chunk_id,
   '') || chr(10) || 'content: ' || coalesce(compressed_text, ''), chr(10) || chr(10) ORDER BY k) AS packet FROM j GROUP BY 1)"""

_SEQUENTIAL = f"""{_LENGTHS},
 e AS (SELECT *, (sum(n) OVER (PARTITION BY run))::DOUBLE / 4 AS share, count(*) OVER (PARTITION BY run) AS k FROM l),
 p AS (SELECT run, list(source_order ORDER BY source_order) AS ids, list({{'n': n::BIGINT, 'share': share, 'k': k, 'b': 0::BIGINT, 'h': 0::BIGINT,
   'c': 0::BIGINT, 'i': 0::BIGINT, 'a': []::BIGINT[]}} ORDER BY source_order) AS s FROM e GROUP BY 1),
 r AS (SELECT run, ids, list_reduce(s, lambda x, y: CASE WHEN x.b < 3 AND x.c > 0 AND x.h + y.n > (x.b + 1) * y.share AND y.k - x.i > 3 - x.b
   THEN {{'n': 0, 'share': 0, 'k': 0, 'b': x.b + 1, 'h': y.n, 'c': 1, 'i': x.i + 1, 'a': list_append(x.a, x.b + 1)}}
   ELSE {{'n': 0, 'share': 0, 'k': 0, 'b': x.b, 'h': x.h + y.n, 'c': x.c + 1, 'i': x.i + 1, 'a': list_append(x.a, x.b)}} END,
   {{'n': 0::BIGINT, 'share': 0::DOUBLE, 'k': 0::BIGINT, 'b': 0::BIGINT, 'h': 0::BIGINT, 'c': 0::BIGINT, 'i': 0::BIGINT, 'a': []::BIGINT[]}}).a AS a FROM p)
 SELECT run, unnest(ids) AS source_order, unnest(a)::INTEGER AS bucket FROM r"""
_BUDGET = f"""{HEAD}{deduped()}, {_RUNS}, d AS (SELECT {_RUN}, d.source_order, d.id, coalesce(d.file_name, chr(1)) AS file_name, d.score, d.position,
  length(coalesce(d.compressed_text, ''))::BIGINT AS n FROM deduped d LEFT JOIN fi ON d.file_name = fi.file_name),
 g AS (SELECT *, row_number() OVER (PARTITION BY run, file_name ORDER BY score DESC, position) = 1 AS first, min(position) OVER (PARTITION BY run,
   file_name) AS seen FROM d),
 i AS (SELECT run, source_order, id, n, true AS covers, seen::DOUBLE AS o1, 0 AS o2 FROM g WHERE first UNION ALL SELECT run, source_order, id, n,
   false, -score, position FROM g),
 p AS (SELECT run, list({{'id': id, 'o': source_order, 'v': n, 'covers': covers, 'n': 0::BIGINT, 'c': 0::BIGINT, 'ids': []::VARCHAR[],
   'a': []::BIGINT[], 'b': []::BIGINT[]}} ORDER BY covers DESC, o1, o2) AS s FROM i GROUP BY 1),
 r AS (SELECT run, list_reduce(s, lambda x, y: CASE WHEN (NOT y.covers AND list_contains(x.ids, y.id)) OR x.n >= 120 OR x.c + y.v > 20000 THEN x
   ELSE {{'id': '', 'o': 0, 'v': 0, 'covers': false, 'n': x.n + 1, 'c': x.c + y.v, 'ids': list_append(x.ids, y.id), 'a': CASE
     WHEN y.covers THEN list_append(x.a, y.o) ELSE x.a END, 'b': CASE WHEN y.covers THEN x.b ELSE list_append(x.b, y.o) END}} END,
   {{'id': '', 'o': 0::BIGINT, 'v': 0::BIGINT, 'covers': false, 'n': 0::BIGINT, 'c': 0::BIGINT, 'ids': []::VARCHAR[], 'a': []::BIGINT[],
     'b': []::BIGINT[]}}) AS r FROM p)
 SELECT run, unnest(r.a) AS source_order, true AS covers FROM r UNION ALL SELECT run, unnest(r.b), false FROM r"""
_SLUG = "regexp_replace(regexp_replace(lower(coalesce(file_name, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_FILE_ID = f"CASE WHEN {_SLUG} = '' THEN 'file-' || (file_index + 1) ELSE {_SLUG} END || '-' || CASE WHEN page_number IS NULL THEN 'unknown' ELSE 'p' || page_number END"
_OWN_CHUNKS = f"""{chunked("pdf_pages", "page_id")}, own AS (SELECT c.*, file_index, page_seq, {_FILE_ID} AS label, (row_number() OVER (ORDER BY file_index, page_seq, chunk_index) - 1)::BIGINT AS source_order FROM cut c JOIN pdf_pages USING (page_id))"""
_SCORE = f"""CASE WHEN len(w) = 0 THEN 0
  ELSE len(w) * 0.6::DOUBLE + len(list_distinct(w)) / len(w) * 40.0::DOUBLE + {count("w", "length(w) >= 7")} * 1.1::DOUBLE + {count("w", "regexp_matches(w, '[0-9]')")} * 1.4::DOUBLE
        + len(regexp_extract_all(raw_text, '\\b[A-Z][A-Za-z0-9]+:')) * 2.0::DOUBLE END"""


def _positions(source: str, options: str) -> str:
    return f"""(SELECT string_agg(n::VARCHAR, ',' ORDER BY position) FROM (SELECT r.position, count(p.position) AS n
      FROM (SELECT unnest(range((SELECT max(len(options)) FROM {source}))) AS position) r
        LEFT JOIN (SELECT coalesce(list_position({options}, correct_answer), 0) - 1 AS position FROM {source}) p ON p.position = r.position GROUP BY 1))"""


_PAYLOADS = """WITH o AS (SELECT batch_number, question_id, '{' || array_to_string(list_filter([CASE WHEN question IS NOT NULL THEN '"question":' || to_json(question)::VARCHAR END, CASE WHEN options IS NOT NULL THEN '"options":' || to_json(options)::VARCHAR END,
          CASE WHEN correct_answer IS NOT NULL THEN '"correctAnswer":' || to_json(correct_answer)::VARCHAR END, CASE
            WHEN explanation IS NOT NULL THEN '"explanation":' || to_json(explanation)::VARCHAR END,
          '"source":{' || array_to_string(list_filter([CASE WHEN source.file IS NOT NULL THEN '"file":' || to_json(source.file)::VARCHAR END, CASE WHEN source.page IS NOT NULL THEN '"page":' || to_json(source.page)::VARCHAR END, CASE WHEN source.chunk_id IS NOT NULL THEN '"chunkId":' || to_json(source.chunk_id)::VARCHAR END], lambda v: v IS NOT NULL), ',') || '}'], lambda v: v IS NOT NULL), ',') || '}' AS j
          FROM questions WHERE batch_number IS NOT NULL AND question_id IS NOT NULL) SELECT batch_number,
            '{"questions":[' || string_agg(j, ',' ORDER BY question_id) || ']}' AS payload FROM o GROUP BY 1"""


def hashed(x: str) -> str:
    """FNV-1a of 32 bits over UTF-16 units, in base 36."""
    code = f"unicode(substring({x}, i::BIGINT, 1))"
    units = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN {code} < 65536 THEN [{code}::BIGINT] ELSE [(({code} - 65536) // 1024 + 55296)::BIGINT, (({code} - 65536) % 1024 + 56320)::BIGINT] END))"
    return f"lower(to_base(list_reduce({units}, lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT, 2166136261::BIGINT), 36))"


_CONTRAST = """WITH px AS (SELECT p_brand, p_partkey,
  floor((p_size * 5 % 256) * 0.299::DOUBLE + (p_partkey * 7 % 256) * 0.587::DOUBLE + (p_size * 11 % 256) * 0.114::DOUBLE + 0.5)::INTEGER AS g
  FROM part),
        h AS (SELECT p_brand, g, count(*) AS n FROM px GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY g) AS run,
          sum(n) OVER (PARTITION BY p_brand) AS total FROM h),
        lh AS (SELECT p_brand, min(g) FILTER (run >= total * 0.02::DOUBLE) AS lo, min(g) FILTER (run >= total * 0.98::DOUBLE) AS hi FROM r GROUP BY 1),
        st AS (SELECT p_brand, p_partkey, greatest(0, least(255, floor((g - lo) * 255 / greatest(hi - lo, 1) + 0.5)))::INTEGER AS v FROM px
          JOIN lh USING (p_brand))"""


def quality(conf: str) -> str:
    """Usability and score of pages as recognition output, with the confidence given."""
    return f"""WITH p AS (SELECT page_id, {normal("text")} AS t, {conf} AS conf,
      list_filter(list_transform(list_filter(string_split(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' '), lambda v: v <> ''),
          lambda v: {{'t': regexp_replace(v, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), 'c': 30.0::DOUBLE + length(v) * 5, 'd': length(v) % 2 = 0}}),
            lambda v: v.t <> '') AS ws FROM pdf_pages WHERE text IS NOT NULL),
        c AS (SELECT *, len(ws) AS n, {count("ws", "regexp_matches(w.t, '[A-Za-z]')")} AS alpha, length(regexp_replace(t, '\\s+', '', 'g')) AS seen,
          len(regexp_extract_all(t, '[A-Za-z0-9]')) AS alnum, len(regexp_extract_all(t, '[.,;:!?''"“”‘’()\\[\\]{{}}\\-–—/%&+=_*]')) AS marks,
          {count("ws", "regexp_matches(w.t, '^[A-Za-z0-9]+(?:[’''/-][A-Za-z0-9]+)*$')")} AS clean, {count("ws", "w.c >= 55")} AS sure,
            {count("ws", "regexp_matches(w.t, '[A-Za-z]') AND w.d AND length(w.t) >= 3")} AS known, coalesce(list_sum(list_transform(ws, lambda v: v.c)),
            0) AS total FROM p),
        r AS (SELECT *, CASE WHEN n > 0 THEN total / n ELSE conf END AS average, CASE WHEN seen > 0 THEN alnum / seen ELSE 0 END AS alnums, CASE
          WHEN seen > 0 THEN greatest(0, seen - alnum - marks) / seen ELSE 1 END AS symbols, CASE WHEN n > 0 THEN sure / n ELSE 0 END AS sures,
          CASE WHEN n > 0 THEN clean / n ELSE 0 END AS cleans, CASE WHEN alpha > 0 THEN known / alpha ELSE 0 END AS knowns, length(t) < 12 OR n < 3
            AND alpha < 2 AS short FROM c),
        u AS (SELECT *, length(t) > 0 AND (conf >= 68 AND alnums >= 0.7 AND symbols <= 0.08 OR NOT short AND alnums >= 0.55 AND symbols <= 0.16
          AND (knowns >= 0.18 AND average >= 38 OR conf >= 42 AND average >= 45 AND sures >= 0.45 AND cleans >= 0.55)) AS usable FROM r)
        SELECT page_id, t, conf, usable,
          conf * 0.45::DOUBLE + average * 0.25::DOUBLE + sures * 22 + cleans * 12 + knowns * 16 + alnums * 10 - symbols * 60 + least(length(t),
          240) * 0.05::DOUBLE + CASE WHEN usable THEN 18 ELSE -25 END AS quality_score FROM u"""


ORACLES: dict[str, str] = {
    "pack_sequential": _SEQUENTIAL,
    "chunk_ids": f"WITH {_OWN_CHUNKS} SELECT source_order, label || '-' || (chunk_index + 1) AS id, label || '-c' || (chunk_index + 1) AS chunk_id FROM own",
    "top_chunks": f"""WITH {_OWN_CHUNKS}, chunk_rows AS (SELECT source_order, label || '-' || (chunk_index + 1) AS id,
        label || '-c' || (chunk_index + 1) AS chunk_id, raw_text, {_SCORE} AS score FROM (SELECT *, chunk AS raw_text, {tokens("chunk")} AS w FROM own)),
        {FINGERPRINT}, {KEYED}, {deduped()} SELECT chunk_id, round(score, 6) AS score, length(raw_text)::INTEGER AS chars FROM (SELECT * FROM deduped ORDER BY score DESC, source_order LIMIT 10)""",
    "quality_report": f"""WITH q AS (SELECT * FROM questions WHERE question_id IS NOT NULL), m AS (SELECT * FROM {moved("question_id", "q")})
        SELECT {_positions("q", "options")} AS original_counts, {_positions("m", "new_options")} AS balanced_counts,
        coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM q WHERE list_position(options, correct_answer) > 0 GROUP BY list_position(options,
          correct_answer))) / (SELECT count(*) FROM q) >= 0.6 AND (SELECT count(*) FROM q) >= (SELECT max(len(options)) FROM q), false) AS skew_detected,
        (SELECT count(*) FROM q WHERE len(list_distinct(list_transform(options, lambda v: lower({trimmed("v")})))) + CASE WHEN list_count(options) < len(options) THEN 1 ELSE 0 END < len(options)) AS duplicate_option_questions""",
    "question_states": f"""WITH {EVENTS}, rt AS (SELECT learner, q_index, arg_max(kind, (ts, event_id)) = 'retry' AS retry FROM se
        WHERE kind IN ('retry', 'answer') GROUP BY 1, 2),
        b AS (SELECT learner, q_index, selected, correct, coalesce(marks, 0) AS marks, coalesce(retry, false) AS retry FROM an FULL
          JOIN ma USING (learner, q_index) LEFT JOIN rt USING (learner, q_index))
        SELECT learner, q_index, CASE WHEN marks > 0 THEN 'Miss marks: ' || array_to_string(list_transform(range(least(marks, 6)), lambda i: 'X'),
          ' ') || CASE WHEN marks > 6 THEN ' +' || (marks - 6) ELSE '' END || ' • ' || CASE WHEN correct IS NULL THEN 'Queued for retry'
          WHEN correct THEN 'Corrected after retry' ELSE 'Still incorrect' END
        WHEN correct IS NULL THEN 'Not answered yet' WHEN correct THEN 'Answered correctly' ELSE 'Answered incorrectly' END AS status, selected IS NOT NULL AND NOT retry AS locked FROM b""",
    "normalize_text": f"SELECT page_id, {normal('text')} AS text FROM pdf_pages",
    "tokenize_stats": f"SELECT page_id, len(w)::INTEGER AS tokens, len(list_distinct(w))::INTEGER AS distinct_tokens, len({content('w')})::INTEGER AS content_tokens FROM (SELECT page_id, {tokens('text')} AS w FROM pdf_pages WHERE text IS NOT NULL)",
    "sentence_split": f"SELECT page_id, len({sentences('t')})::INTEGER AS sentences, len({chunk_sentences('t')})::INTEGER AS chunk_sentences FROM (SELECT page_id, {flat('text')} AS t FROM pdf_pages WHERE text IS NOT NULL)",
    "sentence_scores": f"WITH {CHUNKS}, p AS (SELECT source_order, unnest(range(len(s)))::INTEGER AS i, unnest(s) AS s FROM (SELECT source_order, {sentences('t')} AS s FROM (SELECT source_order, {flat('raw_text')} AS t FROM chunk_rows WHERE raw_text IS NOT NULL))) SELECT source_order, i, round({sentence_score('s')}, 6) AS score FROM p",
    "chunk_pages": f"WITH {chunked('pdf_pages', 'page_id')} SELECT page_id, chunk_index, chunk FROM cut",
    "chunk_documents": f"WITH {chunked('documents', 'doc_id')} SELECT doc_id, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars, max(length(chunk))::INTEGER AS longest FROM cut GROUP BY 1",
    "info_scores": f"""WITH {CHUNKS}, w AS (SELECT source_order, raw_text, {tokens('raw_text')} AS w FROM chunk_rows WHERE raw_text IS NOT NULL)
        SELECT source_order, CASE WHEN len(w) = 0 THEN 0
          ELSE round(len(w) * 0.6::DOUBLE + len(list_distinct(w)) / len(w) * 40.0::DOUBLE + {count('w', 'length(w) >= 7')} * 1.1::DOUBLE + {count('w', "regexp_matches(w, '[0-9]')")} * 1.4::DOUBLE
        + len(regexp_extract_all(raw_text, '\\b[A-Z][A-Za-z0-9]+:')) * 2.0::DOUBLE, 6) END AS score FROM w""",
    "fingerprints": f"WITH {CHUNKS}, {FINGERPRINT} SELECT source_order, fingerprint FROM prints",
    "compress_chunks": _COMPRESS,
    "topic_scores": f"WITH {CHUNKS} SELECT source_order, (8 * (contains(lower(raw_text), 'river')::INTEGER + contains(lower(raw_text), 'the')::INTEGER + contains(lower(raw_text), 'port')::INTEGER))::INTEGER AS points FROM chunk_rows WHERE raw_text IS NOT NULL",
    "file_totals": "SELECT file_index, count(*) AS pages, sum(length(text))::BIGINT AS text_length, sum(length(text)) < 220 AS low_text FROM pdf_pages WHERE length(text) > 0 GROUP BY 1",
    "file_filter_status": f"""WITH f AS (SELECT file_index, arg_max((file_name, file_size), (file_name, file_size)) AS f FROM file_status GROUP BY 1),
        g AS (SELECT file_index, f[1] AS name, f[2] AS size FROM f)
        SELECT file_index, CASE WHEN lower(coalesce(name, '')) LIKE '%.pdf' THEN 'pdf' WHEN lower(coalesce(name, '')) LIKE '%.docx' THEN 'docx'
          ELSE 'image' END AS format,
        CASE WHEN file_index >= 60 THEN 'Skipped because max file limit was reached.' WHEN NOT regexp_matches(lower(coalesce(name, '')),
          '\\.(pdf|docx|png|jpe?g|webp|gif|bmp|tiff?)$') THEN 'Unsupported file type (PDF, DOCX, and common image files only).'
          WHEN size > 31457280 THEN 'File is too large (>30 MB).' END AS message,
        CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) ELSE printf('%.1f MB', size / 1048576) END AS size FROM g""",
    "file_formats": """WITH f AS (SELECT file_index, max(file_name) AS file_name FROM file_status GROUP BY 1), g AS (SELECT file_index,
        lower(coalesce(CASE WHEN file_index % 2 = 0 THEN regexp_replace(file_name, '\\.\\w+$', '') ELSE file_name END, '')) AS name,
          CASE file_index % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
            WHEN 2 THEN 'image/png' WHEN 3 THEN 'text/plain' ELSE '' END AS mime FROM f WHERE file_index IS NOT NULL)
        SELECT file_index, CASE WHEN mime = 'application/pdf' OR name LIKE '%.pdf' THEN 'pdf' WHEN mime LIKE '%wordprocessingml%' OR name LIKE '%.docx' THEN 'docx' ELSE 'image' END AS format, regexp_matches(name, '\\.(pdf|docx|png|jpe?g|webp|gif|bmp|tiff?)$') OR mime NOT IN ('', 'text/plain') AS supported FROM g""",
    "choice_texts": """WITH n AS (SELECT batch_number, min(len(options)) AS a, max(len(options)) AS b FROM questions WHERE question_id IS NOT NULL
        AND batch_number IS NOT NULL AND len(options) > 0 GROUP BY 1)
        SELECT batch_number, CASE WHEN a = b THEN a || CASE WHEN a = 1 THEN ' answer choice each' ELSE ' answer choices each' END ELSE a || '-' || b || ' answer choices' END AS text, CASE WHEN b = 1 THEN 'A' ELSE 'A-' || chr((64 + b)::INTEGER) END AS labels FROM n""",
    "sample_questions": """SELECT (i - 1)::INTEGER AS q_index, 'Sample question ' || i || '?' AS question, array_to_string(list_transform(['A', 'B', 'C', 'D'], lambda v: 'Sample option ' || v || i), '|') AS options, 'Sample option A' || i AS correct_answer, i::VARCHAR AS page FROM range(1, 41) t(i)""",
    "ocr_quality": f"SELECT page_id, usable, round(quality_score, 6) AS quality_score FROM ({quality('40.0::DOUBLE + page_id % 50')})",
    "best_attempts": f"""WITH a AS (SELECT *, 0 AS try FROM ({quality("40.0::DOUBLE + page_id % 50")}) UNION ALL SELECT *, -1
        FROM ({quality("90.0::DOUBLE - page_id % 50")})),
        g AS (SELECT page_id FROM a WHERE try = 0 AND usable AND quality_score >= 90), k AS (SELECT * FROM a WHERE try = 0
          OR page_id NOT IN (SELECT page_id FROM g) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY quality_score DESC, try DESC) = 1)
        SELECT page_id, conf AS confidence, usable, (CASE WHEN usable THEN length(t) ELSE 0 END)::INTEGER AS chars, round(quality_score, 6) AS quality_score FROM k""",
    "restored_states": f"""WITH {EVENTS}, b AS (SELECT DISTINCT q_index FROM questions WHERE q_index IS NOT NULL AND question_id IS NOT NULL), j
        AS (SELECT learner, q_index, selected, correct, attempts, marks, coalesce(selected IN ('A', 'B', 'C', 'D'), false) AS known FROM an FULL
        JOIN ma USING (learner, q_index) JOIN b USING (q_index))
        SELECT learner, q_index::BIGINT AS q_index, CASE WHEN known THEN selected END AS selected, CASE WHEN known THEN correct END AS correct, CASE WHEN known THEN greatest(1, attempts)::INTEGER END AS attempts, coalesce(marks, 0)::INTEGER AS marks FROM j WHERE known OR marks > 0""",
    "stage_labels": """SELECT DISTINCT lower(trim(state)) AS state, CASE lower(trim(state)) WHEN 'idle' THEN 'Ready'
        WHEN 'uploading' THEN 'Uploading files' WHEN 'extracting' THEN 'Extracting file text' WHEN 'analyzing' THEN 'Analyzing and compressing chunks'
        WHEN 'building_prompt' THEN 'Building prompt queue'
        WHEN 'waiting_for_ai' THEN 'Waiting for pasted AI batch output' WHEN 'parsed_success' THEN 'Quiz parsed successfully' WHEN 'failed' THEN 'Failed' ELSE 'Working' END AS label FROM file_status""",
    "intake_files": "SELECT file_index, file_name, file_size FROM (SELECT DISTINCT file_index, file_name, file_size, updated_at FROM file_status) QUALIFY row_number() OVER (PARTITION BY file_name, file_size, updated_at ORDER BY file_index) = 1",
    "file_states": """SELECT file_index, CASE WHEN c = 0 OR w > 0 THEN 'warning' ELSE 'completed' END AS state, CASE
        WHEN c = 0 THEN 'No usable chunks extracted from this file.' WHEN w > 0 THEN 'Completed with warning (' || c || ' chunks).'
        ELSE 'Completed (' || c || ' chunks).' END AS message
        FROM (SELECT file_index, max(chunks) AS c, max(coalesce(len(warnings), 0)) AS w FROM file_status WHERE chunks IS NOT NULL GROUP BY 1)""",
    "progress_events": """WITH f AS (SELECT file_index, max(coalesce(file_size, 0)) AS z FROM file_status GROUP BY 1)
        SELECT *, greatest(1, floor(processed_bytes / total_bytes * 100 + 0.5))::INTEGER AS percent FROM (SELECT file_index, row_number() OVER (ORDER BY file_index)::INTEGER AS processed_files, (sum(z) OVER (ORDER BY file_index))::BIGINT AS processed_bytes, (sum(z) OVER ())::BIGINT AS total_bytes FROM f)""",
    "dedupe_within_file": f"{HEAD}{deduped('file_name, ')} SELECT source_order, position FROM deduped",
    "dedupe_global": f"{HEAD}{deduped()} SELECT source_order, position FROM deduped",
    "chunks_per_file": f"{HEAD}{deduped('file_name, ')} SELECT file_name, count(*) AS chunks FROM deduped GROUP BY 1",
    "top_chunks_per_file": f"{HEAD}{deduped()} SELECT file_name, source_order, (row_number() OVER (PARTITION BY file_name ORDER BY score DESC, position))::INTEGER AS file_rank FROM deduped QUALIFY file_rank <= 5",
    "coverage_selection": f"""{HEAD}{deduped()}, best AS (SELECT * FROM deduped QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY score DESC,
        position) = 1),
        fill AS (SELECT * FROM deduped WHERE id NOT IN (SELECT id FROM best) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, position) = 1) SELECT source_order, true AS covers FROM best UNION ALL SELECT source_order, false FROM fill""",
    "order_best_match": f"WITH {CHUNKS} SELECT source_order, (row_number() OVER (PARTITION BY file_name ORDER BY score DESC, source_order))::INTEGER AS file_rank FROM chunk_rows",
    "pack_balanced": f"{_BALANCED} SELECT run, source_order, bucket FROM packed",
    "batch_plan": _PLAN,
    "new_batches": """SELECT batch_number, question_count, '' AS response, NULL::VARCHAR AS prompt_override, 'pending' AS status, 0::BIGINT AS added,
        0::BIGINT AS duplicates, 0 AS notes, 'medium' AS difficulty, 'port' AS topic_focus, 'standard' AS response_format, 'scenario' AS question_style,
        'Keep it short.' || chr(10) || chr(10) || 'No trick questions.' AS custom_instructions, 4 AS option_count FROM prompt_batches""",
    "char_budgets": """WITH a AS (SELECT unnest([-3, 0.4, 0.5, 2.5, 250]::DOUBLE[]) AS asked UNION ALL SELECT i::DOUBLE FROM range(1, 101) t(i)), q
        AS (SELECT asked, greatest(1, least(100, floor(asked + 0.5)))::INTEGER AS questions FROM a)
        SELECT asked, density, format, questions, floor(6500 * least(3.2::DOUBLE, greatest(0.9::DOUBLE, 0.6::DOUBLE + questions / 10)) * CASE density
          WHEN 'light' THEN 0.85::DOUBLE WHEN 'dense' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE format WHEN 'compact' THEN 1.35::DOUBLE
          ELSE 1.0::DOUBLE END + 0.5::DOUBLE)::INTEGER AS chars
        FROM q, (SELECT unnest(['light', 'standard', 'dense']) AS density), (SELECT unnest(['standard', 'compact']) AS format)""",
    "prepared_notes": f"""SELECT run, 'Prepared ' || n || ' prompt' || CASE WHEN n = 1 THEN ''
        ELSE 's' END || ' for ' || q || ' planned questions at 5 per prompt in Standard mode using standard JSON with 4 choices per question and best-match order.'
        || CASE WHEN n > 8 THEN ' Source volume required ' || (n - 8) || ' extra prompt' || CASE WHEN n = 9 THEN '' ELSE 's' END || ' to keep each batch usable.' ELSE '' END AS note FROM (SELECT run, count(*) AS n, sum(question_count) AS q FROM ({_PLAN}) GROUP BY 1)""",
    "coverage_selection_budget": _BUDGET,
    "order_page": "SELECT source_order, row_number() OVER (PARTITION BY file_name ORDER BY source_order) AS page_rank FROM (SELECT DISTINCT file_name, source_order FROM chunks WHERE source_order IS NOT NULL)",
    "compression_note": f"""{HEAD}{deduped()}, best AS (SELECT * FROM deduped QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY score DESC,
        position) = 1), n AS (SELECT (SELECT count(*) FROM deduped) AS a,
        (SELECT count(*) FROM best) + (SELECT count(DISTINCT id) FROM deduped WHERE id NOT IN (SELECT id FROM best)) AS b) SELECT a AS deduped, b AS selected, CASE WHEN a > b THEN 'Compressed source set from ' || a || ' to ' || b || ' chunks to fit the planned prompt set.' END AS warning FROM n""",
    "low_text_files": "SELECT file_index, sum(length(text))::BIGINT AS text_length, 'Very little extractable text found.' AS warning FROM pdf_pages WHERE length(text) > 0 GROUP BY 1 HAVING sum(length(text)) < 220",
    "run_failures": """WITH f AS (SELECT file_index, max(chunks) AS c FROM file_status GROUP BY 1) SELECT (file_index // 100)::INTEGER AS run, CASE
        WHEN coalesce(sum(c), 0) = 0 THEN 'No valid source text could be extracted from the uploaded PDFs, DOCX files, or images.'
        WHEN count(*) > 60 THEN 'Received ' || count(*) || ' files. Only the first 60 files were processed to keep performance stable.' END AS message FROM f GROUP BY 1""",
    "ocr_fallback": f"""WITH g AS (SELECT page_id, file_index, page_seq, {normal("text")} AS whole FROM pdf_pages WHERE text IS NOT NULL
        AND file_index IS NOT NULL),
        p AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN left(whole, 12) ELSE whole END AS layer FROM g), b AS (SELECT file_index,
          min(page_seq) AS broken FROM p WHERE length(layer) < 24 AND page_id % 31 = 0 GROUP BY 1),
        u AS (SELECT p.*, length(layer) < 24 AND page_id % 5 > 0 AND length(whole) > 0 AND (broken IS NULL OR page_seq < broken) AS from_ocr FROM p
          LEFT JOIN b USING (file_index))
        SELECT page_id, CASE WHEN from_ocr THEN whole ELSE layer END AS text, coalesce(from_ocr, false) AS from_ocr FROM u WHERE length(CASE WHEN from_ocr THEN whole ELSE layer END) > 0""",
    "question_allocation": f"""{_BALANCED}, u AS (SELECT DISTINCT run, bucket FROM packed), k AS (SELECT *, row_number() OVER (PARTITION BY run
        ORDER BY bucket) - 1 AS r, count(*) OVER (PARTITION BY run) AS n FROM u)
        SELECT run, bucket, (least(7, n * 3) // n + CASE WHEN r < least(7, n * 3) % n THEN 1 ELSE 0 END)::INTEGER AS questions FROM k""",
    "queue_metrics": """SELECT (SELECT sum(question_count)::BIGINT FROM prompt_batches) AS planned_questions, (SELECT count(*) FROM prompt_batches
        WHERE batch_number % 3 = 0) AS parsed_batches, (SELECT min(batch_number)::BIGINT FROM prompt_batches WHERE batch_number % 3 <> 0) AS next_pending,
        (SELECT count(DISTINCT coalesce(file_index, -1)) FROM file_status) AS files, (SELECT sum(z)::BIGINT FROM (SELECT max(file_size) AS z FROM file_status GROUP BY file_index)) AS source_bytes""",
    "source_packets": f"{_PACKETS} SELECT batch_number, packet FROM packets",
    "master_prompts": f"{_PACKETS} SELECT batch_number, replace(replace({_quoted(_PROMPT)}, '<n>', n::VARCHAR), '<b>', batch_number::VARCHAR) || packet || chr(10) || 'SOURCE_PACKET_END' AS prompt FROM packets",
    "prompt_queue": f"""{_PACKETS}, last AS (SELECT question, question_id FROM questions WHERE question IS NOT NULL AND question_id IS NOT NULL
        ORDER BY question_id DESC LIMIT 25), lined AS (SELECT 'PREVIOUS_QUESTION_' || row_number() OVER (ORDER BY question_id) || ': ' || question AS line,
        question_id FROM last),
        previous AS (SELECT chr(10) || 'AVOID_DUPLICATES_WITH_PREVIOUS_BATCHES' || chr(10) || string_agg(line, chr(10)
          ORDER BY question_id) || chr(10) AS block FROM lined)
        SELECT batch_number, CASE WHEN batch_number % 10 = 0 THEN 'My own prompt ' || batch_number ELSE replace(replace(replace(replace({_quoted(_COMPACT_PROMPT)}, '<n>', n::VARCHAR), '<b>', batch_number::VARCHAR), '<all>', (SELECT count(*) FROM prompt_batches)::VARCHAR), '<previous>', (SELECT block FROM previous)) || packet || chr(10) || 'SOURCE_PACKET_END' END AS prompt FROM packets""",
    "count_advice": """WITH b AS (SELECT batch_number, count(*) AS back FROM questions WHERE question_id IS NOT NULL GROUP BY 1) SELECT batch_number,
        CASE WHEN question_count > back THEN 'This model returned too few questions for the current batch. Try Light mode at 3 questions per prompt. If it still struggles, turn on compact response mode.'
        WHEN question_count < back THEN 'This model returned too many questions for the current batch. Try Light mode at 3 questions per prompt. If it still struggles, turn on compact response mode.' END AS advice FROM prompt_batches JOIN b USING (batch_number) WHERE question_count IS NOT NULL""",
    "parse_standard": f"""WITH {_RESPONSES} SELECT response, i::INTEGER AS q_index, {trimmed("question")} AS question, {_TRIM_OPTIONS} AS options, {trimmed("answer")} AS correct_answer, CASE WHEN page = '' THEN 'unknown' ELSE page END AS page FROM m JOIN judged USING (response) WHERE ok""",
    "parse_compact": f"""WITH {_COMPACT} SELECT response, i::INTEGER AS q_index, {trimmed("question")} AS question, {_TRIM_OPTIONS} AS options, {trimmed("answer")} AS correct_answer, CASE WHEN page = '' THEN 'unknown' ELSE page END AS page FROM cm JOIN cv USING (response) WHERE len(told) = 0""",
    "compact_errors": f"WITH {_COMPACT} SELECT response, array_to_string(told, chr(10)) AS errors FROM cv WHERE len(told) > 0",
    "parse_errors": f"""WITH {_RESPONSES} SELECT response, CASE kind WHEN 4 THEN '{_NO_JSON}' WHEN 5 THEN '{_EMPTY}' ELSE array_to_string(told,
        chr(10)) END AS errors FROM judged WHERE NOT ok AND kind <> 6
        UNION ALL SELECT response, array_to_string(list_transform(range(n), lambda i: array_to_string(['questions.' || i || '.question: Required',
          'questions.' || i || '.options: Required', 'questions.' || i || '.correctAnswer: Required', 'questions.' || i || '.explanation: Required',
          'questions.' || i || '.source.file: Required', 'questions.' || i || '.source.page: Required', 'questions.' || i || '.source.chunkId: Required'],
          chr(10))), chr(10))
        FROM judged JOIN (SELECT response, count(*) AS n FROM m GROUP BY 1) USING (response) WHERE NOT ok AND kind = 6""",
    "correct_index": """SELECT question_id, (CASE q_index % 4 WHEN 0 THEN CASE WHEN question_id % 7 - 1 BETWEEN 0 AND 3 THEN question_id % 7 - 1
        WHEN question_id % 7 - 1 = 4 THEN 3 END WHEN 1 THEN CASE WHEN question_id % 6 < 4 THEN question_id % 6 END
        WHEN 2 THEN CASE WHEN question_id % 6 < 4 THEN question_id % 6 WHEN question_id % 6 = 4 THEN 3 END END)::INTEGER AS correct_index FROM questions WHERE q_index IS NOT NULL AND question_id IS NOT NULL""",
    "rebalance_answers": f"SELECT question_id, array_to_string(list_transform(new_options, lambda v: coalesce(v, '<null>')), '|') AS options FROM {moved('question_id', 'questions')} WHERE question_id IS NOT NULL",
    "position_histogram": """WITH p AS (SELECT coalesce(list_position(options, correct_answer), 0) - 1 AS position FROM questions), r
        AS (SELECT unnest(range((SELECT max(len(options)) FROM questions)))::INTEGER AS position)
        SELECT r.position, count(p.position) AS n FROM r LEFT JOIN p ON p.position = r.position GROUP BY 1""",
    "duplicate_options": f"""SELECT question_id FROM (SELECT question_id, CASE WHEN question_id % 5 = 0
        AND len(options) > 1 THEN list_concat(list_concat(options[1:1], [' ' || options[1] || ' ']), options[3:]) ELSE options END AS options FROM questions
        WHERE question_id IS NOT NULL)
        WHERE len(list_distinct(list_transform(options, lambda v: lower({trimmed("v")})))) + CASE WHEN list_count(options) < len(options) THEN 1 ELSE 0 END < len(options)""",
    "batch_notes": f"""WITH q AS (SELECT batch_number, {STEM} AS stem, coalesce(len(options), 0) AS k, list_position(options, correct_answer) AS pos,
          coalesce(len(list_distinct(list_transform(options, lambda v: lower({trimmed("v")})))) + CASE WHEN list_count(options) < len(options) THEN 1
            ELSE 0 END < len(options), false) AS rep FROM questions WHERE batch_number IS NOT NULL AND question_id IS NOT NULL),
        f AS (SELECT stem, min(batch_number) AS first FROM q GROUP BY 1), a AS (SELECT batch_number,
          count(DISTINCT stem) FILTER (first = batch_number) AS added FROM q JOIN f USING (stem) GROUP BY 1),
        c AS (SELECT batch_number, count(*) AS parsed, max(k) AS k, count_if(rep) AS rep FROM q GROUP BY 1), t AS (SELECT batch_number, max(n) AS most
          FROM (SELECT batch_number, pos, count(*) AS n FROM q WHERE pos > 0 GROUP BY 1, 2) GROUP BY 1),
        o AS (SELECT p.batch_number, p.question_count, c.*, added, most, coalesce(c.batch_number % 7 > 0, false) AS ok FROM prompt_batches p LEFT
          JOIN c USING (batch_number) LEFT JOIN a USING (batch_number) LEFT JOIN t USING (batch_number) WHERE p.question_count IS NOT NULL)
        SELECT batch_number, question_count, CASE WHEN ok THEN 'parsed' ELSE 'pending' END AS status, (CASE WHEN ok THEN added
          ELSE 0 END)::BIGINT AS added, (CASE WHEN ok THEN parsed - added ELSE 0 END)::BIGINT AS duplicates, CASE WHEN NOT ok THEN ''
          ELSE array_to_string(list_filter([
          CASE WHEN parsed > question_count THEN 'Accepted ' || parsed || ' questions for a target of ' || question_count || ' (' || (parsed - question_count) || ' over target).' WHEN parsed < question_count THEN 'Accepted ' || parsed || ' questions for a target of ' || question_count || ' (' || (question_count - parsed) || ' under target).' END,
          CASE WHEN parsed >= k AND most / parsed >= 0.6 THEN 'Detected answer-position skew and redistributed correct options across A-D.' END,
          CASE WHEN rep > 0 THEN 'Detected ' || rep || CASE WHEN rep = 1 THEN ' question' ELSE ' questions' END || ' with duplicate option text. Review before export.' END], lambda v: v IS NOT NULL), ' ') END AS notes FROM o""",
    "merge_bank": f"SELECT question_id, {STEM} AS stem FROM questions WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {STEM} ORDER BY question_id) = 1",
    "merge_report": f"""WITH s AS (SELECT {STEM} AS stem, coalesce(batch_number <= 20, false) AS old FROM questions) SELECT count(DISTINCT stem) AS kept, count(DISTINCT stem) - count_if(old)::BIGINT AS added, count(*) - count(DISTINCT stem) AS duplicates FROM s""",
    "accept_batches": f"""WITH q AS (SELECT *, {STEM} AS stem FROM questions WHERE batch_number IS NOT NULL), f AS (SELECT stem,
        min(batch_number) AS b FROM q GROUP BY 1),
        o AS (SELECT batch_number, (SELECT count(*) FROM f WHERE f.b < x.batch_number) AS off FROM (SELECT DISTINCT batch_number FROM q) x), j
          AS (SELECT q.*, off FROM q JOIN o USING (batch_number))
        SELECT question_id, array_to_string(list_transform(new_options, lambda v: coalesce(v, '<null>')), '|') AS options FROM {moved('off + question_id', 'j')} QUALIFY row_number() OVER (PARTITION BY stem ORDER BY batch_number, question_id) = 1""",
    "option_counts": "SELECT DISTINCT len(options)::INTEGER AS option_count FROM questions WHERE options IS NOT NULL",
    "keyed_edits": "SELECT question_id, question, CASE WHEN question_id % 10 = 0 THEN 'Edited.' ELSE explanation END AS explanation FROM questions WHERE question_id IS NOT NULL",
    "export_csv_lines": f"SELECT question_id + 1 AS number, {_CSV} AS line FROM questions WHERE question_id IS NOT NULL",
    "storage_key_hash": f"""SELECT question_id, {hashed("question")} AS hash FROM questions WHERE question IS NOT NULL AND question_id IS NOT NULL""",
    "export_json": _PAYLOADS,
    "html_pages": f"""SELECT batch_number,
        '<!doctype html>' || chr(10) || '<html lang="en">' || chr(10) || '<head><meta charset="utf-8"><title>Quiz &lt;' || batch_number || '&gt; &amp; &quot;more&quot;</title></head>' || chr(10) || '<body>' || chr(10) || '<h1>Quiz &lt;' || batch_number || '&gt; &amp; &quot;more&quot;</h1>' || chr(10)
        || '<script type="application/json" id="quiz" data-key="quiz-export-state-' || {hashed("'Quiz <' || batch_number || '> & \"more\"|' || payload")} || '">' || replace(replace(replace(payload, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') || '</script>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS page FROM ({_PAYLOADS})""",
    "storage_keys": f"""SELECT batch_number, 'quiz-export-state-' || {hashed("'Quiz|' || payload")} AS key FROM ({_PAYLOADS})""",
    "text_escapes": """SELECT question_id, replace(replace(replace(replace(replace(explanation, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"',
        '&quot;'), '''', '&#39;') AS html,
        replace(replace(replace(explanation, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS script, regexp_replace(regexp_replace(lower(coalesce(source.file, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM questions WHERE explanation IS NOT NULL AND question_id IS NOT NULL""",
    "quiz_state": f"WITH {EVENTS} SELECT * FROM an",
    "miss_marks": f"WITH {EVENTS} SELECT * FROM ma",
    "missed_summary": f"WITH {EVENTS} SELECT learner, count(*) AS missed, count_if(NOT coalesce(correct, false))::BIGINT AS pending, count_if(coalesce(correct, false))::BIGINT AS corrected FROM ma LEFT JOIN an USING (learner, q_index) GROUP BY 1",
    "next_missed": f"WITH {EVENTS} SELECT learner, q_index, lead(q_index) OVER (PARTITION BY learner ORDER BY q_index) AS next_index FROM ma",
    "next_question": """WITH q AS (SELECT DISTINCT batch_number, q_index FROM questions WHERE batch_number IS NOT NULL AND q_index IS NOT NULL
        AND question_id IS NOT NULL)
        SELECT batch_number, q_index, lead(q_index) OVER w AS next_index, 'Question ' || row_number() OVER w || ' of ' || count(*) OVER (PARTITION BY batch_number) AS label FROM q WINDOW w AS (PARTITION BY batch_number ORDER BY q_index)""",
    "state_snapshot": f"""WITH {EVENTS}, a AS (SELECT learner, string_agg('[' || q_index || ',{{' || CASE WHEN selected IS NULL THEN ''
        ELSE '"selected":' || to_json(selected)::VARCHAR || ',' END || '"correct":' || correct || ',"attempts":' || attempts || '}}]', ','
        ORDER BY q_index) AS a FROM an GROUP BY 1),
        m AS (SELECT learner, string_agg('[' || q_index || ',' || marks || ']', ',' ORDER BY q_index) AS m FROM ma GROUP BY 1) SELECT learner, '{{"answers":[' || coalesce(a, '') || '],"missMarks":[' || coalesce(m, '') || ']}}' AS state FROM a FULL JOIN m USING (learner)""",
    "scale_factors": "SELECT p_partkey, round(least(3.0::DOUBLE, greatest(1.0::DOUBLE, 1800 / greatest(p_size * 53, 1))), 6) AS factor FROM part",
    "contrast": f"{_CONTRAST} SELECT p_brand, p_partkey AS place, (CASE WHEN v <= 12 THEN 0 WHEN v >= 245 THEN 255 ELSE v END)::INTEGER AS value FROM st",
    "contrast_binary": f"""{_CONTRAST}, h2 AS (SELECT p_brand, v, count(*) AS n FROM st GROUP BY 1, 2), r2 AS (SELECT *,
        (sum(n) OVER w)::DOUBLE AS wb, (sum(v * n) OVER w)::DOUBLE AS sb, (sum(n) OVER p)::DOUBLE AS nn, (sum(v * n) OVER p)::DOUBLE AS tt FROM h2 WINDOW w
        AS (PARTITION BY p_brand ORDER BY v), p AS (PARTITION BY p_brand)),
        b AS (SELECT p_brand, v AS level FROM r2 WHERE nn > wb QUALIFY row_number() OVER (PARTITION BY p_brand
          ORDER BY wb * (nn - wb) * (sb / wb - (tt - sb) / (nn - wb)) * (sb / wb - (tt - sb) / (nn - wb)) DESC, v) = 1)
        SELECT p_brand, p_partkey AS place, CASE WHEN v >= coalesce(level, 127) THEN 255 ELSE 0 END AS value FROM st LEFT JOIN b USING (p_brand)""",
    "histogram_percentile": """WITH h AS (SELECT p_brand, p_size AS v, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *,
        sum(n) OVER (PARTITION BY p_brand ORDER BY v) AS run, sum(n) OVER (PARTITION BY p_brand) AS total FROM h)
        SELECT p_brand, min(v) FILTER (run >= total * 0.02::DOUBLE) AS low, min(v) FILTER (run >= total * 0.98::DOUBLE) AS high FROM r GROUP BY 1""",
    "otsu_threshold": """WITH h AS (SELECT p_brand, p_size AS v, count(*) AS n FROM part GROUP BY 1, 2),
        r AS (SELECT *, (sum(n) OVER w)::DOUBLE AS wb, (sum(v * n) OVER w)::DOUBLE AS sb, (sum(n) OVER p)::DOUBLE AS nn,
          (sum(v * n) OVER p)::DOUBLE AS tt FROM h WINDOW w AS (PARTITION BY p_brand ORDER BY v), p AS (PARTITION BY p_brand)),
        x AS (SELECT p_brand, v, wb * (nn - wb) * (sb / wb - (tt - sb) / (nn - wb)) * (sb / wb - (tt - sb) / (nn - wb)) AS var FROM r WHERE nn > wb)
        SELECT p_brand, v::INTEGER AS threshold FROM x QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY var DESC, v) = 1""",
}
