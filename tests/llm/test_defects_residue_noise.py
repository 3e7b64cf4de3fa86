import numpy as np
import pytest

from pagemill.llm import pair_defects, residue, scan_noise
from pagemill.llm.spelling import Trie, skeleton

Q = "Which term names a budget that indicates every rare forklift?"
O = ["The pattern of the Pelvik deficit", "Through a major standard and 97 barriers", "No"]


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        (None, "empty_answer"), ("  ", "empty_answer"), ("—", "empty_answer"), ("N/A", "empty_answer"), ("(no answer)", "empty_answer"),
        ("No", None), ("7 %", None), (O[0], None), (O[0] + ".", None),
        (Q.upper(), "copies_question"), (f"“{Q}”", "copies_question"), (f"{Q} {Q}", "copies_question"), (f"Question: {Q}", "copies_question"), (
            f'The question "{Q}" has one answer: the text links both terms here.',
            None
        ),
        ("I'm sorry, but I can't give a reliable answer.", "refusal"), ("Je préfère ne pas répondre.", "refusal"), (
            "Dazu kann ich leider keine Erklärung schreiben.",
            "refusal"
        ), ("This content can't be generated.", "refusal"),
        ('The letter ends with "I am unable to attend", so the boundary was moved.', None), ("The geyser is sorry and cannot answer, the dialogue says.", None),
        (
            "Porque la costa debilita el mercado de Fenmar",
            "other_language"
        ), ("因为网络解释病人", "other_language"), ("Потому что суд определяет процесс", "other_language"),
        ("Through a (ty", "truncated"), ("The text links the", "truncated"), ("The process of 1962 refused rapid clients,", "truncated"),
    ],
)
def test_defects_of_one_answer(answer, defect):
    got = {d for d, tail in pair_defects.defects(Q, O, answer, "The text links both terms in the chapter.") if tail is None}
    assert got == ({defect} if defect else set())


def test_language_asked_for():
    asked = "Which Portuguese term does the glossary give for the dense list?"
    assert not {d for d, tail in pair_defects.defects(asked, [], "o rio / a rede", "The glossary is the source of it.") if tail is None}
    assert ("other_language", None) in set(pair_defects.defects(asked, [], "das Dorf / der Kern", "The glossary is the source of it."))


def test_vocabulary_tells_pieces_of_words(spark):
    full = "The passage compares the frontier with the boundary."
    rows = [(i, Q, O, O[0], full) for i in range(30)] + [
        (100, Q, O, O[0], "The passage compares the fron"),
        (101, Q, O, O[0], "The passage compares the frontier with the boundary"),
        (102, Q, O, O[0], "The passage compares"),
        (103, None, None, None, None),
        (103, None, None, None, None)
    ]
    df = spark.createDataFrame(
        [(*r, 1) for r in rows],
        "question_id long, question string, options array<string>, correct_answer string, explanation string, defect int"
    )
    assert {tuple(r) for r in pair_defects.pair_defects(df).collect()} == {(100, "truncated"), (102, "truncated"), (103, "empty_answer")}
    assert pair_defects.pair_defects(df.limit(0)).count() == 0


ORDINARY = [
    f"The {a} {b} weakens the method when the record is {c}." for a in ("dense", "rare", "legal") for b in (
        "river",
        "border",
        "market",
        "nerve"
    ) for c in ("late", "early", "annual")
]
CASES = [
    ("404 Not Found", True), (
        "The Dune Manual\n\nPage not found.\n\nHome | Courses | Sign in",
        True
    ), ("Please enable JavaScript to run this app.\n" + ORDINARY[0], True), ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", True),
    (f"{ORDINARY[0]} Dear {{{{first_name}}}}, welcome. {ORDINARY[1]} {ORDINARY[2]}", True), (f"{ORDINARY[3]} Teacher: [insert name here] {ORDINARY[4]}", True),
    (" ".join(ORDINARY[:4]), False), ("Status 404 means that a server knows no resource.", False), (
        f'A notice such as "please enable JavaScript" helps nobody. {ORDINARY[5]}',
        False
    ), ("The notation {{x}} denotes a variable in many languages.", False),
    (
        f"The matrix entry A[i][j] and the list [[1, 2], [3]] appear in exercise 9. {ORDINARY[6]}",
        False
    ), (
        "Students fill in the blanks: the forecast regulates ____.",
        False
    ), ('{"questions": [{"question": "{{x}}"}]}', False), ("", False), (" \n", False), (None, False), (ORDINARY[7] * 2000, False),
]


def test_residue_documents(spark):
    rows = [(i, t, "s1") for i, (t, _) in enumerate(CASES)]
    filler = [
        "403 Forbidden",
        "Access denied.",
        "Please sign in again.",
        "Sample text sample text sample text.",
        "You need to turn on JavaScript to run this app.",
        "Hello ${user}, your result for {{ quiz }} is ready.",
        "Something went wrong.",
        "Lorem ipsum dolor sit amet."
    ]
    rows += [(1000 + k, ORDINARY[k % 36] if k % 2 else filler[k // 2 % 8], f"src{k % 7}") for k in range(200)] + [(None, "404 Not Found", None)]
    # the classifier has to have met texts that speak of such things
    speaking = [
        "Status 500 means that a server has failed.",
        'A reply such as "access denied" is no answer.',
        "The notation {{y}} stands for a name.",
        "Error 403 means that a reader may not see the page.",
        "The entry B[k] and the set {a, b} stand in exercise 4."
    ]
    rows += [(2000 + k, f"{speaking[k % 5]} {ORDINARY[k % 36]}" if k % 3 else speaking[k % 5], f"src{k % 7}") for k in range(60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, found int")
    found = residue.residue_documents(df)
    got = {r["doc_id"] for r in found.collect()}
    for i, (text, wanted) in enumerate(CASES):
        assert (i in got) == wanted, text
    assert residue.without_residue(df, found).where("doc_id < 100").count() == sum(not w for _, w in CASES)
    stays = residue.without_residue(df, found)
    assert sorted(map(str, residue.corpus(df, ["doc_id", "text", "found"]).collect())) == sorted(map(str, stays.select("doc_id", "text", "found").collect()))
    _, report = residue.train(df)
    assert report["slot_recall"] >= 0.9 or report["held_out_units"] < 5
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_classifier_generalises_beyond_its_labels():
    texts = ORDINARY + ["Page not found.", "Lesson not found.", "Document not found.", "The file could not be loaded."] * 4
    units = residue.Units(texts, [False] * len(texts))
    model = residue.fit(units, np.array([residue.weak_label(t) for t in texts]))
    assert model.scores(residue.Units(["The lesson could not be shown or found.", ORDINARY[9]], [False, False]))[:, 1].argmax() == 0


def test_trie_is_complete():
    import itertools
    import random

    rng = random.Random(4)
    words = {"".join(rng.choice("abcdlimnr") for _ in range(rng.randint(1, 5))) for _ in range(150)}
    trie = Trie(words)

    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    for _ in range(100):
        token = "".join(rng.choice("abcdlimnr") for _ in range(rng.randint(1, 5)))
        got = trie.search(token, 1, plain=True)
        assert {w for w in words if distance(token, w) <= 1} <= set(got)
    assert Trie(["modern", "charter", "domain"]).search("moclem") == {"modern": 2}
    assert Trie(["modern"]).search("moderni") == {} and Trie(["they"]).search("t~hey") == {"they": 1}
    assert skeleton("Pena1ties") == skeleton("PENALTIES") and skeleton("Gcysers") == skeleton("Geysers")


CLEAN = [
    "The general boundary follows the textbook. A long-term method helps the market, and the record ends.",
    "Students compare the general record with the market boundary. Level B12 of the textbook follows the method."
]
SCAN = [
    "Chapter 1: The River in Practice\n\nThe gene-\nral boundary fol1ows the textbook. A long-\nterm method helps the rnarket\nin 1908-\n1910.",
    "The River in Practice\n- 2 -\nStudents compare the gen^eral\nrecord with the mar­\n  ket boundary. Level B12\nends.",
    "The Rivcr in Practice\n- 3 -\nA general record ends.\n\nTable 4\n85\n12.5",
    "Level B12 of the textbook\n\n4"
]


def noise_tables(spark):
    pages = [(i, 0, "clean.pdf", i, None, CLEAN[i % 2], False, 9) for i in range(40)] + [
        (100 + i, 1, "the_river_1.pdf", i, i + 1, t, i != 1, 9) for i,
        t in enumerate(SCAN)
    ] + [(200, 1, None, 9, None, None, None, 9)]
    chunks = [
        (7, "The River 1.pdf", 1, "The gene-\nral boundary fol1ows the textbook."),
        (7, "The River 1.pdf", 1, "The gene-\nral boundary fol1ows the textbook."),
        (8, "clean.pdf", None, "The gene-\nral rule."),
        (9, "the_river_1.pdf", None, None),
        (10, "elsewhere.pdf", 1, "x-\ny")
    ]
    return (
        spark.createDataFrame(pages, "page_id long, file_index int, file_name string, page_seq int, page_number int, text string, from_ocr boolean, word int"),
        spark.createDataFrame(chunks, "source_order long, file_name string, page int, raw_text string"),
    )


def test_scan_noise(spark):
    pages, chunks = noise_tables(spark)
    got = {tuple(r) for r in scan_noise.scan_noise(pages, chunks).collect()}
    p = "pdf_pages"
    assert got == {
        (p, 100, 2, "hyphen_break"), (p, 100, 3, "misread"), (p, 100, 4, "misread"),
        (p, 101, 0, "running_head"), (p, 101, 1, "page_number"), (p, 101, 2, "misread"), (p, 101, 3, "hyphen_break"),
        (p, 102, 0, "running_head"), (p, 102, 1, "page_number"), (p, 103, 2, "page_number"),
        ("chunks", 7, 0, "hyphen_break"), ("chunks", 7, 1, "misread"),
    }
    assert scan_noise.scan_noise(pages.limit(0), chunks).count() == 0
    assert scan_noise.scan_noise(pages, chunks.limit(0)).where("record_table = 'chunks'").count() == 0


def test_repair(spark):
    pages, chunks = noise_tables(spark)
    got = {(r["record_table"], r["record_id"]): r["text"] for r in scan_noise.repaired_texts(pages, chunks).collect()}
    assert got[("pdf_pages", 101)] == "Students compare the general record with the market boundary. Level B12 ends."
    assert got[("chunks", 7)] == "The general boundary follows the textbook."
    assert got[("pdf_pages", 100)] == "Chapter 1: The River in Practice\n\nThe general boundary follows the textbook. A long-term method helps the market in 1908-1910."
    assert ("chunks", 8) not in got and ("pdf_pages", 0) not in got


@pytest.mark.parametrize(
    ("lines", "i", "wanted"),
    [
        (["- 3 -", "Text here."], 0, True),
        (["Text.", "xlvii"], 1, True),
        (["Head", "7 / 12", "Text."], 1, True),
        (["Table 4", "85", "Text."], 1, False),
        (["A", "12", "B", "C"], 1, True),
        (["A.", "b c", "d", "85", "12.5"], 4, False),
        (["Text."], 0, False)
    ]
)
def test_number_lines(lines, i, wanted):
    assert scan_noise.is_number_line(lines, i) == wanted


def test_misreadings_off_the_table_of_confusions(spark):
    import itertools
    import random

    rng = random.Random(5)
    words = {"".join(rng.choice("aoxk") for _ in range(rng.randint(5, 9))) for _ in range(60)}

    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    for _ in range(40):
        token = "".join(rng.choice("aoxk") for _ in range(rng.randint(5, 9)))
        assert {w: n for w in words if (n := distance(token, w)) <= 2} == Trie(words).search(token, 2, plain=True)

    counts = {"modern": 300, "recognition": 300, "record": 300, "the": 900, "section": 300, "records": 3}


    def near(token, own=1):
        found = {fix: n for fix, n in scan_noise.confused(token, own, Trie(counts), counts)}
        if found or token in counts:
            return found
        made = scan_noise.edited(token, own, Trie(counts), counts)
        return {fix: n for fix, n, place in made if place == min(p for *_, p in made)}

    assert near("moderni") == {"modern": 1} and near("recgnition") == {"recognition": 1} and near("rocord") == {"record": 1} and near("rekogniton") == {"recognition": 2}
    assert near("toe") == {} and near("section12") == {} and near("records") == {} and near("moderni", 20) == {}

    pages, chunks = noise_tables(spark)
    more = spark.createDataFrame(
        [(104, 1, "the_river_1.pdf", 9, 9, "The generl record follows the textbok\nand the marcket ends here.", True, 9)],
        pages.schema
    )
    got = {tuple(r) for r in scan_noise.scan_noise(pages.unionByName(more), chunks).where("record_id = 104").collect()}
    assert got == {("pdf_pages", 104, 0, "misread"), ("pdf_pages", 104, 1, "misread")}
    texts = {r["record_id"]: r["text"] for r in scan_noise.repaired_texts(pages.unionByName(more), chunks).collect()}
    assert texts[104] == "The general record follows the textbook and the market ends here."


def test_line_ends_meet_the_whole_vocabulary(spark, monkeypatch):
    pages, chunks = noise_tables(spark)
    more = spark.createDataFrame(
        [
            (50, 0, "clean.pdf", 50, None, "The book whereupon he wrote where it stands upon the shelf.", False, 9),
            (
                105,
                1,
                "the_river_1.pdf",
                9,
                9,
                "The method where-\nupon a long-\nterm record\nends. The grat-\nning of level3-\nb follows the gen^e-\nral text-\nmarket.",
                True,
                9
            )
        ], pages.schema
    )
    tables = pages.unionByName(more), chunks
    whole = {tuple(r) for r in scan_noise.scan_noise(*tables).collect()}
    assert {r[2:] for r in whole if r[1] == 105} >= {(0, "hyphen_break")} and not {
        (1, "hyphen_break"),
        (4, "hyphen_break")
    } & {r[2:] for r in whole if r[1] == 105}
    texts = {tuple(r) for r in scan_noise.repaired_texts(*tables).collect()}
    for few in (1, 12):
        monkeypatch.setattr(scan_noise, "COMMON", few)
        assert {tuple(r) for r in scan_noise.scan_noise(*tables).collect()} == whole
    assert {tuple(r) for r in scan_noise.repaired_texts(*tables).collect()} == texts


def test_repair_of_numbers_and_names(spark):
    pages, chunks = noise_tables(spark)
    text = "In l971, 1B90, 18g8 and 19^71\nthe market of Fen^mar, Dolb3ry\nand Kar4nok ends (20Z2)."
    more = spark.createDataFrame([(106, 1, "the_river_1.pdf", 9, 9, text, True, 9)], pages.schema)
    cut = spark.createDataFrame([(11, "The River 1.pdf", 1, text)], chunks.schema)
    tables = pages.unionByName(more), chunks.unionByName(cut)
    assert {
        (r["line_no"], r["noise"]) for r in scan_noise.scan_noise(*tables).where("record_id = 106").collect()
    } == {(0, "misread"), (1, "misread"), (2, "misread")}
    texts = {r["record_id"]: r["text"] for r in scan_noise.repaired_texts(*tables).collect()}
    assert texts[106] == texts[11] == "In 1971, 1890, 1898 and 1971 the market of Fenmar, Dolbery and Kar4nok ends (2022)."


def test_validation_covers_whole_documents(spark):
    unseen = next(f"u{k}" for k in range(99) if residue.is_unseen(f"u{k}"))
    seen = next(f"u{k}" for k in range(99) if not residue.is_unseen(f"u{k}"))
    late = " ".join(ORDINARY[:4] * 25) + " Dear {{first_name}}, welcome to the course."
    assert len(late) > 4000
    rows = [(i, late, unseen) for i in range(30)] + [
        (100 + i, f"{ORDINARY[i]} Hello ${{user}}, {{{{ quiz }}}} is ready.", seen) for i in range(30)
    ] + [(200, None, unseen), (None, late, unseen)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    model, report = residue.train(df, 40)
    assert report["held_out_units"] == 30 * 101 and report["units"] == 30 * 101 + 60
    whole = residue.units_of(late)
    labels, found = np.array([residue.weak_label(u) for u in whole.texts]), model.scores(whole) > 0
    assert (labels == 1).sum() == 1 and report["slot_recall"] == float(found[labels == 1, 0].mean())
    assert residue.validation(df.limit(0), model)["units"] == 0


@pytest.mark.parametrize(
    ("answer", "wanted"),
    [
        ("Извините, я не могу ответить на этот вопрос.", {"refusal", "other_language"}), ("抱歉，我无法回答这个问题。", {"refusal", "other_language"}), (
            "Lo siento, no puedo responder porque el texto no lo dice y los datos de la tabla faltan.",
            {"refusal", "other_language"}
        ),
        ("I'm sorry, but I can't give an answer because the", {"refusal", "truncated"}), ("I cannot answer this question (the text", {"refusal", "truncated"}),
        (f"La pregunta es: {Q}", {"copies_question"}), (
            "Which term names a budget that",
            {"copies_question", "truncated"}
        ), (Q.rstrip("?"), {"copies_question"}), ("I'm sorry, but I can't give a reliable answer.", {"refusal"}),
    ],
)
def test_every_defect_of_one_answer(answer, wanted):
    assert {d for d, tail in pair_defects.defects(Q, O, answer, "The text links both terms in the chapter.") if tail is None} == wanted


def test_shards_lose_no_candidate(spark, monkeypatch):
    import random

    from pagemill.llm.spelling import CONFUSIONS

    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdlimnrue") for _ in range(rng.randint(2, 12))) for _ in range(400)})

    def noisy(word):
        for _ in range(rng.randint(1, 2)):
            seen, meant = rng.choice([(s, m) for s, ms in CONFUSIONS.items() for m in ms])
            at = rng.randrange(len(word))
            word = rng.choice([word.replace(meant, seen, 1), word[:at] + "*" + word[at:], word[:at] + "x" + word[at + 1 :], word[:at] + word[at + 1 :] or "x"])
        return word

    tokens = sorted({noisy(w) for w in words for _ in range(2)})
    counts = dict.fromkeys(words, 10_000)
    trie = Trie(words)
    confused = {(t, w, n) for t in tokens for w, n in scan_noise.confused(t, 1, trie, counts)}
    edited = {(t, *x) for t in tokens for x in scan_noise.edited(t, 1, trie, counts)}
    given = spark.createDataFrame([(t, 1) for t in tokens], "word string, n long"), spark.createDataFrame([*counts.items()], "word string, n long")
    for shard, block in ((20_000, 2_000), (40, 30)):
        monkeypatch.setattr(scan_noise, "SHARD", shard)
        monkeypatch.setattr(scan_noise, "BLOCK", block)
        assert {tuple(r) for r in scan_noise.look_up(*given).select("word", "fix", "errors").collect()} == confused
        assert {tuple(r) for r in scan_noise.look_up(*given, plain=True).select("word", "fix", "errors", "place").collect()} == edited
    assert scan_noise.look_up(given[0].limit(0), given[1]).count() == scan_noise.look_up(given[0], given[1].limit(0)).count() == 0


def test_word_map_holds_every_word(spark):
    words = [f"wörd{k}" for k in range(500)] + ["", "日本"]
    near = scan_noise._Mapped(scan_noise.word_map(spark.createDataFrame([(w,) for w in words], "word string")))
    assert all(near[w] for w in words) and sum(near[f"other{k}"] for k in range(500)) < 5
