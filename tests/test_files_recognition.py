import io
import zipfile

from pyspark.sql import functions as F

from pagemill.operators import recognition
from pagemill.settings import Limits
from pagemill.sources import files, readers


def test_limits_in_order(spark):
    rows = [(i, f"f{i}.pdf", 10) for i in range(61)] + [(1000, "x.txt", 1)]
    rows[3] = (3, "a.txt", 10)
    rows[4] = (4, "b.JPEG", 30 * 1024 * 1024 + 1)
    rows[5] = (5, "c.pdf", 30 * 1024 * 1024)
    got = {r["file_index"]: r["message"] for r in files.rejected(spark.createDataFrame(rows, "file_index int, file_name string, file_size long")).collect()}
    assert got[60] == got[1000] == files.TOO_MANY and got[3] == files.UNSUPPORTED and got[4] == "File is too large (>30 MB)." and got[5] is None


def test_filters_reach_the_scan(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    read = files.read_files(spark, str(tmp_path)).where("length <= 31457280").select("file_name")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length" in plan and read.count() == 1


def docx(path, body, notes=None):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(path, "w") as box:
        for name, paragraphs in (("document", body), ("footnotes", notes)):
            if paragraphs is not None:
                inner = "".join(f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in p)}</w:p>" for p in paragraphs)
                box.writestr(f"word/{name}.xml", f'<w:document xmlns:w="{w}"><w:body>{inner}</w:body></w:document>')


def test_docx_pages_and_errors(spark, tmp_path):
    buffer = io.BytesIO()
    docx(buffer, [["Hello", "world."], [" "], ["Next one."]], [["A note."]])
    rows = [(0, "a.docx", "docx", buffer.getvalue()), (1, "b.docx", "docx", b"no zip"), (2, "c.png", "image", b"1")]
    df = spark.createDataFrame(rows, "file_index int, file_name string, format string, content binary")
    got = [tuple(r) for r in readers.read_pages(df, limits=Limits(retries=1), wait=0).orderBy("file_index", "page_seq").collect()]
    assert got[0][2:5] == (0, None, "Hello world. Next one.") and got[1][2:5] == (1, None, "A note.")
    assert got[2][5].startswith(
        'Failed to process "b.docx" after 2 attempt(s): '
    ) and got[3][5] == 'Failed to process "c.png" after 2 attempt(s): Image OCR is disabled, so "c.png" could not be read.'


def test_merge_and_notes():
    assert readers.merge_text("", "b") == "b" and readers.merge_text("Abc", "aBC") == "Abc" and readers.merge_text("abc", "xABCx") == "xABCx" and readers.merge_text("a", "b") == "a b"
    assert readers.skipped_note("page", [1, 2, 3, 4, 5, 6]) == "Ignored low-quality OCR output on 6 pages (1, 2, 3, 4, 5, ...)."


def test_states_and_totals(spark):
    row = spark.range(1).select(
        files.final_state(F.lit(0), F.array(), F.lit(1)).alias("a"),
        files.final_state(F.lit(2), F.array(F.lit("w")), F.lit(0)).alias("b"),
        files.final_state(F.lit(2), F.array(), F.lit(2)).alias("c")
    ).first()
    assert tuple(row["a"]) == ("warning", "No usable chunks extracted from this file. OCR used on 1 page.")
    assert tuple(row["b"]) == ("warning", "Completed with warning (2 chunks).") and tuple(row["c"]) == (
        "completed",
        "Completed (2 chunks). OCR used on 2 pages."
    )
    pages = spark.createDataFrame([(0, "x" * 219), (0, ""), (0, None), (1, "y" * 220)], "file_index int, text string")
    assert {tuple(r) for r in files.file_totals(pages).collect()} == {(0, 1, 219, True), (1, 1, 220, False)}


def test_histograms(spark):
    single = spark.createDataFrame([("a", 9, 5), ("b", 0, 5), ("b", 200, 5)], "k string, value int, n int")
    got = {r["k"]: r["threshold"] for r in recognition.otsu_threshold(single, ["k"]).collect()}
    assert got == {"a": 127, "b": 0}
    low = {r["k"]: r["value"] for r in recognition.histogram_percentile(single, 0.6, ["k"]).collect()}
    assert low == {"a": 9, "b": 200}


def test_quality(spark):
    good = [("plain", 90.0, True), ("words", 88.0, True), ("here", 92.0, True)]
    df = spark.createDataFrame(
        [(1, "plain words here", 90.0, good), (2, "", 10.0, []), (3, "§§ ¤¤ ¤¤ ##", 20.4, [("§§", 5.0, False)])],
        "k int, text string, confidence double, words array<struct<text string, confidence double, in_dictionary boolean>>"
    )
    got = {r["k"]: r for r in recognition.page_quality(df).collect()}
    assert got[1]["usable"] and got[1]["warning"] is None and not got[2]["usable"] and got[2]["warning"] == "OCR did not detect readable text."
    assert got[3]["warning"] == "Ignored low-confidence OCR output (20% confidence)."
    both = recognition.page_quality(df)
    best = {r["k"]: r["text"] for r in recognition.best_attempt(both, both, "k").collect()}
    assert best == {1: "plain words here", 2: "", 3: ""}
    assert recognition.page_quality(df.limit(0)).count() == 0


def made_recognizer():
    def recognize(image):
        if image == b"broken":
            raise RuntimeError("no engine")
        text = image.decode()
        return readers.Recognized(text, not text.startswith("?"), "low" if text.startswith("?") else None)

    return recognize


LONG = "A text layer that is long enough to stand alone."


def pdf_pages(_, content):
    for number, line in enumerate(content.decode().split("\n"), 1):
        layer, _, image = line.partition("|")
        yield number, layer, lambda image=image: image.encode()


def test_pdf_pages_fall_back_until_recognition_breaks():
    given = f"{LONG}|never asked\nshort|Short text of a scan\n|?noise\n|broken\n|after the break\nshort|after the break"
    made = readers.scan_pdf(pdf_pages("", given.encode()), made_recognizer())
    assert made.pages == [(1, LONG), (2, "Short text of a scan"), (6, "short")] and made.ocr_pages == 1
    assert made.warnings == ["OCR fallback stopped after page 4: no engine", "Ignored low-quality OCR output on 1 page (3)."]
    assert readers.scan_pdf(pdf_pages("", b"|x"), None) == readers.Extract([], [], 0)


def test_images_and_media(spark):
    assert readers.scan_image("a.png", b"Words", made_recognizer()) == readers.Extract([(1, "Words")], [], 1)
    assert readers.scan_image("a.png", b"?", made_recognizer()) == readers.Extract([], ["low"], 0)
    buffer = io.BytesIO()
    docx(buffer, [["Body."]])
    with zipfile.ZipFile(buffer, "a") as box:
        for name, content in (("word/media/1.png", b"Seen"), ("word/media/2.png", b"?"), ("word/media/3.jpg", b"broken"), ("word/media/x.bin", b"no")):
            box.writestr(name, content)
    made = readers.read_docx("", buffer.getvalue(), made_recognizer())
    assert made.pages == [(None, "Body."), (None, "Seen")] and made.ocr_pages == 1
    assert made.warnings == ["OCR failed on embedded DOCX image 3: no engine", "Ignored low-quality OCR output on 1 embedded DOCX image (2)."]
    assert readers.read_docx("", buffer.getvalue()).warnings == ["Embedded DOCX images were found, but OCR is disabled."]
    files_of = spark.createDataFrame(
        [(0, "a.docx", "docx", buffer.getvalue()), (1, "b.pdf", "pdf", b"|?"), (2, "c.png", "image", b"Seen")],
        "file_index int, file_name string, format string, content binary"
    )
    rows = readers.read_pages(files_of, pdf_of(), make_recognizer_of(), wait=0).orderBy("file_index", "page_seq").collect()
    assert [(r["file_index"], r["page_seq"], r["text"], r["ocr_pages"]) for r in rows] == [
        (0, 0, "Body.", 1),
        (0, 1, "Seen", 0),
        (1, None, None, 0),
        (2, 0, "Seen", 1)
    ]
    assert rows[2]["warnings"] == ["Ignored low-quality OCR output on 1 page (1)."] and rows[2]["error"] is None


def pdf_of():
    """Functions of a test module are not on the workers; one made here is sent by value."""

    def pages(_, content):
        layer, _, image = content.decode().partition("|")
        yield 1, layer, image.encode

    return pages


def make_recognizer_of():
    from pagemill.sources.readers import Recognized

    return lambda: lambda image: Recognized(image.decode(), image == b"Seen", "low")


def test_fallback_of_tables_as_of_files(spark):
    rows = [
        (0, 1, LONG, "x", True, False),
        (0, 2, "short", "Short text of a scan", True, False),
        (0, 3, "", "noise", False, False),
        (0, 4, "", "", False, True),
        (0, 5, "", "after", True, False),
        (0, 6, "short", "after", True, False),
        (1, 1, "", "fine", True, False),
        (1, 2, None, "fine", True, False)
    ]
    df = spark.createDataFrame(rows, "file_index int, page_seq int, layer string, ocr_text string, ocr_usable boolean, ocr_failed boolean")
    got = {(r["file_index"], r["page_seq"]): (r["text"], r["from_ocr"]) for r in recognition.ocr_fallback(df).collect()}
    assert got == {(0, 1): (LONG, False), (0, 2): ("Short text of a scan", True), (0, 6): ("short", False), (1, 1): ("fine", True)}


def test_contrast_by_hand(spark):
    import random

    rng = random.Random(2)
    pixels = [("i", k, rng.randint(0, 255), rng.randint(0, 255), rng.randint(0, 255)) for k in range(300)] + [("flat", k, 7, 7, 7) for k in range(5)]
    df = spark.createDataFrame(pixels, "image string, place int, red int, green int, blue int")
    shades = {("i", k): int(r * 0.299 + g * 0.587 + b * 0.114 + 0.5) for i, k, r, g, b in pixels if i == "i"}
    ordered = sorted(shades.values())
    low, high = (next(v for v in range(256) if sum(x <= v for x in ordered) >= 300 * q) for q in (0.02, 0.98))
    wanted = {key: max(0, min(255, int((v - low) * 255 / max(1, high - low) + 0.5))) if v >= low else 0 for key, v in shades.items()}
    snapped = {key: 0 if v <= 12 else 255 if v >= 245 else v for key, v in wanted.items()}
    got = {(r["image"], r["place"]): r["value"] for r in recognition.contrast(df, ["image"]).collect()}
    assert {k: got[k] for k in snapped} == snapped and {got["flat", k] for k in range(5)} == {0}
    binary = {(r["image"], r["place"]): r["value"] for r in recognition.contrast(df, ["image"], True).collect()}
    assert set(binary.values()) <= {0, 255} and binary["flat", 0] == 0


def test_run_messages(spark):
    rows = spark.createDataFrame([(0, 0), (3, 0), (61, 5), (60, 5)], "files long, chunks long")
    got = [r["m"] for r in rows.select(files.run_message(F.col("files"), F.col("chunks")).alias("m")).collect()]
    assert got[0] == files.NO_FILES and got[1] == files.NO_TEXT and got[2].startswith("Received 61 files. Only the first 60") and got[3] is None
