"""Readers that turn files into pages: DOCX by the standard library, PDF and recognition by functions given by the caller."""

from __future__ import annotations

import io
import re
import time
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from pagemill.settings import Limits

Page = tuple[int | None, str]
#: Opens a PDF: (page number, text layer, what renders the page as an image) of each page.
PdfPages = Callable[[str, bytes], Iterable[tuple[int, str, Callable[[], bytes]]]]
# fixed values
OCR_BELOW = 24
_IMAGE = re.compile(r"\.(png|jpe?g|webp|gif|bmp|tiff?)$", re.I)
PARTS = ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml")
_SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def normalize(text: str) -> str:
    """As functions.text.normalize_extracted, on one string."""
    joined = re.sub(f"-[{_SPACE}]*\n[{_SPACE}]*", "", text)
    return re.sub(f"[{_SPACE}]+", " ", joined).replace("\0", "").strip(_SPACE)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_text(xml: bytes) -> str:
    """Paragraphs, each of its text runs joined by blanks, on lines of their own; all runs if there is no paragraph."""
    root = ElementTree.fromstring(xml)
    runs = lambda node: " ".join(x.text or "" for x in node.iter() if _local(x.tag) == "t").strip(_SPACE)
    lines = [line for p in root.iter() if _local(p.tag) == "p" and (line := runs(p))]
    return normalize("\n".join(lines) if lines else runs(root))


class Recognized(NamedTuple):
    """What recognition makes of one image."""

    text: str
    usable: bool
    warning: str | None = None


class Extract(NamedTuple):
    pages: list[Page]
    warnings: list[str]
    ocr_pages: int = 0


#: Text of an image's bytes; raises if recognition itself breaks.
Recognizer = Callable[[bytes], Recognized]
_recognizers: dict[int, Recognizer] = {}


def recognizer_of(make: Callable[[], Recognizer] | None) -> Recognizer | None:
    """The recogniser of this Python worker: made once, by the first file that needs it, and kept for all later ones."""
    if make is None:
        return None
    key = zlib.crc32(repr((getattr(make, "__module__", ""), getattr(make, "__qualname__", repr(make)))).encode())
    if key not in _recognizers:
        _recognizers[key] = make()
    return _recognizers[key]


def scan_pdf(pages: Iterable[tuple[int, str, Callable[[], bytes]]], recognize: Recognizer | None = None) -> Extract:
    """Pages of (number, text layer, what renders the page), as a PDF library gives them.

    A page with little text is rendered and recognised; usable text joins its layer.  Where recognition breaks, it is off
    for the rest of the file.  Pages without text are left out.
    """
    kept, warnings, used, skipped = [], [], 0, []
    for number, layer, render in pages:
        text = normalize(layer)
        if recognize and len(text) < OCR_BELOW:
            try:
                seen = recognize(render())
            except Exception as e:  # noqa: BLE001
                recognize = None
                warnings.append(f"OCR fallback stopped after page {number}: {e or 'Unknown OCR error'}")
            else:
                if seen.usable and seen.text:
                    text, used = merge_text(text, seen.text), used + 1
                elif seen.warning:
                    skipped.append(number)
        if text:
            kept.append((number, text))
    return Extract(kept, warnings + ([skipped_note("page", skipped)] if skipped else []), used)


def scan_image(name: str, content: bytes, recognize: Recognizer | None) -> Extract:
    """One page of usable text, or none; an error where there is no recognition."""
    if recognize is None:
        raise ValueError(f'Image OCR is disabled, so "{name}" could not be read.')
    seen = recognize(content)
    pages = [(1, seen.text)] if seen.usable and seen.text else []
    return Extract(pages, [seen.warning] if seen.warning else [], len(pages))


def read_docx(_: str, content: bytes, recognize: Recognizer | None = None) -> Extract:
    """A page without a number for the body, the footnotes and the endnotes, if they have text, and for each embedded image with usable text."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        names = set(box.namelist())
        pages = [(None, text) for part in PARTS if part in names and (text := docx_text(box.read(part)))]
        images = [box.read(x.filename) for x in box.infolist() if x.filename.startswith("word/media/") and _IMAGE.search(x.filename)]
    warnings, used, skipped = [], 0, []
    if images and recognize is None:
        warnings.append("Embedded DOCX images were found, but OCR is disabled.")
    for i, image in enumerate(images if recognize else [], 1):
        try:
            seen = recognize(image)
        except Exception as e:  # noqa: BLE001
            warnings.append(f"OCR failed on embedded DOCX image {i}: {e or 'Unknown OCR error'}")
            continue
        if seen.usable and seen.text:
            pages.append((None, seen.text))
            used += 1
        elif seen.warning:
            skipped.append(i)
    return Extract(pages, warnings + ([skipped_note("embedded DOCX image", skipped)] if skipped else []), used)


def merge_text(layer: str, recognized: str) -> str:
    """A page's text layer and recognised text: one that contains the other, in any letter case, else both."""
    if not layer or not recognized:
        return layer or recognized
    low, other = layer.lower(), recognized.lower()
    if other in low or low in other:
        return layer if len(layer) >= len(recognized) else recognized
    return normalize(f"{layer} {recognized}")


def skipped_note(kind: str, indexes: list[int]) -> str:
    """Which pages or images recognition was not usable for: five are named."""
    shown = ", ".join(map(str, indexes[:5])) + (", ..." if len(indexes) > 5 else "")
    plural = "" if len(indexes) == 1 else "s"
    return f"Ignored low-quality OCR output on {len(indexes)} {kind}{plural}" + (f" ({shown})." if shown else ".")


def attempt(read: Callable[[], Extract], name: str, retries: int, wait: float = 0.25) -> tuple[Extract, str | None]:
    """What was read, or the last error with the number of attempts; waits a little longer before each."""
    error = ""
    for n in range(1, retries + 2):
        try:
            return read(), None
        except Exception as e:  # noqa: BLE001
            error = str(e) or type(e).__name__
            if n <= retries:
                time.sleep(wait * n)
    return Extract([], []), f'Failed to process "{name}" after {retries + 1} attempt(s): {error}'


def _read_one(name: str, kind: str, content: bytes, pdf: PdfPages | None, recognize: Recognizer | None) -> Extract:
    if kind == "docx":
        return read_docx(name, content, recognize)
    if kind == "pdf":
        if pdf is None:
            raise ValueError("no reader for pdf")
        return scan_pdf(pdf(name, content), recognize)
    return scan_image(name, content, recognize)


def read_pages(files: DataFrame, pdf: PdfPages | None = None, make_recognizer: Callable[[], Recognizer] | None = None, limits: Limits = Limits(), wait: float = 0.25) -> DataFrame:  # noqa: B008
    """(file_index, file_name, page_seq, page_number, text, error, warnings, ocr_pages) of files (file_index, file_name, format, content).

    ``pdf`` opens the pages of a PDF, ``make_recognizer`` makes a worker's recogniser.  One bad file gives one row with
    its error and no page, and stops no other.  Empty pages are left out, ``page_seq`` counts from 0; a file's first row
    carries its warnings and the number of its recognised pages, in a row of its own if it has no page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognize = recognizer_of(make_recognizer)
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                made, error = attempt(lambda f=f: _read_one(f.file_name, f.format, bytes(f.content), pdf, recognize), f.file_name, limits.retries, wait)
                own = [(f.file_index, f.file_name, i, n, t, None, [], 0) for i, (n, t) in enumerate(x for x in made.pages if x[1])]
                if error or not own and (made.warnings or made.ocr_pages):
                    own = [(f.file_index, f.file_name, None, None, None, error, [], 0)]
                if own:
                    own[0] = (*own[0][:6], made.warnings, made.ocr_pages)
                rows += own
            yield pd.DataFrame(
                rows,
                columns=["file_index", "file_name", "page_seq", "page_number", "text", "error", "warnings", "ocr_pages"]
            ).astype({"page_seq": "Int32", "page_number": "Int32", "file_index": "int32", "ocr_pages": "int32"})

    return files.select("file_index", "file_name", "format", "content").mapInPandas(
        run,
        "file_index int, file_name string, page_seq int, page_number int, text string, error string, warnings array<string>, ocr_pages int"
    )
