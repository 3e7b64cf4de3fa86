"""Problem 6: token ids of a whole corpus under a public byte-level BPE vocabulary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.bpe import BytePairEncoder
from pagemill.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts encoded together; the unit of the vectorised check.
BATCH = 500
_encoders: dict[bytes, BytePairEncoder] = {}


def _encoder(vocabulary: bytes) -> BytePairEncoder:
    """One encoder for each Python worker and vocabulary."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _encoders:
        _encoders[key] = BytePairEncoder(vocabulary)
    return _encoders[key]


def _mapped(df: DataFrame, text: str, out: str, keep: list[str], vocabulary: str, ids: bool) -> DataFrame:
    """``keep`` and the ids, or their number, of each text; the 1.5 MB vocabulary file is broadcast as it is."""
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    kind = pa.list_(pa.int32()) if ids else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(len(keep)).to_pylist()
                made = encoder.encode(texts) if ids else encoder.count(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(made, kind)], [*keep, out])

    given = spread(df.select(*keep, F.col(text).cast("string").alias("_text")))
    fields = [*given.schema.fields[: len(keep)], T.StructField(out, T.ArrayType(T.IntegerType()) if ids else T.LongType())]
    return given.mapInArrow(run, T.StructType(fields))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row, ids being an empty list for a null or empty text.

    One narrow stage: no shuffle, nothing kept from row to row but a bounded cache of encoded words.  Repeated
    ids stay repeated, null ids stay null, other columns are ignored whatever their names, and very long
    texts are encoded whole (merging costs n log n).
    """
    return _mapped(df, text, "ids", [id_col], vocabulary, True)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and the number of tokens of each row's text (0 for null and empty)."""
    return _mapped(df, text, out, keep, vocabulary, False)
