"""Operator 2: byte-level BPE encoding and decoding.

tiktoken encodes with a local rank file. A text of over `long_text` characters is first cut
where a character that is not white space is followed by a blank or a line break. No match of the
pre-splitting pattern holds such a place inside, and what follows it does not depend on what went
before, so the ids are those of the whole text. Decoding works on raw bytes: ids that cut a
character in two give back exactly those bytes.

Null text counts as empty: no ids, empty bytes. Null ids decode to null. Extra columns pass through; one that has the name
of an added column is replaced.
Each row is encoded by itself: ties and repeated rows give repeated results. The rank file is read
by the driver (its size does not grow with the data) and sent to the workers.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrid.llm.common import CHUNK_BYTES, importable, sliced, table, without_columns

LONG_TEXT = 1 << 16
_SAFE = re.compile(r"\S(?=[ \n])")
_loaded: dict = {}


def encoding(ranks: bytes, pattern: str):
    """A tiktoken encoding from the bytes of a rank file; one per process."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _loaded:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _loaded[key]


def pieces(text: str, long_text: int = LONG_TEXT) -> list[str]:
    """Parts of a long text that can be encoded apart."""
    out, at = [], 0
    while len(text) - at > long_text and (m := _SAFE.search(text, at + long_text - 1)):
        out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return out


def encode_text(enc, text: str, long_text: int = LONG_TEXT) -> list[int]:
    if len(text) <= long_text:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, long_text) for i in enc.encode_ordinary(part)]


def _broadcast_ranks(spark: SparkSession, path: str | None):
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _add_column(df: DataFrame, source: str, name: str, make, limit: int) -> DataFrame:
    importable(df.sparkSession)
    df = without_columns(df, name)

    def run(batches):
        for part in sliced(batches, source, limit):
            column = make(part.column(part.schema.get_field_index(source)))
            yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks: str | None = None, pattern: str | None = None, long_text: int = LONG_TEXT) -> DataFrame:
    """Add the ids of `text`, as little-endian unsigned 32-bit integers in one binary column."""
    sent, pattern = _broadcast_ranks(df.sparkSession, ranks), pattern or public_tokenizers.PATTERN

    def make(column: pa.Array) -> pa.Array:
        enc = encoding(sent.value, pattern)
        return pa.array([np.array(encode_text(enc, t or "", long_text), "<u4").tobytes() for t in column.to_pylist()], pa.binary())

    return _add_column(df, text, ids, make, CHUNK_BYTES)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add the bytes that the ids in a binary column stand for."""
    sent, pattern = _broadcast_ranks(df.sparkSession, ranks), pattern or public_tokenizers.PATTERN

    def make(column: pa.Array) -> pa.Array:
        enc = encoding(sent.value, pattern)
        return pa.array([None if b is None else enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in column.to_pylist()], pa.binary())

    return _add_column(df, ids, out, make, 2 * CHUNK_BYTES)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode(encode(docs).drop("text"))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
