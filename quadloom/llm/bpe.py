"""Operator 8: byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before a white-space character that follows a non-space one. No match of the pre-split pattern spans such a
place and its look-ahead never sees past it, so the pieces give the ids of the whole text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import slices, small_batches, table, text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Texts over so many characters are cut at safe boundaries.
PIECE_CHARS = 1 << 16


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of about `size` characters, cut only between a non-space character and a blank or line end that follows it."""
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while cut < n and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    if at < n:
        yield text[at:]


def encode_text(enc, text: str, size: int = PIECE_CHARS) -> array:
    """The ids of `text` as unsigned 32-bit integers."""
    out = array("I")
    for piece in safe_pieces(text, size):
        out.extend(enc.encode_ordinary(piece))
    return out


def little_endian(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(docs: DataFrame, ranks_path: str | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids: per row, the ids packed as little-endian unsigned 32-bit integers.

    A null text counts as empty; an empty text has no ids; repeated rows give repeated rows; other columns are ignored.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        enc = encoding(path)
        for batch in slices(batches, "text"):
            ids = [encode_text(enc, x, piece_chars) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(map(little_endian, ids), pa.binary())], ["doc_id", "n_tokens", "ids"])

    return small_batches(docs).select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """`encoded` (columns doc_id, n_tokens, ids) with the column decoded: the raw bytes that the ids stand for; null ids give no bytes."""
    path = ranks_path or public_tokenizers.path(RANKS)
    schema = T.StructType([*(encoded.schema[x] for x in ("doc_id", "n_tokens", "ids")), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoding(path)
        for batch in slices(batches, "ids"):
            raw = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return small_batches(encoded).select("doc_id", "n_tokens", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs."""
    return decode(encode(docs, ranks_path), ranks_path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
