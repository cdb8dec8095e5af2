"""Operator 3: context-triggered piecewise hashes.

A rolling hash over the last WINDOW bytes cuts a text wherever its value, plus one, is a multiple of the block size. Every chunk
gives one character of the signature. A fingerprint is block:signature:signature at twice the block. Fingerprints are compared
by edit distance where they share a block size.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import saved, slices, small_batches, table, text_of

WINDOW = 7
LEAST_BLOCK = 3
#: A signature has at most so many characters; the last one covers all the rest of the text.
LENGTH = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Signatures at the doubled block size count from so many characters on: a few characters agree by chance.
LEAST_SECOND = 7


def rolling(data):
    """For each byte, a 32-bit hash of the WINDOW bytes that end there; `data` (uint8 array) has WINDOW zeros before each text."""
    import numpy as np

    x = data.astype(np.uint32)
    total, weighted, shifted = x.copy(), x * np.uint32(WINDOW), x.copy()
    for back in range(1, WINDOW):
        old = x[:-back]
        total[back:] += old
        weighted[back:] += old * np.uint32(WINDOW - back)
        shifted[back:] ^= old << np.uint32(5 * back)
    return total + weighted + shifted


def signature(raw: bytes, cuts) -> str:
    """One character for each chunk of `raw`; cuts: ascending ends of chunks."""
    out, at = [], 0
    for cut in cuts[: LENGTH - 1]:
        out.append(ALPHABET[zlib.crc32(raw[at:cut]) & 63])
        at = cut
    if at < len(raw):
        out.append(ALPHABET[zlib.crc32(raw[at:]) & 63])
    return "".join(out)


def fingerprints(raws: list[bytes]) -> list[str]:
    """The fingerprint of each byte string; they are hashed together in one array."""
    import numpy as np

    pad = bytes(WINDOW)
    value = rolling(np.frombuffer(pad + pad.join(raws) + pad, np.uint8)) + np.uint32(1)
    thirds = np.nonzero(value % np.uint32(LEAST_BLOCK) == 0)[0]
    powers = value[thirds]
    out, at = [], WINDOW
    for raw in raws:
        a, b = np.searchsorted(thirds, (at, at + len(raw)))
        places, own = thirds[a:b] - (at - 1), powers[a:b]
        k = 0
        while LEAST_BLOCK << k < len(raw) / LENGTH:
            k += 1
        cuts = lambda k: places[own & np.uint32((1 << k) - 1) == 0].tolist()  # noqa: B023, E731
        now = cuts(k)
        while k and len(now) < LENGTH // 2 - 1:
            k -= 1
            now = cuts(k)
        out.append(f"{LEAST_BLOCK << k}:{signature(raw, now)}:{signature(raw, cuts(k + 1))}")
        at += len(raw) + WINDOW
    return out


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints: 1 - edit distance / longer length of the signatures at a block size that both have, else 0. Signatures
    at a doubled block size count only if both have LEAST_SECOND characters. Equal fingerprints give 1, null ones null."""

    def same(x, y):
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / longest)

    p, q = F.split(a, ":"), F.split(b, ":")
    (n, x1, x2), (m, y1, y2) = ([z[0].cast("long"), z[1], z[2]] for z in (p, q))
    long = lambda x, y: F.least(F.length(x), F.length(y)) >= LEAST_SECOND
    return (
        F.when(a == b, 1.0)
        .when(n == m, F.when(long(x2, y2), F.greatest(same(x1, y1), same(x2, y2))).otherwise(same(x1, y1)))
        .when((n == 2 * m) & long(x1, y2), same(x1, y2))
        .when((m == 2 * n) & long(x2, y1), same(x2, y1))
        .otherwise(0.0)
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row's whole text (UTF-8; null: empty, with fingerprint 3::). Repeated rows give repeated rows."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints([x.encode() for x in batch.column(1).to_pylist()]), pa.string())], ["doc_id", "fingerprint"])

    return small_batches(docs).select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """`text` whose last third (floor of its code points over 3) gives way to the first as many of `following`."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _pairs(ids, texts, prints, nexts, next_prints):
    """Arrow columns of rows whose following text is known."""
    import hashlib

    changed = [edited(x, y).encode() for x, y in zip(texts, nexts, strict=True)]
    return {
        "doc_id": ids,
        "n_chars": [len(x) for x in texts],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in changed],
        "fingerprint": prints,
        "edited_fingerprint": fingerprints(changed),
        "next_fingerprint": next_prints,
    }


def edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint of each row and its edited text.

    The next document is the next row in descending doc_id (null last; equal ids by a hash of the text), after the last the first; a lone row
    is its own next. Null texts are empty. Rows are dealt by ranges of doc_id and walked in order, so every text moves once. Only
    the first and last row of each range meet in a second step; there are two of these a partition, however many rows there are.
    """
    fields = [docs.schema["doc_id"], *(T.StructField(x, T.LongType() if x == "n_chars" else T.StringType()) for x in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"))]
    names = [x.name for x in fields]
    more = [T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())]

    def walk(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, arrow = TaskContext.get().partitionId(), None
        last = None

        def edge(kind, row):
            return pa.RecordBatch.from_pylist([{"doc_id": row[0], "fingerprint": row[2], "kind": kind, "part": part, "text": row[1]}], arrow)

        for batch in slices(batches, "text"):
            arrow = arrow or pa.schema([("doc_id", batch.schema.field(0).type), ("n_chars", pa.int64()), *((x, pa.string()) for x in names[2:]), ("kind", pa.string()), ("part", pa.int32()), ("text", pa.string())])
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prints = fingerprints([x.encode() for x in texts])
            if last is None:
                yield edge("first", (ids[0], texts[0], prints[0]))
            else:
                ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
            last = (ids[-1], texts[-1], prints[-1])
            if len(ids) > 1:
                rows = _pairs(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([pa.array(v, arrow.field(k).type) for k, v in (rows | {"kind": ["row"] * n, "part": [part] * n, "text": [None] * n}).items()], schema=arrow)
        if last is not None:
            yield edge("last", last)

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.to_pydict()
            rows = _pairs(x["doc_id"], x["text"], x["fingerprint"], x["next_text"], x["next_fingerprint"])
            types = {"doc_id": batch.schema.field("doc_id").type, "n_chars": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.string())) for k, v in rows.items()], names)

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]  # rows of one id are dealt by text
    spark = docs.sparkSession
    walked = saved(small_batches(docs).select("doc_id", text_of(docs).alias("text")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "text").mapInArrow(walk, T.StructType([*fields, *more])))
    parts = sorted(r[0] for r in walked.where("kind = 'first'").select("part").collect())  # one number a partition
    if not parts:
        return walked.select(names)
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = walked.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    tails = walked.where("kind = 'last'").select("doc_id", "fingerprint", "part", "text").join(following, "part").join(heads, "next_part")
    met = tails.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(meet, T.StructType(fields))
    return walked.where("kind = 'row'").select(names).unionByName(met)


def op3_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits(table(spark, sf_dir, "documents"))
    near = [likeness(F.col("fingerprint"), F.col(x)).alias(y) for x, y in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))]
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
