"""Operator 9: quality rules, with a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Only DataFrame and SQL functions. Words and word pairs are hashed to BUCKETS buckets. Two smoothed multinomials over the buckets,
one of the trusted documents and one of all documents, give each bucket a weight, the log of their ratio, kept in whole
thousandths so that sums do not depend on order. A document's mean weight is compared with a fixed threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import SPACE, let, table, text_of

#: A power of two.
BUCKETS = 1 << 14
#: Mean thousandths of a nat a gram that a document must reach to be kept.
THRESHOLD = -100
#: Up to so many trusted ids are broadcast (a few MB, whatever the corpus); more are joined by a shuffle, with the same result.
BROADCAST_IDS = 1 << 18
MIN_WORDS, WINDOW = 50, 3
SYMBOLS = "#*$%&|<>"


def _split(docs: DataFrame, *more: Column) -> DataFrame:
    """text and words, beside `more`."""
    text = text_of(docs)
    return docs.select(*more, text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))


def _grams(split: DataFrame, *kept: Column | str) -> DataFrame:
    """h (a hash of each word) and pairs (a hash of each word and the next one, or the end), beside `kept`. Texts and words are left
    behind, so that they are not copied from step to step."""
    return split.select(*kept, F.transform("words", lambda x: F.xxhash64(x)).alias("h")).select("*", let(F.col("h"), _next).alias("pairs"))


def _next(h: Column) -> Column:
    """A hash of each element and the one after it."""
    return F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda x, y: F.xxhash64(x, F.coalesce(y, F.lit(0).cast("long"))))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, target, raw: grams of the trusted documents (column doc_id) and of all, by bucket; at most BUCKETS rows.

    Null and empty texts have no grams; rows of docs that repeat count again, trusted ids that repeat do not; null ids are trusted by
    nobody.
    """
    ids = trusted.select(F.col("doc_id").alias("__ql_id")).where("__ql_id is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__ql_id"), "left")
    grams = _grams(_split(marked, F.col("__ql_id").isNotNull().alias("target")), "target").select("target", F.explode(F.concat("h", "pairs")).alias("gram"))
    rows = grams.select("target", _bucket(F.col("gram")).alias("bucket"))
    return rows.groupBy("bucket", "target").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum(F.when(F.col("target"), F.col("n")).otherwise(0)).alias("target"), F.sum("n").alias("raw"))


def weights(table_of_counts: DataFrame) -> list[int]:
    """Per bucket the log ratio in thousandths; all 0 without trusted grams."""
    target, raw = [0] * BUCKETS, [0] * BUCKETS
    for b, t, r in table_of_counts.select("bucket", "target", "raw").collect():  # at most BUCKETS rows
        target[b], raw[b] = t, r
    if not sum(target):
        return [0] * BUCKETS
    a, z = sum(target) + BUCKETS, sum(raw) + BUCKETS
    return [round(1000 * (math.log((t + 1) / a) - math.log((r + 1) / z))) for t, r in zip(target, raw, strict=True)]


#: Bits of a window's place where windows are sorted by the rest of their hash.
PLACE = 30


def _windows() -> Column:
    """Names of the WINDOW-word windows (columns h, pairs), by the pairs in them."""
    p = F.col("pairs")
    for _ in range(WINDOW - 2):
        p = let(p, _next)
    return F.when(F.size("h") >= WINDOW, let(p, lambda w: F.slice(w, 1, F.size(w) - (WINDOW - 1))))


def _repeated_words(counted: DataFrame) -> DataFrame:
    """counted (column t: windows; dropped) with n_repeat_words, the words in windows that occur twice or more.

    Most windows are told apart by some bits of their hash, which are sorted with their places as plain numbers; only those that share
    these bits with another one are sorted by the whole hash.
    """
    placed = F.transform("t", lambda x, i: F.shiftleft(x, PLACE).bitwiseOR(i.cast("long")))
    columns = [c for c in counted.columns if c != "t"]
    sorted_ = counted.select(*columns, "t", F.when(F.size(F.array_distinct("t")) < F.size("t"), placed).alias("s")).select(*columns, "t", F.sort_array("s").alias("s"))
    bits = lambda e: F.shiftrightunsigned(e, PLACE)
    both = let(F.col("s"), lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(bits(x) == bits(y), F.array(x, y))))
    few = F.array_distinct(F.flatten(F.array_compact(both)))

    def covered(t):
        place = lambda e: e.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
        exact = F.sort_array(F.transform(few, lambda e: F.struct(F.get(t, place(e)).alias("x"), place(e).alias("i"))))  # array_sort is several times slower
        again = let(exact, lambda s: F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]) | F.coalesce(e["x"] == F.get(s, j + 1)["x"], F.lit(False))))
        starts = F.sort_array(F.transform(again, lambda e: e["i"]))
        steps = let(starts, lambda p: F.transform(p, lambda e, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), e - F.get(p, k - 1)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    repeated = F.when(F.col("s").isNull(), 0).otherwise(let(F.col("t"), covered))
    return sorted_.select(*columns, repeated.cast("long").alias("n_repeat_words"))


def rules(docs: DataFrame, bucket_weights: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """doc_id and, over each whole text (null: no words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, llr (mean thousandths of a nat a gram, null without words), kept. Repeated rows repeat."""
    table_ = F.split(F.lit(",".join(map(str, bucket_weights))), ",").cast("array<int>")  # folded to one literal
    of = lambda b: F.get(table_, b)
    total = F.aggregate(F.zip_with("h", "pairs", lambda x, y: of(_bucket(x)) + of(_bucket(y))), F.lit(0).cast("long"), lambda a, b: a + b)
    worded = let(F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(F.lit(" \t\n\x0b\f\r"), x)) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = _grams(
        _split(docs, F.col("doc_id")),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        worded.cast("long").alias("n_dup_lines"),
    )
    out = _repeated_words(counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", total.alias("total"), _windows().alias("t")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = F.col("total") >= threshold * 2 * F.col("n_words")
    llr = F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words")))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*columns, failed.alias("base_failed"), llr.alias("llr"), (~failed & enough).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules(docs, weights(counts(docs, labels.where("quality = 1"))))
