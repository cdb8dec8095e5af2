"""Operator 7: mixing sources to target weights along a time-varying curriculum.

A source's documents, in an order fixed by a hash, lie end to end on its token axis, once for every time round. The weight
schedule of a source is integrated to its cumulative token demand; inverting that at a copy's midpoint gives the copy's position
in training, and the mix is range-sorted by position. Everything is DataFrame expressions, sums and targets of sources included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.llm.common import WORD, join_hot, saved, table, text_of

WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix takes, and the most a source may be taken.
SHARE, MOST = 1.5, 2.0
SEED = 7
#: By weight: the slope a of a source's schedule 1 + a (1 - 2 t) over training time t; heavy sources come early, light ones late.
SLOPES = {5: 0.5, 2: 0.0, 1: -0.5}
#: Documents a bucket of the token axis should hold.
BUCKET_ROWS = 1 << 13


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of `sums`, its total over all rows before in `order`. Rows are sorted by ranges, and a window walks each range;
    what comes before a range is one row a partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions
    begins = dealt.groupBy("__part").agg(*(F.sum(v).alias(f"__{k}") for k, v in sums.items()))
    begins = F.broadcast(begins.select("__part", *(F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__{k}") for k in sums)))
    own = dealt.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(k) for k, v in sums.items()))
    return own.join(begins, "__part").select(*rows.columns, *((F.col(k) + F.col(f"__{k}")).alias(k) for k in sums))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size; one row each) with weight and target, the words to take: `share` of all words split by weight,
    none above `most` times its size, the excess reshared.

    Sources are ordered by code point, null last, and take the weights in turn. Sources without words get 0. In ascending order of
    size per weight, sources are full as long as the level that the rest would share lies above theirs; the rest share what is left.
    """
    size, level = most * F.col("source_size").cast("double"), F.col("__full") / F.col("weight")
    turn = F.get(F.array(*(F.lit(w) for w in weights)), F.pmod("__nth", F.lit(len(weights))).cast("int"))
    weighted = _before(sources, [F.col("source").asc_nulls_last()], {"__nth": F.lit(1)}).withColumn("weight", turn).drop("__nth")
    filled = _before(weighted.withColumn("__full", size), [level, F.col("source").asc_nulls_last()], {"__sizes": F.col("__full"), "__weights": F.col("weight")})
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weights"))  # one row
    ready = saved(filled.crossJoin(F.broadcast(whole)).withColumn("__is_full", level < (share * F.col("words") - F.col("__sizes")) / (F.col("all_weights") - F.col("__weights"))))
    full = F.col("__is_full")
    rest = ready.agg(F.coalesce(F.sum(F.when(full, F.col("__full"))), F.lit(0.0)).alias("taken"), F.coalesce(F.sum(F.when(full, F.col("weight"))), F.lit(0)).alias("out"))  # one row
    left = (share * F.col("words") - F.col("taken")) * F.col("weight") / F.nullif(F.col("all_weights") - F.col("out"), F.lit(0))
    return ready.crossJoin(F.broadcast(rest)).select(*sources.columns, "weight", F.when(full, F.col("__full")).otherwise(left).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"))


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _corrected(counted: DataFrame, sources: DataFrame, most: float, total: int) -> DataFrame:
    """One copy more or less of one document a source, where that brings the source nearer to its target: the one whose length is
    nearest to what is missing or too much, of equals the first by hash. counted, sources: saved; sources has key and rows."""
    gaps = counted.groupBy("key").agg((F.first("target") - F.sum(F.col("length") * F.col("copies"))).alias("gap"))
    gaps = saved(sources.select("key", "rows").join(gaps, "key"))
    spare = F.when(F.col("gap") > 0, F.col("copies") + 1 <= most).otherwise(F.col("copies") > 0) & (F.abs(F.abs("gap") - F.col("length")) < F.abs("gap"))
    near = join_hot(counted.select("key", "h", "doc_id", "size", "length", "copies"), gaps, "key", "rows", total).where(spare & (F.col("length") > 0))
    best = near.groupBy("key").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("length")).alias("off"), "h", "doc_id", "size", F.signum("gap").cast("int").alias("step"))).alias("b"))
    best = saved(gaps.select("key", "rows").join(best, "key", "left"))
    is_best = F.col("doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("size") == F.col("b.size"))
    return join_hot(counted, best, "key", "rows", total).withColumn("copies", F.col("copies") + F.when(is_best, F.col("b.step")).otherwise(0)).drop("b", "rows")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, slopes: dict[int, float] = SLOPES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, n, source_size, target, copies, positions: one row per distinct (doc_id, source, size) of docs.

    size: the words of the text (null or empty: 0). n: the rows of docs that share the key; they are decided together. copies:
    how often each is taken, such that a source's copies begin before its target is
    reached, by midpoints, with one copy more or less where that comes nearer. positions: the place
    of each copy in training, 0 to 1. There may be as many sources as rows, and one may have most of them.
    """
    keyed = saved(_sized(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("key", _key(F.col("source"))))
    total = keyed.count()
    known = keyed.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
    slope = F.coalesce(*(F.when(F.col("weight") == w, F.lit(float(a))) for w, a in slopes.items()), F.lit(0.0))
    # bits of the hash that tell a source's buckets apart
    bits = F.least(F.lit(32), F.when(F.col("rows") < BUCKET_ROWS, 0).otherwise(F.floor(F.log2(F.floor(F.col("rows") / BUCKET_ROWS))) + 1)).cast("int")
    sources = saved(targets(known, weights, share, most).select("key", "rows", "source_size", "target", slope.alias("slope"), bits.alias("bits")))
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size"))
    placed = (
        join_hot(keyed, sources, "key", "rows", total)
        .drop("rows")
        .withColumn("h", hashed)
        .withColumn("bucket", F.expr("shiftright(cast(conv(substring(h, 1, 8), 16, 10) as bigint), 32 - bits)"))  # the highest bits
        .withColumn("length", F.col("size") * F.col("n"))
    )
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = placed.groupBy("key", "bucket").agg(F.sum("length").alias("length")).select("key", "bucket", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(begins, ["key", "bucket"])
    middle = F.col("begin") + F.col("inside") + F.col("length") / 2
    whole = F.col("source_size")
    counted = start.withColumn("middle", middle).withColumn("copies", F.when(F.col("length") == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((F.col("target") - F.col("middle")) / whole))).cast("int"))
    counted = saved(counted.drop("bucket", "begin", "inside", "bits"))
    counted = _corrected(counted, sources, most, total)

    def position(e):
        y = F.least(F.lit(1.0), (F.col("middle") + e * whole) / F.col("target"))  # share of the source's demand that is met before
        a = F.col("slope")
        return 2 * y / ((1 + a) + F.sqrt(F.greatest(F.lit(0.0), (1 + a) * (1 + a) - 4 * a * y)))

    none = F.array().cast("array<double>")
    times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(none)
    return counted.select("doc_id", "source", "size", "n", "source_size", "target", "copies", times.alias("positions"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them, sorted by ranges of training position; columns as in docs.

    Null and empty texts are of no words and are not taken; null ids and sources count like others; rows that share id, source and
    size are taken alike. An empty table stays empty.
    """
    planned = plan(docs, **options).where("copies > 0").select(F.col("doc_id").alias("__ql_id"), F.col("source").alias("__ql_source"), F.col("size").alias("__ql_size"), F.col("positions").alias("__ql_positions"))
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")
    same = docs["doc_id"].eqNullSafe(planned["__ql_id"]) & docs["source"].eqNullSafe(planned["__ql_source"]) & (size == planned["__ql_size"])
    copies = docs.join(planned, same).select(*(docs[c] for c in docs.columns), F.explode("__ql_positions").alias("__ql_position"))
    return copies.repartitionByRange("__ql_position").sortWithinPartitions("__ql_position").drop("__ql_position")


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix's decision on every row of documents, sorted by ranges of first position, in millionths; -1, and last, where it takes none."""
    planned = plan(table(spark, sf_dir, "documents"))
    place = F.coalesce(F.floor(F.get("positions", F.lit(0)) * 1000000), F.lit(-1).cast("long")).alias("position")
    rows = planned.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    out = rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), place)
    order = [F.col("position") < 0, "position", "doc_id"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END"

#: Sources in ascending order of size per weight are full as long as the level that the rest would share lies above theirs.
OP7_SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ss, {_WEIGHT} AS w FROM sized GROUP BY source),
whole AS (SELECT {SHARE} * sum(ss) AS share, sum(w) AS total FROM sources),
run AS (SELECT *, sum({MOST} * ss) OVER o - {MOST} * ss AS size_before, sum(w) OVER o - w AS w_before FROM sources WINDOW o AS (ORDER BY {MOST} * ss / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
capped AS (SELECT run.*, {MOST} * ss / w < (share - size_before) / (total - w_before) AS is_full FROM run, whole),
rest AS (SELECT any_value(share) - coalesce(sum({MOST} * ss) FILTER (WHERE is_full), 0) AS share, any_value(total) - coalesce(sum(w) FILTER (WHERE is_full), 0) AS total FROM capped, whole),
aim AS (SELECT source, ss, w, CASE WHEN is_full THEN {MOST} * ss ELSE rest.share * w / rest.total END AS target, CASE w WHEN 5 THEN 0.5 WHEN 2 THEN 0.0 ELSE -0.5 END AS a FROM capped, rest),
placed AS (SELECT d.doc_id, d.source, d.size, ss, target, a, md5(concat_ws(':', '{SEED}', coalesce(CAST(d.doc_id AS VARCHAR), 'null'), CAST(d.size AS VARCHAR))) AS h FROM sized d JOIN aim ON d.source IS NOT DISTINCT FROM aim.source),
middles AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size + size / 2.0 AS middle FROM placed),
counted AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE greatest(0, ceil((target - middle) / ss)) END AS copies FROM middles),
gaps AS (SELECT *, target - sum(size * copies) OVER (PARTITION BY source) AS gap FROM counted),
spare AS (SELECT *, size > 0 AND abs(abs(gap) - size) < abs(gap) AND CASE WHEN gap > 0 THEN copies + 1 <= {MOST} ELSE copies > 0 END AS fits FROM gaps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fits DESC, abs(abs(gap) - size), h, doc_id) AS n FROM spare),
final AS (SELECT *, copies + CASE WHEN fits AND n = 1 THEN sign(gap) ELSE 0 END AS taken_times, least(1.0, middle / target) AS y FROM ranked)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(size * taken_times AS BIGINT) AS taken,
  CASE WHEN taken_times > 0 THEN CAST(floor(2 * y / ((1 + a) + sqrt(greatest(0.0, (1 + a) * (1 + a) - 4 * a * y))) * 1000000) AS BIGINT) ELSE -1 END AS position
FROM final
"""
