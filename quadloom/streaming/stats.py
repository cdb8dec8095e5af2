"""Build statistics: totals by metric, and windows that close when an event arrives late enough after the last close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quadloom.functions.tiles import mean_duration

#: A window closes at the first event this long after it opened.
PERIOD_MS = 11_000
METRICS = ("select", "insert", "encode", "warp", "compose")
#: A build's event log: milliseconds since 1970, step, milliseconds it took, share of the tiles that are done, zooms to go, and the build.
EVENTS = "t long, metric string, d long, pct double, left int, run string"


def by_metric(events: DataFrame) -> DataFrame:
    """metric, total, n, label of events (metric, d in milliseconds)."""
    return events.groupBy("metric").agg(F.sum("d").alias("total"), F.count("*").alias("n")).select("metric", "total", "n", mean_duration("total", "n").alias("label"))


def total_without(events: DataFrame, metric: str) -> DataFrame:
    """One row, total: the durations of all metrics but one."""
    return events.agg(F.coalesce(F.sum(F.when(F.col("metric") != metric, F.col("d"))), F.lit(0)).alias("total"))


def gauges(events: DataFrame, values: dict[str, str], at: str | Column = "t", *by: str) -> DataFrame:
    """The last value of each gauge (name: column) by arrival; one row, or one for each `by`."""
    return events.groupBy(*by).agg(*(F.max_by(v, at).alias(k) for k, v in values.items()))


def console(spark: SparkSession, target: str, period: int = PERIOD_MS) -> StreamingQuery:
    """Prints the closed windows of a build's event log (`<target>/events`) as they come; it may start before the build does."""
    events = spark.readStream.schema(EVENTS).parquet(f"{target}/events")
    return throttled_stream(events, "metric", period).writeStream.format("console").outputMode("append").option("truncate", "false").start()


def triggers(events: DataFrame, period: int = PERIOD_MS) -> DataFrame:
    """opened, closed: the windows in turn. The clock starts at the first event; an event at least `period` after it closes the
    window, and opens the next.

    Each close depends on the one before, so the distinct times are walked in order in one task, which holds one number and reads
    8 bytes a distinct time; the events themselves are not in it.
    """

    def walk(batches):
        last = None
        for pdf in batches:
            rows = []
            for at in pdf["t"].tolist():
                if last is None:
                    last = at
                elif at - last >= period:
                    rows.append((last, at))
                    last = at
            yield type(pdf)(rows, columns=["opened", "closed"]).astype("int64")

    times = events.select("t").where("t is not null").distinct()
    return times.repartition(1).sortWithinPartitions("t").mapInPandas(walk, "opened long, closed long")


def throttled(events: DataFrame, period: int = PERIOD_MS) -> DataFrame:
    """opened, closed, n, total of the events (t in milliseconds, d) of each closed window: those from its opening, without the
    one that closes it. The last, open window is not reported.

    Events meet windows on buckets of time: a window is listed under each bucket that it touches.
    """
    buckets = F.explode(F.sequence(F.floor(F.col("opened") / period), F.floor((F.col("closed") - 1) / period))).alias("bucket")
    windows = triggers(events, period).select("opened", "closed", buckets)
    keyed = events.select("t", "d", F.floor(F.col("t") / period).alias("bucket"))
    inside = (F.col("t") >= F.col("opened")) & (F.col("t") < F.col("closed"))
    return keyed.join(windows, "bucket").where(inside).groupBy("opened", "closed").agg(F.count("*").alias("n"), F.sum("d").alias("total"))


STATE = T.StructType([T.StructField("opened", T.LongType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])
WINDOW = T.StructType([T.StructField("key", T.StringType()), T.StructField("opened", T.LongType()), T.StructField("closed", T.LongType()), T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])


def throttled_stream(events: DataFrame, key: str, period: int = PERIOD_MS) -> DataFrame:
    """The same windows over a stream, one clock a key (a worker, say): state is the window's opening and sums."""

    def step(k, batches, state):
        import pandas as pd

        opened, n, total = state.get if state.exists else (None, 0, 0)
        rows = []
        for pdf in batches:
            pdf = pdf.sort_values("t")
            for t, d in zip(pdf["t"].tolist(), pdf["d"].tolist(), strict=True):
                if opened is None:
                    opened = t
                elif t - opened >= period:
                    rows.append((str(k[0]), opened, t, n, total))
                    opened, n, total = t, 0, 0
                n, total = n + 1, total + d
        state.update((opened, n, total))
        yield pd.DataFrame(rows, columns=WINDOW.names)

    return events.groupBy(key).applyInPandasWithState(step, WINDOW, STATE, "append", "NoTimeout")
