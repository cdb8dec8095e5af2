"""The driver's tables as stand-ins for the engine's inputs: coverage, a raster, statistics, points and a polygon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZOOM, TILE, RASTER_ZOOM = 12, 16, 6
#: Corners of the bounding polygon, in tiles of ZOOM.
TRIANGLE = ((2210.5, 1402.5), (2380.25, 1440.5), (2250.75, 1490.5))

#: A polygon in pixels of the raster, as edges.
MASK_EDGES = ((5.25, 10.25, 60.5, 40.75), (60.5, 40.75, 30.5, 300.25), (30.5, 300.25, 5.25, 10.25))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.lit(ZOOM).alias("z"), (2200 + F.col("l_partkey") % 200).cast("int").alias("x"), (1400 + F.col("l_suppkey") % 100).cast("int").alias("y")).distinct()


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, py, g, a, tx, ty, ix, iy of a gray+alpha raster, one pixel an array element."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("py"), "label", F.posexplode("embedding").alias("px", "v"))
    tx, ty = 20 + F.floor(F.col("px") / TILE), 10 + F.floor(F.col("py") / TILE)
    rows = rows.select("px", "py", "label", F.floor((F.col("v").cast("double") + 1) * 127.5).cast("int").alias("g"), tx.cast("int").alias("tx"), ty.cast("int").alias("ty"))
    k = (F.col("tx") + F.col("ty")) % 5
    alpha = F.when(k == 0, 0).when(k == 1, 255).when(F.col("label") < 3, 128).when(F.col("label") == 3, 0).otherwise(255)
    return rows.select("px", "py", "g", alpha.alias("a"), "tx", "ty", (F.col("px") % TILE).alias("ix"), (F.col("py") % TILE).alias("iy"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    t = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 60000")
    return rows.select(t.alias("t"), F.col("event_type").alias("metric"), F.round(F.col("value") * 1000).cast("long").alias("d"))
