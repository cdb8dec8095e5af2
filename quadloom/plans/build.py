"""A build end to end: raster to tile pyramid, stored as Parquet and, if asked for, as MBTiles."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import crs
from quadloom.functions import tiles as t
from quadloom.operators import keys, pyramid
from quadloom.operators.lineage import saved
from quadloom.sources import geojson, mbtiles, raster
from quadloom.streaming import stats

#: Zooms that one shuffle climbs.
LEVELS = 4


@dataclass(frozen=True)
class TilerOptions:
    """What a build takes. Paths of rasters, polygons and Parquet may be of any file system that Spark reads."""

    source: str
    target: str
    max_zoom: int
    continue_from: str | None = None
    source_srs: str | None = None
    transform_pipeline: str | None = None
    bounding_polygon: str | None = None
    tile_size: int = 256
    format: str = "jpeg"
    jpeg_quality: int = 85
    warp_zoom_offset: int = 3
    insert_empty: bool = True
    debug: bool = False
    use_nodata: bool = False
    limits_scope: str = "table"
    lonlat_bounds: bool = False
    grid_folder: str | None = None
    beyond_world: bool = False

    def checked(self) -> TilerOptions:
        if self.format not in ("jpeg", "png"):
            raise ValueError("format: jpeg or png")
        if not 0 <= self.max_zoom <= 24:
            raise ValueError("max_zoom: 0 to 24")
        if not 1 <= self.jpeg_quality <= 100:
            raise ValueError("jpeg_quality: 1 to 100")
        if self.limits_scope not in ("table", "run"):
            raise ValueError("limits_scope: table or run")
        out = replace(self, warp_zoom_offset=min(self.warp_zoom_offset, self.max_zoom))
        t.mega_size(out.tile_size, out.warp_zoom_offset)
        return out


def cover(spark: SparkSession, options: TilerOptions, meta: raster.RasterMeta, transform: crs.Transform) -> tuple[DataFrame, tuple[float, float, float, float]]:
    """The base tiles of a source and its bounds in EPSG:3857. Tiles outside the square of the world are left out unless beyond_world."""
    bounds = transform.bounds(*meta.bbox)
    if options.bounding_polygon:
        return keys.polygon_tiles(spark, *bounds, options.max_zoom, geojson.read_polygon(spark, options.bounding_polygon), options.beyond_world), bounds
    return keys.bbox_tiles(spark, *bounds, options.max_zoom, options.beyond_world), bounds


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def occupied(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at `path` besides the event log of a build that has not come to an end."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and (not fs.getFileStatus(p).isDirectory() or any(x.getPath().getName() != "events" for x in fs.listStatus(p)))


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of one small file, or None if there is none."""
    return bytes(spark.read.format("binaryFile").load(path).first().content) if exists(spark, path) else None


def metadata_rows(options: TilerOptions, bounds: tuple[float, float, float, float]) -> list[tuple[str, str]]:
    if options.lonlat_bounds:
        import numpy as np

        x, y = crs.parse("EPSG:4326").inverse(np.array([bounds[0], bounds[2]]), np.array([bounds[1], bounds[3]]))
        bounds = (float(x[0]), float(y[0]), float(x[1]), float(y[1]))
    return [("name", "Tiles"), ("format", options.format), ("minzoom", "0"), ("maxzoom", str(options.max_zoom)), ("bounds", ",".join(str(int(v)) if v == int(v) else repr(v) for v in bounds))]


class Timers:
    """A build's event log: one row a step, appended as the step ends, so that a stream can follow it. `run` tells builds apart."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.path, self.at, self.run = spark, f"{target}/events", time.time(), uuid.uuid4().hex

    def took(self, metric: str, pct: float = 0.0, left: int = 0) -> None:
        now = time.time()
        row = (int(now * 1000), metric, int((now - self.at) * 1000), float(pct), left, self.run)
        # literals, as a row from the driver would start a Python worker for each step
        columns = [F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for v, c in zip(row, stats.EVENTS.split(", "), strict=True)]
        self.spark.range(1, numPartitions=1).select(*columns).write.mode("append").parquet(self.path)
        self.at = time.time()


def build_tiles(spark: SparkSession, options: TilerOptions) -> dict[str, DataFrame]:
    """Builds the pyramid and writes <target>/tiles (partitioned by zoom_level) and <target>/metadata as Parquet.

    <target>/events gets a row for each step as it ends, which stats.console() can follow. Returns tiles, metadata and limits, read
    back from there. Tiles: zoom_level, tile_column, tile_row, tile_data, tile_alpha, and
    steps if debug. An existing target is an error unless continue_from names a target of an earlier run, which may be the same:
    tiles stored there are not made again but decoded where a parent needs them, and their rows are taken over. Every covered
    tile without data gets a marker row of no bytes if insert_empty, at all zooms.
    """
    options = options.checked()
    same = options.continue_from == options.target
    if not same and occupied(spark, options.target):
        raise FileExistsError(f"{options.target} exists: continue from it or choose another")
    metas = raster.read_meta(spark, options.source)
    meta, _ = raster.together(metas)
    srs = options.transform_pipeline or raster.resolve_srs(options.source_srs, meta)
    transform = crs.parse(srs, lambda name: read_file(spark, f"{options.grid_folder}/{name}") if options.grid_folder else None)
    bands = (len(meta.bands) + 1) // 2 * 2
    base, bounds = cover(spark, options, meta, transform)
    base = saved(base)
    work = keys.closure(base, options.max_zoom)
    stored, timers = None, Timers(spark, options.target)
    if options.continue_from:
        stored = saved(spark.read.parquet(f"{options.continue_from}/tiles"))
        done = stored.select(F.col("zoom_level").alias("z"), F.col("tile_column").alias("x"), t.reversed_y("zoom_level", "tile_row").alias("y"))
        known = saved(pyramid.decode(stored, options.tile_size, bands))
        work = keys.todo(work, done)
    work = saved(work)
    by_zoom = {r.z: r.n for r in work.groupBy("z").agg(F.count("*").alias("n")).collect()}  # one row a zoom
    share = lambda z: 100 * sum(n for k, n in by_zoom.items() if k >= z) / max(1, sum(by_zoom.values()))
    timers.took("select", 0.0, options.max_zoom + 1)
    blocks = raster.read_blocks(spark, options.source, metas=metas)
    fresh = pyramid.base_tiles(work.where(F.col("z") == options.max_zoom), blocks, meta, transform, options.tile_size, options.warp_zoom_offset, raster.BLOCK, options.use_nodata)
    now, z = saved(fresh), options.max_zoom
    made = [now]
    timers.took("warp", share(z), z)
    if stored is not None:
        now = now.unionByName(known.where(F.col("z") == z))
    while z > 0:
        # a resumed parent may be stored already, so one level at a time lets stored buffers join in
        n = 1 if stored is not None else min(LEVELS, z)
        above = saved(pyramid.subtree(now, options.tile_size, bands, n))
        z -= n
        timers.took("compose", share(z), z)
        if stored is not None:
            above = above.join(work, ["z", "x", "y"], "left_semi").select("z", "x", "y", "buf")
            made.append(above)
            now = above.unionByName(known.where(F.col("z") == z))
        else:
            made.append(above)
            now = above.where(F.col("z") == z)
    data = made[0]
    for part in made[1:]:
        data = data.unionByName(part)
    rows = data
    if options.insert_empty:
        rows = work.join(data, ["z", "x", "y"], "left").select("z", "x", "y", "buf")
    tiles = pyramid.encode(rows, options.tile_size, bands, options.format, options.jpeg_quality)
    if options.limits_scope == "run":
        tiles = saved(tiles)  # read twice
    if options.debug:
        full = F.length("tile_data") > 0
        step = F.when(F.col("zoom_level") == options.max_zoom, F.lit("W")).otherwise(F.lit("C"))
        tiles = tiles.withColumn("steps", F.concat(step, F.when(full, F.lit("●")).otherwise(F.lit("○"))))
    tiles.write.mode("append" if same else "errorifexists").partitionBy("zoom_level").parquet(f"{options.target}/tiles")
    if stored is not None and not same:
        stored.select([c for c in tiles.columns if c in stored.columns]).write.mode("append").partitionBy("zoom_level").parquet(f"{options.target}/tiles")
    timers.took("encode", 100.0)  # and the insertion, which is the same job
    table = spark.read.parquet(f"{options.target}/tiles")
    scope = table if options.limits_scope == "table" else tiles
    limits = keys.limits(scope.where(F.length("tile_data") > 0).select(F.col("zoom_level").alias("z"), F.col("tile_column").alias("x"), t.reversed_y("zoom_level", "tile_row").alias("y")))
    meta_rows = spark.createDataFrame(metadata_rows(options, bounds), "name string, value string").unionByName(keys.limits_json(limits))
    meta_rows.coalesce(1).write.mode("overwrite").parquet(f"{options.target}/metadata")
    return {"tiles": table, "metadata": spark.read.parquet(f"{options.target}/metadata"), "limits": limits}


def export_mbtiles(spark: SparkSession, target: str, path: str) -> None:
    """The MBTiles file of a finished build."""
    meta = spark.read.parquet(f"{target}/metadata")
    kind = meta.where("name = 'format'").first()["value"]
    mbtiles.export(spark.read.parquet(f"{target}/tiles"), meta, path, alpha=kind == "jpeg")
