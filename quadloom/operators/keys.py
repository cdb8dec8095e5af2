"""Operators on tile keys: coverage, polygon filter, closure, limits, tasks, order, readiness and resume."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.functions import tiles as t
from quadloom.operators.lineage import saved


def _range(min_x: float, min_y: float, max_x: float, max_y: float, zoom: int, beyond: bool = False) -> tuple[int, int, int, int]:
    side, last = 2 * t.HALF / (1 << zoom), (1 << zoom) - 1
    clip = lambda v: int(v // 1 if beyond and math.isfinite(v) else max(0, min(last, v // 1)))
    return clip((min_x + t.HALF) / side), clip((max_x + t.HALF) / side), clip((t.HALF - max_y) / side), clip((t.HALF - min_y) / side)


def _n_tiles(min_x: float, min_y: float, max_x: float, max_y: float, zoom: int, beyond: bool = False) -> int:
    x0, x1, y0, y1 = _range(min_x, min_y, max_x, max_y, zoom, beyond)
    return (x1 - x0 + 1) * (y1 - y0 + 1)


def bbox_tiles(spark: SparkSession, min_x: float, min_y: float, max_x: float, max_y: float, zoom: int, beyond: bool = False) -> DataFrame:
    """z, x, y of every tile that touches a box in EPSG:3857 metres. Keys are made on the executors from a range. beyond: the grid goes
    on past the square of the world, so a box that leaves it keeps all its tiles (keys are then outside 0 .. 2^z - 1)."""
    x0, x1, y0, y1 = _range(min_x, min_y, max_x, max_y, zoom, beyond)
    n = x1 - x0 + 1
    return spark.range(n * (y1 - y0 + 1)).select(F.lit(zoom).alias("z"), (F.col("id") % n + x0).cast("int").alias("x"), (F.floor(F.col("id") / n) + y0).cast("int").alias("y"))


EDGE = ("x1", "y1", "x2", "y2")
BOX = ("min_x", "min_y", "max_x", "max_y")
#: Levels between two steps of a descent, and cells that a descent may start from.
DESCENT, FIRST_CELLS = 4, 1 << 12


def _meets(e: Column, box: list[Column]) -> Column:
    """Whether an edge meets a rectangle, touching included: their boxes overlap, and the corners are not all strictly on one side."""
    x0, y0, x1, y1 = box
    cross = [(e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) for x in (x0, x1) for y in (y0, y1)]
    overlap = (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0)
    return overlap & (F.least(*cross) <= 0) & (F.greatest(*cross) >= 0)


def _crosses(e: Column, box: list[Column]) -> Column:
    """Whether an edge crosses the ray from the least corner to the right."""
    x0, y0 = box[:2]
    at = (e["x2"] - e["x1"]) * (y0 - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
    return ((e["y1"] > y0) != (e["y2"] > y0)) & (x0 < at)


def _judged(cells: DataFrame) -> DataFrame:
    """cells (BOX, edges: all that overlap the box's rows and reach its left side or lie right of it) that the polygon meets, with
    partial: whether an edge meets the cell. Without one it is inside as a whole or outside as a whole, by even-odd crossings."""
    box = [F.col(k) for k in BOX]
    marked = cells.withColumn("partial", F.exists("edges", lambda e: _meets(e, box)))
    inside = F.size(F.filter("edges", lambda e: _crosses(e, box))) % 2 == 1
    return marked.where(F.when(F.col("partial"), True).otherwise(inside))


def _near(box: list[Column]):
    """Whether an edge can tell anything of a box."""
    return lambda e: (F.greatest(e["y1"], e["y2"]) >= box[1]) & (F.least(e["y1"], e["y2"]) <= box[3]) & (F.greatest(e["x1"], e["x2"]) >= box[0])


def polygon_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """cells (with BOX columns) that meet the polygon of `edges` (EDGE), with partial and edges as in _judged.

    Cells and edges meet on bands of y as high as the cells, so no cell is tested against edges of other rows. An edge of any length is
    listed once a band.
    """
    cells = saved(cells)
    low, high, side = cells.agg(F.min("min_y"), F.max("max_y"), F.max(F.col("max_y") - F.col("min_y"))).first()
    if low is None:
        return cells.withColumn("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).withColumn("partial", F.lit(False))
    band = lambda v: F.floor((v - F.lit(low)) / F.lit(side)).cast("long")
    bottom, top = F.least("y1", "y2"), F.greatest("y1", "y2")
    near = edges.select(*(F.col(k).cast("double") for k in EDGE)).where((top >= low) & (bottom <= high))
    banded = near.select(F.struct(*EDGE).alias("e"), F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), band(bottom)), F.least(band(F.lit(high)), band(top)))).alias("band"))
    # edges that end on a cell's boundary count in both bands: cells ask for the bands of both ends
    asked = cells.withColumn("cell", F.monotonically_increasing_id()).withColumn("band", F.explode(F.array_distinct(F.array(band(F.col("min_y")), band(F.col("max_y"))))))
    box = [F.col(k) for k in BOX]
    met = asked.join(banded, "band").where(_near(box)(F.col("e")))
    lists = met.groupBy("cell").agg(F.first(F.struct(*cells.columns)).alias("c"), F.collect_set("e").alias("edges"))
    return _judged(lists.select("c.*", "edges"))


def in_polygon(tiles: DataFrame, edges: DataFrame | list, bounds: dict[str, Column], levels: int = DESCENT) -> DataFrame:
    """The tiles (z, x, y) whose rectangle (`bounds`: min_x, min_y, max_x, max_y) meets the polygon of `edges`, touching included.

    An edge meets a rectangle if their boxes overlap and the corners do not all lie strictly on one side of it; else the
    rectangle is inside if a corner is, by even-odd crossings. Holes are edges like others. The ancestors `levels` up are judged first:
    tiles of one outside go and tiles of one inside stay unseen; the others are compared with their ancestor's edges only.
    """
    tiles, edges = saved(tiles), _edges(tiles, edges)
    keyed = tiles.select("*", F.col("z").alias("__z"), t.ancestor("x", levels).alias("__x"), t.ancestor("y", levels).alias("__y"), *(bounds[k].cast("double").alias(f"__{k}") for k in BOX))
    cell = ["__z", "__x", "__y"]
    whole = keyed.groupBy(*cell).agg(*((F.min if k[:3] == "min" else F.max)(f"__{k}").alias(k) for k in BOX))
    known = polygon_cells(whole, edges).select(*cell, "partial", "edges")
    box = [F.col(f"__{k}") for k in BOX]
    meets = F.exists("edges", lambda e: _meets(e, box)) | (F.size(F.filter("edges", lambda e: _crosses(e, box))) % 2 == 1)
    return keyed.join(known, cell).where(F.when(F.col("partial"), meets).otherwise(True)).select(tiles.columns)


def _edges(tiles: DataFrame, edges: DataFrame | list) -> DataFrame:
    if isinstance(edges, DataFrame):
        return edges
    return tiles.sparkSession.createDataFrame([tuple(map(float, e)) for e in edges], ", ".join(f"{k} double" for k in EDGE))


def polygon_tiles(spark: SparkSession, min_x: float, min_y: float, max_x: float, max_y: float, zoom: int, edges: DataFrame | list, beyond: bool = False) -> DataFrame:
    """z, x, y of every tile of a zoom that touches a box in EPSG:3857 metres and meets the polygon of `edges`.

    A quadtree descent: cells of a low zoom are judged first, and only those on the outline are split, by some levels at a time and
    with the edges near them. Cells inside become tiles without a test, so work grows with the outline and the result.
    """
    z = zoom
    while z > 0 and _n_tiles(min_x, min_y, max_x, max_y, z, beyond) > FIRST_CELLS:
        z = max(0, z - DESCENT)
    first = bbox_tiles(spark, min_x, min_y, max_x, max_y, z, beyond)
    cells = polygon_cells(first.select("*", *(v.alias(k) for k, v in t.bounds("z", "x", "y").items())), _edges(first, edges))
    whole = None  # cells inside, of any zoom
    while True:
        cells = saved(cells.select("z", "x", "y", "partial", "edges"))
        if z == zoom:
            break
        inside = cells.where("not partial").select("z", "x", "y")
        whole = inside if whole is None else whole.unionByName(inside)
        k = min(DESCENT, zoom - z)
        z += k
        split = cells.where("partial").select("edges", F.lit(z).alias("z"), F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.sequence(F.lit(0), F.lit((1 << 2 * k) - 1))).alias("i"))
        split = split.select("z", (F.col("px") * (1 << k) + F.col("i") % (1 << k)).cast("int").alias("x"), (F.col("py") * (1 << k) + F.shiftright("i", k)).cast("int").alias("y"), "edges")
        boxed = split.select("*", *(v.alias(n) for n, v in t.bounds("z", "x", "y").items()))
        cells = _judged(boxed.withColumn("edges", F.filter("edges", _near([F.col(n) for n in BOX]))).repartition(F.col("x"), F.col("y")))
    out = cells.select("z", "x", "y")
    if whole is not None:
        n = F.pow(F.lit(2.0), F.lit(zoom) - F.col("z")).cast("long")
        # one row a row of tiles first, dealt anew, so that no cell becomes all its tiles in one task
        rows = whole.withColumn("n", n).select("x", "n", F.explode(F.sequence(F.col("y") * F.col("n"), (F.col("y") + 1) * F.col("n") - 1)).alias("ty")).repartition(F.col("x"), F.col("ty"))
        full = rows.select(F.lit(zoom).alias("z"), F.explode(F.sequence(F.col("x") * F.col("n"), (F.col("x") + 1) * F.col("n") - 1)).alias("x"), F.col("ty").cast("int").alias("y")).withColumn("x", F.col("x").cast("int"))
        out = out.unionByName(full)
    x0, x1, y0, y1 = _range(min_x, min_y, max_x, max_y, zoom, beyond)
    return out.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def closure(base: DataFrame, max_zoom: int) -> DataFrame:
    """z, x, y of the base tiles and all their ancestors.

    Ancestors are shared by many tiles: eight levels at a time, the distinct tiles of one level give the next ones, so the rows that
    are exploded shrink by 4^8 from step to step.
    """
    out, now, z = None, base.select("x", "y").distinct(), max_zoom
    while z >= 0:
        k = min(8, z + 1)
        steps = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k")
        level = now.select("x", "y", steps).select((F.lit(z) - F.col("k")).alias("z"), F.expr("shiftright(x, k)").alias("x"), F.expr("shiftright(y, k)").alias("y")).distinct()
        out = level if out is None else out.unionByName(level)
        now = now.select(t.ancestor("x", k).alias("x"), t.ancestor("y", k).alias("y")).distinct()
        z -= k
    return out


def limits(tiles: DataFrame) -> DataFrame:
    """z, min_x, max_x, min_y, max_y over tiles (z, x, y), with TMS rows."""
    y = t.reversed_y("z", "y")
    return tiles.groupBy("z").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def limits_json(limits_: DataFrame) -> DataFrame:
    """One row, name and value: the limits as JSON keyed by zoom. There are as many entries as zooms."""
    entry = F.struct("z", F.struct("min_x", "max_x", "min_y", "max_y").alias("l"))
    return limits_.agg(F.sort_array(F.collect_list(entry)).alias("e")).select(F.lit("limits").alias("name"), F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["z"].cast("string"), x["l"])))).alias("value"))


def task_groups(tiles: DataFrame, offset: int) -> DataFrame:
    """az, ax, ay, n_tiles and the range of sectors of the tiles (z, x, y) of each ancestor `offset` levels up: one task each."""
    sx, sy = t.sector("x", offset), t.sector("y", offset)
    keyed = tiles.select((F.col("z") - offset).alias("az"), t.ancestor("x", offset).alias("ax"), t.ancestor("y", offset).alias("ay"), sx.alias("sx"), sy.alias("sy"))
    return keyed.groupBy("az", "ax", "ay").agg(F.count("*").alias("n_tiles"), F.min("sx").alias("min_sx"), F.max("sx").alias("max_sx"), F.min("sy").alias("min_sy"), F.max("sy").alias("max_sy"))


def task_islands(tiles: DataFrame, offset: int, coarse: int = 5) -> DataFrame:
    """ax, ay, n_islands, n_tiles: runs of tiles with one ancestor in z-order.

    A quadrant is contiguous in z-order, so windows may be split by a coarser ancestor and no run is cut.
    """
    ax, ay = t.ancestor("x", offset), t.ancestor("y", offset)
    keyed = tiles.select(ax.alias("ax"), ay.alias("ay"), t.morton("x", "y").alias("m"))
    w = Window.partitionBy(t.ancestor("ax", coarse), t.ancestor("ay", coarse)).orderBy("m")
    before = F.lag(F.struct("ax", "ay")).over(w)
    marked = keyed.withColumn("starts", F.when(before.isNull() | (before != F.struct("ax", "ay")), 1).otherwise(0))
    return marked.groupBy("ax", "ay").agg(F.sum("starts").alias("n_islands"), F.count("*").alias("n_tiles"))


def ready_parents(processed: DataFrame, pending: DataFrame) -> DataFrame:
    """x, y of the parents of processed tiles none of whose children is pending; children outside both count as done."""
    up = [t.parent("x").alias("x"), t.parent("y").alias("y")]
    return processed.select(*up).distinct().join(pending.select(*up).distinct(), ["x", "y"], "left_anti")


def todo(tiles: DataFrame, done: DataFrame) -> DataFrame:
    """The tiles (z, x, y) that are not stored yet."""
    return tiles.join(done.select("z", "x", "y"), ["z", "x", "y"], "left_anti")


def ordered(tiles: DataFrame) -> DataFrame:
    """The tiles in z-order: ranges of the key, sorted inside."""
    return tiles.withColumn("m", t.morton("x", "y")).repartitionByRange("m").sortWithinPartitions("m")


def z_order_position(tiles: DataFrame) -> DataFrame:
    """tiles with n (from 1) in z-order and total; equal keys get places in turn.

    Ranges of the key are sorted inside, once, and saved; a place is the tiles of the ranges before, one row a range, and the place in its own.
    """
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = tiles.withColumn("m", t.morton("x", "y")).repartitionByRange(parts, "m").sortWithinPartitions("m")
    placed = saved(placed.withColumn("range", F.spark_partition_id()).withColumn("inside", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("range").agg(F.count("*").alias("c"))
    before = (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("offset")  # over ranges
    ranges = F.broadcast(counts.select("range", before, F.sum("c").over(Window.partitionBy()).alias("total")))
    return placed.join(ranges, "range").withColumn("n", F.col("inside") + F.col("offset") + 1).drop("range", "inside", "offset")


def progress(tiles: DataFrame) -> DataFrame:
    """tiles with pct: the share of work done before each tile, in per cent (the count is read before it is raised)."""
    return z_order_position(tiles).withColumn("pct", (F.col("n") - 1) / F.col("total") * 100)
