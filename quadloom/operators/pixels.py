"""Operators on the relational form of a gray+alpha raster: one row (px, py, g, a) a pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.resample import HALF_UP, taps


def masked(pixels: DataFrame) -> DataFrame:
    """Colour and alpha zeroed where alpha is 0."""
    return pixels.withColumn("g", F.when(F.col("a") > 0, F.col("g")).otherwise(0))


def without_nodata(pixels: DataFrame, nodata: int) -> DataFrame:
    """Pixels with the no-data value become transparent black."""
    hit = F.col("g") == nodata
    return pixels.withColumn("a", F.when(hit, 0).otherwise(F.col("a"))).withColumn("g", F.when(hit, 0).otherwise(F.col("g")))


def base_tiles(pixels: DataFrame) -> DataFrame:
    """tx, ty, n_pixels, masked_sum, has_data, opaque of each tile (tx, ty) of pixels."""
    return pixels.groupBy("tx", "ty").agg(
        F.count("*").alias("n_pixels"),
        F.sum(F.when(F.col("a") > 0, F.col("g")).otherwise(0)).alias("masked_sum"),
        (F.max("a") > 0).alias("has_data"),
        F.bool_and(F.col("a") == 255).alias("opaque"),
    )


def interleaved(pixels: DataFrame) -> DataFrame:
    """py, row: the pixels of each row as g,a pairs from left to right; colour and alpha are zipped by place."""
    planes = pixels.groupBy("py").agg(F.sort_array(F.collect_list(F.struct("px", "g"))).alias("g"), F.sort_array(F.collect_list(F.struct("px", "a"))).alias("a"))
    pair = F.zip_with("g", "a", lambda g, a: F.concat_ws(",", g["g"], a["a"]))
    return planes.select("py", F.array_join(pair, ";").alias("row"))


def _spread(rows: DataFrame, keys: list[str], axis: str, values: list[str], size: int | None) -> DataFrame:
    """One pass of 2:1 Lanczos reduction along `axis`: each input row goes to the outputs it has a tap for, and the weighted values
    are summed; size: outputs beyond it are no part of the canvas."""
    out = F.explode(F.array(*(F.struct(F.floor((F.col(axis) - 1 - o) / 2).cast("int").alias("at"), F.lit(w).alias("w"), ((F.col(axis) - 1 - o) % 2 == 0).alias("hit")) for o, w in taps())))
    hit = rows.select(*keys, *values, axis, out.alias("t")).where("t.hit").select(*keys, *values, F.col("t.at").alias(axis), F.col("t.w").alias("w"))
    inside = hit.where((F.col(axis) >= 0) & (F.col(axis) < size)) if size else hit.where(F.col(axis) >= 0)
    return inside.groupBy(*keys, axis).agg(*((F.sum(F.col(v) * F.col("w")) / F.sum("w")).alias(v) for v in values))


def rounded(v: str):
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(v))) + HALF_UP).cast("int")


def halved(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """px, py, g of the whole image at half size: vertical pass, then horizontal pass; taps outside are dropped."""
    down = _spread(pixels.select("px", "py", "g"), ["px"], "py", ["g"], height // 2)
    across = _spread(down, ["py"], "px", ["g"], width // 2)
    return across.select("px", "py", rounded("g").alias("g"))


def parents(pixels: DataFrame, tile: int) -> DataFrame:
    """px2, py2 (parent tile), x, y, g, a: each parent composed of its 2 x 2 children and reduced 2:1 inside that canvas.

    pixels: tx, ty, ix, iy (place in the tile), g, a, masked. A missing child is transparent black and takes part.
    """
    have = pixels.select(F.shiftright("tx", 1).alias("p"), F.shiftright("ty", 1).alias("q"), ((F.col("tx") % 2) * tile + F.col("ix")).alias("x"), ((F.col("ty") % 2) * tile + F.col("iy")).alias("y"), "g", "a")
    cells = have.select("p", "q").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(2 * tile - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(2 * tile - 1))))
    canvas = cells.join(have, ["p", "q", "x", "y"], "left").na.fill(0, ["g", "a"])
    down = _spread(canvas, ["p", "q", "x"], "y", ["g", "a"], tile)
    across = _spread(down, ["p", "q", "y"], "x", ["g", "a"], tile)
    return across.select("p", "q", "x", "y", rounded("g").alias("g"), rounded("a").alias("a"))


def with_alpha(pixels: DataFrame, edges) -> DataFrame:
    """pixels (px, py and colour) with a: 255 where the pixel's centre lies inside the polygon of `edges` (x1, y1, x2, y2 in pixels,
    by even-odd crossings), else 0."""
    x, y = F.col("px") + 0.5, F.col("py") + 0.5
    crossings = F.lit(0)
    for x1, y1, x2, y2 in edges:
        if y1 != y2:
            hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + F.when(hit, 1).otherwise(0)
    return pixels.withColumn("a", F.when(crossings % 2 == 1, 255).otherwise(0))
