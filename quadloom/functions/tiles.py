"""Tile arithmetic as Column expressions: keys (z, x, y) in the XYZ scheme, y down, and TMS rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Half the side of the Web-Mercator square in metres.
HALF = 20037508.342789244
RADIUS = 6378137.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ancestor(x, n: int) -> Column:
    """Coordinate x or y of the ancestor n levels up."""
    return F.shiftright(_c(x), n)


def parent(x) -> Column:
    return ancestor(x, 1)


def children(z, x, y) -> Column:
    """The four children as array<struct<z,x,y>>; child i lies at (i & 1, i >> 1)."""
    return F.array(*(F.struct((_c(z) + 1).alias("z"), (_c(x) * 2 + (i & 1)).alias("x"), (_c(y) * 2 + (i >> 1)).alias("y")) for i in range(4)))


def sector(x, n: int) -> Column:
    """Place of a tile inside its ancestor n levels up, in tiles."""
    return _c(x).bitwiseAND((1 << n) - 1)


def reversed_y(z, y) -> Column:
    """TMS row of an XYZ row, and the other way round."""
    return F.pow(F.lit(2.0), _c(z)).cast("int") - 1 - _c(y)


def _spread(v) -> Column:
    x = _c(v).cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(x, y) -> Column:
    """Z-order key: the bits of x and y interleaved, x lowest."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def bounds(z, x, y) -> dict[str, Column]:
    """min_x, min_y, max_x, max_y of a tile in EPSG:3857 metres."""
    side = 2 * HALF / F.pow(F.lit(2.0), _c(z))
    return {
        "min_x": _c(x) * side - HALF,
        "min_y": HALF - (_c(y) + 1) * side,
        "max_x": (_c(x) + 1) * side - HALF,
        "max_y": HALF - _c(y) * side,
    }


def geotransform(min_x, min_y, max_x, max_y, pixels: int) -> Column:
    """The six affine coefficients of a square target of so many pixels a side."""
    return F.array(_c(min_x), (_c(max_x) - _c(min_x)) / pixels, F.lit(0.0), _c(max_y), F.lit(0.0), (_c(min_y) - _c(max_y)) / pixels)


def mercator(lon, lat) -> tuple[Column, Column]:
    """EPSG:4326 degrees to EPSG:3857 metres."""
    return F.radians(_c(lon)) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2)) * RADIUS


def tile_of(metres_x, metres_y, z: int) -> tuple[Column, Column]:
    """The tile that holds a point, clipped to the tile square."""
    side, last = 2 * HALF / (1 << z), (1 << z) - 1
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(v))).cast("int")
    return clip((_c(metres_x) + HALF) / side), clip((F.lit(HALF) - _c(metres_y)) / side)


def even_bands(n) -> Column:
    """Bands of the output for n bands of the source: alpha is added where it is missing."""
    return (F.floor((_c(n) + 1) / 2) * 2).cast("int")


def narrowed(nodata) -> Column:
    """A no-data value as an unsigned byte, saturating."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), _c(nodata).cast("double"))).cast("int")


def mega_size(tile_size: int, zoom_offset: int) -> int:
    """Pixels a side of a megatile; refused beyond 32768."""
    size = tile_size << zoom_offset
    if not 0 < size <= 1 << 15:
        raise ValueError(f"a megatile of {size} pixels a side: lower tile_size or warp_zoom_offset")
    return size


def mean_duration(total, n) -> Column:
    """{total}/{n}={mean}, or - without events; whole milliseconds."""
    return F.when(_c(n) == 0, "-").otherwise(F.concat(_c(total).cast("string"), F.lit("/"), _c(n).cast("string"), F.lit("="), F.floor(_c(total) / _c(n)).cast("string")))


def register_functions(spark: SparkSession) -> None:
    """SQL functions over tile keys, as macros that the optimizer inlines."""
    for signature, kind, body in (
        ("tile_parent(v INT)", "INT", "shiftright(v, 1)"),
        ("tile_ancestor(v INT, n INT)", "INT", "shiftright(v, n)"),
        ("tile_sector(v INT, n INT)", "INT", "v & (shiftleft(1, n) - 1)"),
        ("tile_reversed_y(z INT, y INT)", "INT", "shiftleft(1, z) - 1 - y"),
        ("tile_children(z INT, x INT, y INT)", "ARRAY<STRUCT<z: INT, x: INT, y: INT>>", "transform(sequence(0, 3), i -> named_struct('z', z + 1, 'x', x * 2 + (i & 1), 'y', y * 2 + shiftright(i, 1)))"),
        ("tile_bounds(z INT, x INT, y INT)", "STRUCT<min_x: DOUBLE, min_y: DOUBLE, max_x: DOUBLE, max_y: DOUBLE>", f"named_struct('min_x', x * {2 * HALF!r}D / power(2, z) - {HALF!r}D, 'min_y', {HALF!r}D - (y + 1) * {2 * HALF!r}D / power(2, z), 'max_x', (x + 1) * {2 * HALF!r}D / power(2, z) - {HALF!r}D, 'max_y', {HALF!r}D - y * {2 * HALF!r}D / power(2, z))"),
        ("tile_morton(x INT, y INT)", "BIGINT", "aggregate(sequence(0, 29), 0L, (a, i) -> a | shiftleft(cast(shiftright(x, i) & 1 as bigint), 2 * i) | shiftleft(cast(shiftright(y, i) & 1 as bigint), 2 * i + 1))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
