"""Boolean operations on areas that are given as edges, as masks of sources are made of: dissolve, intersection and buffer.

An area is a set of edges (area long, x1, y1, x2, y2); its inside is told by even-odd crossings, so holes are edges like others and
rings need not be in order. Results are edges too, with the inside on their left, as `keys.in_polygon` and `pixels.with_alpha` take them.
All edges are cut where they meet; a piece stays if the result lies on one of its sides only. Edges meet in cells of a grid, and
points meet the edges right of them in bands of y, by equi-joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.operators.lineage import saved

EDGE = ("x1", "y1", "x2", "y2")
#: Coordinates are rounded to a cell's side times SNAP, and sides are told apart SIDE snaps beside a piece.
SNAP, SIDE = 1e-9, 64
#: Segments of a quarter of a circle around a corner.
QUARTER = 16


def _cells(edges: DataFrame, cell: float) -> DataFrame:
    """edges with cx, cy: a row for each cell of the grid that an edge is in."""
    index = lambda v: F.floor(v / cell).cast("long")
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = edges.withColumn("cx", F.explode(F.sequence(index(left), index(right))))
    slope = F.when(F.col("x1") == F.col("x2"), 0.0).otherwise((F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)))
    at = lambda x: F.col("y1") + slope * (x - F.col("x1"))
    a, b = at(F.greatest(left, F.col("cx") * cell)), at(F.least(right, (F.col("cx") + 1) * cell))
    upright = F.col("x1") == F.col("x2")
    low, high = F.when(upright, F.least("y1", "y2")).otherwise(F.least(a, b)), F.when(upright, F.greatest("y1", "y2")).otherwise(F.greatest(a, b))
    slack = cell * 1e-6
    return columns.withColumn("cy", F.explode(F.sequence(index(low - slack), index(high + slack))))


def pieces(edges: DataFrame, cell: float) -> DataFrame:
    """edges cut wherever another one crosses, touches or overlaps them; ends are rounded."""
    snap = lambda v: F.round(v / (cell * SNAP)) * (cell * SNAP)
    numbered = saved(edges.select(*edges.columns[: -len(EDGE)], *(snap(F.col(c).cast("double")).alias(c) for c in EDGE)).withColumn("id", F.monotonically_increasing_id()))
    placed = _cells(numbered.select("id", *EDGE), cell)
    other = placed.select("cx", "cy", F.col("id").alias("o"), *(F.col(c).alias(f"o{c}") for c in EDGE))
    rx, ry, sx, sy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    qx, qy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    turn, length = rx * sy - ry * sx, rx * rx + ry * ry
    flat = F.abs(turn) <= 1e-12 * F.sqrt(length * (sx * sx + sy * sy))
    t, u = (qx * sy - qy * sx) / F.nullif(turn, F.lit(0.0)), (qx * ry - qy * rx) / F.nullif(turn, F.lit(0.0))
    along = [(qx * rx + qy * ry) / length, ((qx + sx) * rx + (qy + sy) * ry) / length]
    on_line = F.abs(qx * ry - qy * rx) <= 8 * cell * SNAP * F.sqrt(length)
    cuts = F.when(flat, F.when(on_line, F.array(*along))).when((u >= -1e-9) & (u <= 1 + 1e-9), F.array(t))
    met = placed.join(other, ["cx", "cy"]).where((F.col("id") != F.col("o")) & (length > 0)).select("id", F.explode(cuts).alias("t")).where("t > 0 and t < 1")
    every = met.groupBy("id").agg(F.collect_set("t").alias("ts"))
    whole = numbered.join(every, "id", "left")
    stops = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>"))))
    point = lambda s: F.struct(F.when(s == 1, F.col("x2")).otherwise(snap(F.col("x1") + s * rx)).alias("x"), F.when(s == 1, F.col("y2")).otherwise(snap(F.col("y1") + s * ry)).alias("y"))
    walked = whole.withColumn("points", F.transform(stops, point))
    parts = F.transform(F.slice("points", 2, F.size("points") - 1), lambda p, i: F.struct(F.get("points", i)["x"].alias("x1"), F.get("points", i)["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2")))
    return walked.select(*edges.columns[: -len(EDGE)], F.explode(parts).alias("p")).select(*edges.columns[: -len(EDGE)], "p.*").where("x1 != x2 or y1 != y2")


def combined(edges: DataFrame, cell: float, groups: int = 1) -> DataFrame:
    """x1, y1, x2, y2 of what lies in some area of every one of `groups` groups (edges: group, area and EDGE), the inside on the left.

    One group: the areas' union. cell: the side of a grid cell, best a little over the usual length of an edge.
    """
    cut = saved(pieces(edges.select("group", "area", *EDGE), cell))
    each = cut.select(*EDGE).select(*(F.when((F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2"))), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(EDGE, EDGE[2:] + EDGE[:2], strict=True))).distinct()
    each = saved(each.withColumn("id", F.monotonically_increasing_id()))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    norm = SIDE * cell * SNAP / F.sqrt(dx * dx + dy * dy)
    side = lambda s: F.struct(F.lit(s).alias("left"), ((F.col("x1") + F.col("x2")) / 2 - s * norm * dy).alias("px"), ((F.col("y1") + F.col("y2")) / 2 + s * norm * dx).alias("py"))
    points = each.select("id", F.explode(F.array(side(1), side(-1))).alias("s")).select("id", "s.*").withColumn("band", F.floor(F.col("py") / cell))
    bands = F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell)))
    walls = cut.where("y1 != y2").select("group", "area", *EDGE, bands.alias("band"))
    at = F.col("x1") + (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) * dx
    crossed = points.join(walls, "band").where(((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < at))
    odd = crossed.groupBy("id", "left", "group", "area").agg(F.count("*").alias("n")).where("n % 2 = 1")
    inside = odd.groupBy("id", "left").agg(F.count_distinct("group").alias("g")).where(F.col("g") == groups)
    one = inside.groupBy("id").agg(F.count("*").alias("sides"), F.max("left").alias("left")).where("sides = 1")
    return each.join(one, "id").select(*(F.when(F.col("left") == 1, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(EDGE, EDGE[2:] + EDGE[:2], strict=True)))


def dissolved(edges: DataFrame, cell: float) -> DataFrame:
    """The union of areas (area and EDGE)."""
    return combined(edges.select(F.lit(0).alias("group"), "area", *EDGE), cell)


def intersection(one: DataFrame, other: DataFrame, cell: float) -> DataFrame:
    """What lies in an area of `one` and in an area of `other`."""
    return combined(one.select(F.lit(0).alias("group"), "area", *EDGE).unionByName(other.select(F.lit(1).alias("group"), "area", *EDGE)), cell, 2)


def buffered(edges: DataFrame, distance: float, cell: float, quarter: int = QUARTER) -> DataFrame:
    """The union of areas and of all that is within `distance` of their edges; corners are rounded by `quarter` segments a right angle."""
    numbered = saved(edges.select(*EDGE).withColumn("area", -1 - F.monotonically_increasing_id()))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = F.atan2(dy, dx)

    def half(x: str, y: str, turned: float) -> Column:
        """Points of the half circle around one end, seen from the edge."""
        return F.transform(F.sequence(F.lit(0), F.lit(2 * quarter)), lambda i: F.struct((F.col(x) + distance * F.cos(angle + turned + i * (math.pi / 2 / quarter))).alias("x"), (F.col(y) + distance * F.sin(angle + turned + i * (math.pi / 2 / quarter))).alias("y")))

    around = numbered.withColumn("ring", F.concat(half("x2", "y2", -math.pi / 2), half("x1", "y1", math.pi / 2)))
    sides = F.transform("ring", lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get("ring", (i + 1) % F.size("ring"))["x"].alias("x2"), F.get("ring", (i + 1) % F.size("ring"))["y"].alias("y2")))
    capsules = around.select("area", F.explode(sides).alias("e")).select("area", "e.*")
    return dissolved(edges.select("area", *EDGE).unionByName(capsules), cell)


def measure(edges: DataFrame) -> DataFrame:
    """One row, area: of edges with the inside on their left."""
    return edges.agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))
