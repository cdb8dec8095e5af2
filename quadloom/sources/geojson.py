"""Bounding polygons from GeoJSON in EPSG:4326, as edges in EPSG:3857."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from quadloom.functions import crs

EDGE_SCHEMA = "x1 double, y1 double, x2 double, y2 double"


def polygon_of(text: str) -> list[list[tuple[float, float]]]:
    """Rings of the polygon: a Feature's own, or that of the first feature of a collection which has one.

    Bare geometries and features of other kinds are refused.
    """
    data = json.loads(text)
    kind = data.get("type")
    if kind == "Feature":
        features = [data]
    elif kind == "FeatureCollection":
        features = data.get("features") or []
    else:
        raise ValueError(f"{kind}: a Feature or FeatureCollection is needed")
    for f in features:
        g = f.get("geometry") or {}
        if g.get("type") == "Polygon":
            return [[(float(p[0]), float(p[1])) for p in ring] for ring in g["coordinates"]]
    raise ValueError("no polygon found")


def edges(rings: list[list[tuple[float, float]]]) -> list[tuple[float, float, float, float]]:
    """The rings' edges in EPSG:3857; vertices are projected, edges are not densified. Rings are closed if need be."""
    to = crs.parse("EPSG:4326")
    out = []
    for ring in rings:
        x, y = to.forward([p[0] for p in ring], [p[1] for p in ring])
        points = list(zip(x.tolist(), y.tolist(), strict=True))
        if points[0] != points[-1]:
            points.append(points[0])
        out += [(*a, *b) for a, b in zip(points, points[1:], strict=False)]
    return out


def read_polygon(spark: SparkSession, path: str) -> DataFrame:
    """Edges (x1, y1, x2, y2) of the polygon in the GeoJSON file at `path`."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(edges(polygon_of(text)), EDGE_SCHEMA)
