import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.functions import codec
from quadloom.functions import tiles as t
from quadloom.functions.tiles import HALF
from quadloom.operators import keys, pyramid
from quadloom.plans.build import TilerOptions, build_tiles, export_mbtiles
from quadloom.sources import geojson, mbtiles, raster
from quadloom.streaming import stats

Z, TS = 5, 16


def write_raster(folder, px, x=12, y=9, zoom=Z, **side):
    """A raster whose pixels coincide with those of tiles at `zoom`, from tile x, y on."""
    folder.mkdir(exist_ok=True)
    (folder / "r.png").write_bytes(codec.encode_png(px))
    step = 2 * HALF / (1 << zoom) / TS
    gt = [x * step * TS - HALF, step, 0.0, HALF - y * step * TS, 0.0, -step]
    (folder / "r.png.json").write_text(json.dumps({"geo_transform": gt, "srs": "EPSG:3857"} | side))
    return str(folder)


def gradient(h, w, bands):
    yy, xx = np.mgrid[:h, :w]
    return np.stack([(xx * 3 + yy * (k + 1)) % 200 + 20 for k in range(bands)], 2).astype(np.uint8)


def options(tmp_path, source, **more):
    return TilerOptions(source, str(tmp_path / "out"), Z, **({"tile_size": TS, "format": "png", "warp_zoom_offset": 2} | more))


def pixels(table, z, x, y):
    r = table.where((F.col("zoom_level") == z) & (F.col("tile_column") == x) & (F.col("tile_row") == (1 << z) - 1 - y)).collect()
    return codec.decode_png(bytes(r[0].tile_data)) if r and len(r[0].tile_data) else None


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_aligned_raster_is_sliced_and_reduced(spark, tmp_path, bands):
    px = gradient(40, 48, bands)
    if bands in (2, 4):
        px[:, :, -1] = 255
        px[:16, :16, -1] = 0
    src = write_raster(tmp_path / "src", px)
    got = build_tiles(spark, options(tmp_path, src))
    table = got["tiles"]
    full = px if bands in (2, 4) else np.dstack([px, np.full(px.shape[:2], 255, np.uint8)])
    assert (pixels(table, Z, 13, 9) == full[:16, 16:32]).all()
    first = pixels(table, Z, 12, 9)
    assert first is None if bands in (2, 4) else (first == full[:16, :16]).all()
    low = pixels(table, Z, 12, 11)
    assert (low[:8] == full[32:40, :16]).all() and not low[8:].any()
    kids = {(x & 1, y & 1): p for x, y in ((12, 8), (13, 8), (12, 9), (13, 9)) if (p := pixels(table, Z, x, y)) is not None}
    assert (pixels(table, Z - 1, 6, 4) == pyramid.compose(kids, TS, full.shape[2])).all()
    assert table.where("zoom_level = 0").count() == 1
    limits = {r.z: r for r in got["limits"].collect()}
    assert limits[Z].min_x == 12 and limits[Z].max_x == 14 and limits[Z].max_y == (1 << Z) - 1 - 9
    names = {r.name: r.value for r in got["metadata"].collect()}
    assert names["minzoom"] == "0" and names["maxzoom"] == str(Z) and json.loads(names["limits"])[str(Z)]["min_x"] == 12


def test_jpeg_markers_and_mbtiles(spark, tmp_path):
    px = np.dstack([gradient(32, 32, 3), np.full((32, 32), 255, np.uint8)])
    px[16:, 16:, 3] = 0
    px[:16, :16, 3] = 128
    got = build_tiles(spark, options(tmp_path, write_raster(tmp_path / "src", px), format="jpeg", debug=True))
    rows = {(r.tile_column, (1 << Z) - 1 - r.tile_row): r for r in got["tiles"].where(f"zoom_level = {Z}").collect()}
    assert len(rows[13, 10].tile_data) == 0 and rows[13, 10].steps == "W○" and rows[12, 9].steps == "W●"
    assert len(rows[13, 9].tile_alpha) == 0 and len(rows[12, 9].tile_alpha) > 0
    path = str(tmp_path / "t.mbtiles")
    export_mbtiles(spark, str(tmp_path / "out"), path)
    back = mbtiles.read_mbtiles(spark, path)
    assert back.count() == got["tiles"].count() and back.where(f"zoom_level = {Z}").count() == len(rows)
    assert mbtiles.read_metadata(path)["format"] == "jpeg"
    lean = build_tiles(spark, TilerOptions(str(tmp_path / "src"), str(tmp_path / "lean"), Z, tile_size=TS, insert_empty=False))
    assert lean["tiles"].where(F.length("tile_data") == 0).isEmpty()


def test_resume_equals_full_build(spark, tmp_path):
    src = write_raster(tmp_path / "src", np.dstack([gradient(64, 64, 3), np.full((64, 64), 255, np.uint8)]))
    full = build_tiles(spark, options(tmp_path, src))["tiles"]
    part = full.where((F.col("tile_column") * 31 + F.col("tile_row") * 17) % 3 == 0)
    part.write.partitionBy("zoom_level").parquet(str(tmp_path / "part" / "tiles"))
    again = build_tiles(spark, TilerOptions(src, str(tmp_path / "new"), Z, continue_from=str(tmp_path / "part"), tile_size=TS, format="png", warp_zoom_offset=2))["tiles"]
    key = ["zoom_level", "tile_column", "tile_row"]
    assert sorted(map(tuple, full.select(*key, F.md5("tile_data")).collect())) == sorted(map(tuple, again.select(*key, F.md5("tile_data")).collect()))
    with pytest.raises(FileExistsError):
        build_tiles(spark, options(tmp_path, src))


def test_layout_srs_and_nodata(spark, tmp_path):
    with pytest.raises(ValueError, match="bands"):
        raster.read_meta(spark, write_raster(tmp_path / "a", gradient(8, 8, 2), bands=["red", "green"]))
    with pytest.raises(ValueError, match="coordinate system"):
        build_tiles(spark, options(tmp_path, write_raster(tmp_path / "b", gradient(8, 8, 1), srs=None)))
    px = np.full((16, 16, 1), 9, np.uint8)
    px[3, 4] = 200
    got = build_tiles(spark, options(tmp_path, write_raster(tmp_path / "c", px, nodata=[200]), use_nodata=True))
    out = pixels(got["tiles"], Z, 12, 9)
    assert out[3, 4].tolist() == [0, 0] and out[0, 0].tolist() == [9, 255]


def test_geographic_source_and_polygon(spark, tmp_path):
    folder = tmp_path / "geo"
    folder.mkdir()
    (folder / "r.png").write_bytes(codec.encode_png(np.full((40, 60, 3), 90, np.uint8)))
    (folder / "r.png.json").write_text(json.dumps({"geo_transform": [10.0, 0.5, 0, 55.0, 0, -0.5], "srs": "EPSG:4326"}))
    ring = [[12.0, 50.0], [20.0, 50.0], [20.0, 52.0], [12.0, 50.0]]
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    whole = build_tiles(spark, TilerOptions(str(folder), str(tmp_path / "w"), 6, tile_size=TS, format="png"))
    cut = build_tiles(spark, TilerOptions(str(folder), str(tmp_path / "q"), 6, tile_size=TS, format="png", bounding_polygon=str(tmp_path / "p.json")))
    a, b = whole["tiles"].where("zoom_level = 6").count(), cut["tiles"].where("zoom_level = 6").count()
    assert 0 < b < a
    x = int((math.radians(20.0) * 6378137 + HALF) / (2 * HALF / 64))
    y = int((HALF - math.log(math.tan(math.pi / 4 + math.radians(50.0) / 2)) * 6378137) / (2 * HALF / 64))
    assert (pixels(whole["tiles"], 6, x, y)[:, :, :3] == 90).all()


def test_geojson_rules():
    poly = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    assert len(geojson.edges(geojson.polygon_of(json.dumps({"type": "Feature", "geometry": poly})))) == 3
    for bad in (poly, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": []}}, {"type": "FeatureCollection", "features": []}):
        with pytest.raises(ValueError):
            geojson.polygon_of(json.dumps(bad))


def test_polygon_holes_and_containment(spark):
    square = lambda a, b: [(a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a)]
    cells = spark.range(400).select(F.lit(9).alias("z"), (F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"))
    x, y = F.col("x"), F.col("y")
    box = {"min_x": x, "min_y": y, "max_x": x + 1, "max_y": y + 1}
    got = {(r.x, r.y) for r in keys.in_polygon(cells, [tuple(map(float, e)) for e in square(2.5, 15.5) + square(5.5, 10.5)], box).collect()}
    assert got == {(i, j) for i in range(20) for j in range(20) if 2 <= i <= 15 and 2 <= j <= 15 and not (6 <= i <= 9 and 6 <= j <= 9)}
    assert keys.in_polygon(cells, [tuple(map(float, e)) for e in square(3.2, 3.4)], box).count() == 1


def box_of(z, x, y):
    side = 2 * HALF / (1 << z)
    return x * side - HALF, HALF - (y + 1) * side, (x + 1) * side - HALF, HALF - y * side


def in_area(edges, box):
    """Whether a box meets an area, told edge by edge."""
    x0, y0, x1, y1 = box
    odd = False
    for a, b, c, d in edges:
        if min(a, c) <= x1 and max(a, c) >= x0 and min(b, d) <= y1 and max(b, d) >= y0:
            turns = [(c - a) * (y - b) - (d - b) * (x - a) for x in (x0, x1) for y in (y0, y1)]
            if min(turns) <= 0 <= max(turns):
                return True
        odd ^= (b > y0) != (d > y0) and x0 < (c - a) * (y0 - b) / (d - b) + a
    return odd


def test_polygon_descent_equals_a_test_of_every_tile(spark, monkeypatch):
    rng = np.random.default_rng(4)

    def star(r, n, rough):
        at = 2 * np.pi * np.arange(n) / n
        far = r * (1 + rough * rng.uniform(-1, 1, n))
        points = list(zip((2e6 + far * np.cos(at)).tolist(), (6e6 + far * np.sin(at)).tolist(), strict=True))
        return [(*a, *b) for a, b in zip(points, points[1:] + points[:1], strict=True)]

    edges = star(8e5, 200, 0.3) + star(2e5, 30, 0.1)  # with a hole
    box = (1.1e6, 5.05e6, 3.2e6, 7e6)
    for first in (keys.FIRST_CELLS, 4):
        monkeypatch.setattr(keys, "FIRST_CELLS", first)
        for z in (0, 6, 9):
            every = keys.bbox_tiles(spark, *box, z)
            want = sorted((r.x, r.y) for r in every.collect() if in_area(edges, box_of(z, r.x, r.y)))
            assert sorted((r.x, r.y) for r in keys.polygon_tiles(spark, *box, z, edges).collect()) == want
            bounds = t.bounds("z", "x", "y")
            assert sorted((r.x, r.y) for r in keys.in_polygon(every, edges, bounds).collect()) == want
    far = [tuple(v + 1e7 for v in e) for e in edges]
    assert keys.polygon_tiles(spark, *box, 9, far).isEmpty() and keys.in_polygon(every.limit(0), edges, bounds).isEmpty()


def test_places_in_z_order(spark):
    tiles = spark.range(2000).select(F.lit(12).alias("z"), (F.col("id") * 7919 % 100).cast("int").alias("x"), (F.col("id") * 104729 % 64).cast("int").alias("y"))
    rows = keys.z_order_position(tiles.unionByName(tiles.limit(50))).orderBy("n").collect()  # equal keys get places in turn
    assert [r.n for r in rows] == list(range(1, 2051)) and {r.total for r in rows} == {2050}
    assert all(a.m <= b.m for a, b in zip(rows, rows[1:], strict=False))
    shares = sorted(r.pct for r in keys.progress(tiles).collect())
    assert shares[0] == 0 and shares[-1] < 100


def test_event_log_can_be_followed(spark, tmp_path):
    px = gradient(20, 20, 3)
    got = build_tiles(spark, options(tmp_path, write_raster(tmp_path / "src", px)))
    events = spark.read.parquet(str(tmp_path / "out" / "events"))
    assert [r.metric for r in events.orderBy("t").collect()] == ["select", "warp", "compose", "compose", "encode"] and got["tiles"].count() > 0
    last = stats.gauges(events, {"pct": "pct", "left": "left"}).first()
    assert (last.pct, last.left) == (100.0, 0)
    follow = stats.console(spark, str(tmp_path / "out"), 1)
    follow.processAllAvailable()
    assert follow.lastProgress["numInputRows"] >= 0 and follow.exception() is None
    follow.stop()


def test_a_build_that_was_cut_short_can_be_made_again(spark, tmp_path):
    src = write_raster(tmp_path / "src", gradient(20, 20, 3))
    left = spark.createDataFrame([(1, "warp", 2, 0.0, 3, "old")], stats.EVENTS)
    left.write.parquet(str(tmp_path / "out" / "events"))
    assert build_tiles(spark, options(tmp_path, src))["tiles"].count() > 0
    assert spark.read.parquet(str(tmp_path / "out" / "events")).select("run").distinct().count() == 2
    (tmp_path / "file").write_text("x")
    with pytest.raises(FileExistsError):
        build_tiles(spark, TilerOptions(src, str(tmp_path / "file"), Z, tile_size=TS))


def test_zooms_of_a_file_are_read_apart(spark, tmp_path):
    px = gradient(40, 40, 3)
    build_tiles(spark, options(tmp_path, write_raster(tmp_path / "src", px)))
    path = str(tmp_path / "t.mbtiles")
    export_mbtiles(spark, str(tmp_path / "out"), path)
    one, two = (mbtiles.read_mbtiles(spark, path, [z]) for z in (Z, Z - 1))
    both = one.unionByName(two).groupBy("zoom_level").count().collect()
    assert {r.zoom_level: r["count"] for r in both} == {Z: one.count(), Z - 1: two.count()} and mbtiles.read_mbtiles(spark, path, []).isEmpty()


def sidecar(folder, name, gt, **side):
    (folder / f"{name}.json").write_text(json.dumps({"geo_transform": gt, "srs": "EPSG:3857"} | side))


def test_many_files_equal_one(spark, tmp_path):
    """Four PNG files and one RAW file of the same pixels, cut off the block grid, give the tiles of one file."""
    px = gradient(70, 90, 3)
    step = 2 * HALF / (1 << Z) / TS
    one = build_tiles(spark, options(tmp_path, write_raster(tmp_path / "one", px)))["tiles"]
    many, raw = tmp_path / "many", tmp_path / "raw"
    many.mkdir()
    raw.mkdir()
    gt = lambda c, r: [(12 * TS + c) * step - HALF, step, 0.0, HALF - (9 * TS + r) * step, 0.0, -step]
    for k, (c0, c1, r0, r1) in enumerate([(0, 33, 0, 41), (33, 90, 0, 41), (0, 33, 41, 70), (33, 90, 41, 70)]):
        (many / f"{k}.png").write_bytes(codec.encode_png(px[r0:r1, c0:c1]))
        sidecar(many, f"{k}.png", gt(c0, r0))
    (raw / "a.raw").write_bytes(px.tobytes())
    sidecar(raw, "a.raw", gt(0, 0), width=90, height=70, bands=["red", "green", "blue"])
    want = sorted((r.zoom_level, r.tile_column, r.tile_row, bytes(r.tile_data)) for r in one.collect())
    for k, folder in enumerate((many, raw)):
        got = build_tiles(spark, TilerOptions(str(folder), str(tmp_path / f"t{k}"), Z, tile_size=TS, format="png", warp_zoom_offset=2))["tiles"]
        assert sorted((r.zoom_level, r.tile_column, r.tile_row, bytes(r.tile_data)) for r in got.collect()) == want


def test_blocks_of_a_mosaic(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    for k, (c, r, v) in enumerate([(0, 0, 1), (6, 3, 2)]):
        (folder / f"{k}.png").write_bytes(codec.encode_png(np.full((8, 10, 1), v, np.uint8)))
        sidecar(folder, f"{k}.png", [100.0 + c, 1.0, 0.0, 50.0 - r, 0.0, -1.0])
    metas = raster.read_meta(spark, str(folder))
    whole, places = raster.together(metas)
    assert (whole.width, whole.height, whole.bbox) == (16, 11, (100.0, 39.0, 116.0, 50.0)) and sorted(places.values()) == [(0, 0, 0), (1, 6, 3)]
    want = np.zeros((11, 16), np.uint8)
    want[:8, :10], want[3:, 6:] = 1, 2
    got = np.zeros((11, 16), np.uint8)
    for b in sorted(raster.read_blocks(spark, str(folder), 4, metas).collect(), key=lambda b: b.ordinal):
        assert b.px + b.w <= 4 and b.py + b.h <= 4
        y, x = b.block_y * 4 + b.py, b.block_x * 4 + b.px
        got[y : y + b.h, x : x + b.w] = np.frombuffer(bytes(b.buf), np.uint8).reshape(b.h, b.w)
    assert (got == want).all()
    assert {(r.min_x, r.max_y) for r in raster.tile_index(metas, spark).collect()} == {(100.0, 50.0), (106.0, 47.0)}
    sidecar(folder, "1.png", [100.5, 1.0, 0.0, 50.0, 0.0, -1.0])
    with pytest.raises(ValueError, match="grid"):
        raster.together(raster.read_meta(spark, str(folder)))


def test_fine_sources_are_reduced_from_a_deeper_zoom(spark, tmp_path):
    px = np.full((256, 256, 3), 120, np.uint8)
    px[:, 128:] = 40
    step = 2 * HALF / (1 << Z) / (TS * 16)  # sixteen source pixels a target pixel
    folder = tmp_path / "fine"
    folder.mkdir()
    (folder / "r.png").write_bytes(codec.encode_png(px))
    sidecar(folder, "r.png", [12 * 2 * HALF / (1 << Z) - HALF, step, 0.0, HALF - 9 * 2 * HALF / (1 << Z), 0.0, -step])
    got = pixels(build_tiles(spark, options(tmp_path, str(folder)))["tiles"], Z, 12, 9)
    assert got.shape == (16, 16, 4) and (got[:, :6, 0] == 120).all() and (got[:, 10:, 0] == 40).all() and (got[:, :, 3] == 255).all()


def fold(rows, period=stats.PERIOD_MS):
    out, opened, n, total = [], None, 0, 0
    for t, d in sorted(rows):
        if opened is None:
            opened = t
        elif t - opened >= period:
            out.append((opened, t, n, total))
            opened, n, total = t, 0, 0
        n, total = n + 1, total + d
    return out


def test_throttle_windows_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(t), int(d)) for t, d in zip(np.cumsum(rng.integers(0, 6000, 300)), rng.integers(1, 90, 300), strict=True)]
    events = spark.createDataFrame([("w", t, d) for t, d in rows], "worker string, t long, d long")
    assert sorted(map(tuple, stats.throttled(events).collect())) == fold(rows)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stats.throttled_stream(stream, "worker").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.opened, r.closed, r.n, r.total) for r in spark.table("windows").collect()) == fold(rows)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "z int, x int, y int")
    assert keys.closure(none, 4).isEmpty() and keys.limits(none).isEmpty() and keys.z_order_position(none).isEmpty() and keys.task_groups(none, 3).isEmpty()
    assert stats.throttled(spark.createDataFrame([], "t long, d long")).isEmpty()
    assert stats.by_metric(spark.createDataFrame([("warp", 3)], "metric string, d long")).first().label == "3/1=3"


def test_command_line():
    from quadloom.__main__ import parse

    options, out = parse(["a", "b", "--max-zoom", "7", "--no-insert-empty", "--format", "png", "--mbtiles", "m"])
    assert options == TilerOptions("a", "b", 7, insert_empty=False, format="png") and out == "m"
    with pytest.raises(SystemExit):
        parse(["a", "b"])
    for bad in ({"format": "gif"}, {"max_zoom": 40}, {"jpeg_quality": 0}, {"limits_scope": "x"}):
        with pytest.raises(ValueError):
            TilerOptions(**({"source": "a", "target": "b", "max_zoom": 3} | bad)).checked()
    assert TilerOptions("a", "b", 2).checked().warp_zoom_offset == 2
