"""A build's calls and tasks do not grow with what they need not grow with."""

import json

import numpy as np

from quadloom.functions import codec, resample
from quadloom.operators import pyramid
from quadloom.sources import raster


def test_few_levels_are_reduced_for_many_neighbours_at_a_time(spark):
    tiles = spark.range(256).selectExpr("6 z", "cast(id % 16 as int) x", "cast(id div 16 as int) y", "cast(repeat(chr(65 + id % 26), 8) as binary) buf")
    above = pyramid.subtree(tiles, 2, 2, 1)
    assert f", {pyramid.GROUP})" in above._jdf.queryExecution().analyzed().toString()  # 64 calls of four tiles before
    px = {(r.x, r.y): np.frombuffer(bytes(r.buf), np.uint8).reshape(2, 2, 2) for r in tiles.collect()}
    got = {(r.z, r.x, r.y): bytes(r.buf) for r in above.collect()}
    assert got == {(5, x, y): pyramid.compose({(i, j): px[2 * x + i, 2 * y + j] for i in (0, 1) for j in (0, 1)}, 2, 2).tobytes() for x in range(8) for y in range(8)}


def test_files_that_are_opened_for_their_size_are_listed_at_once(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k:02d}.png").write_bytes(codec.encode_png(np.full((3, 5, 2), k, np.uint8)))
        (tmp_path / f"{k:02d}.png.json").write_text(json.dumps({"geo_transform": [0.0, 1.0, 0.0, -3.0 * k, 0.0, -1.0], "srs": "EPSG:3857"}))
    sc = spark.sparkContext
    sc.setJobGroup("sizes", "")
    try:
        metas = raster.read_meta(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [(m.width, m.height, m.bands) for m in metas] == [(5, 3, ("gray", "alpha"))] * 40
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("sizes") for s in status.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) < 40  # a task a file before


def test_files_of_known_size_are_not_opened(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.png").write_bytes(b"no image" if k else codec.encode_png(np.zeros((3, 5, 2), np.uint8)))
        size = {"width": 5, "height": 3, "bands": ["gray", "alpha"]} if k else {}
        (tmp_path / f"{k}.png.json").write_text(json.dumps({"geo_transform": [0.0, 1.0, 0.0, -3.0 * k, 0.0, -1.0], "srs": "EPSG:3857"} | size))
    assert [(m.width, m.height) for m in raster.read_meta(spark, str(tmp_path))] == [(5, 3)] * 2


def test_samples_by_axes_are_those_of_single_places():
    rng = np.random.default_rng(3)
    for _ in range(200):
        src = rng.integers(0, 256, (rng.integers(1, 40), rng.integers(1, 40), rng.integers(1, 5))).astype(np.uint8)
        step = rng.choice([0.5, 1.0, 1.7, 4.0])
        col, row = np.meshgrid(rng.integers(-9, 40) + 0.5 + np.arange(9) * step, rng.integers(-9, 40) + rng.random() + np.arange(7) * step)
        got, inside = resample.sample(src, col, row, step)
        want, same = resample.sample(src, col.reshape(-1, 1), row.reshape(-1, 1), step)
        assert (inside.ravel() == same.ravel()).all() and (got[inside] == want.reshape(got.shape)[inside]).all()
