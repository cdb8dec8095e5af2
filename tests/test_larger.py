"""Queries over builds whose raster leaves the square of the world agree with DuckDB."""

import json

import duckdb
import numpy as np
import pytest

from quadloom.operators import keys, pyramid
from quadloom.plans import build_queries
from quadloom.plans.queries import QUERIES, SQL
from quadloom.sources import raster

#: Of a raster of 1,000 rows, from tile row 10 of zoom 6 on, 136 lie below the world.
BEYOND = ["q33_built_base", "q34_built_parents", "q35_built_markers", "q36_resumed_base", "q37_mbtiles_by_zoom", "q38_built_metadata", "q39_debug_steps", "q61_nodata_and_no_markers"]


@pytest.fixture(scope="module")
def tall(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tall")
    duckdb.sql(f"copy (select vec_id + 500 * k as vec_id, embedding, label from '/root/testdata/sf0.001/embeddings.parquet', range(2) t(k)) to '{folder}/embeddings.parquet'")
    return str(folder)


def agrees(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    got, want = QUERIES[name](spark, folder).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(got.columns)
    got, want = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    return len(got) and got.equals(want)


@pytest.mark.parametrize("name", BEYOND)
def test_builds_keep_what_lies_beyond_the_world(spark, tall, name):
    assert agrees(spark, tall, name)


def test_tiles_beyond_the_world_by_option(spark):
    box = (-1e6, -6e7, 1e6, 0.0)
    assert {r.y for r in keys.bbox_tiles(spark, *box, 3).collect()} == set(range(4, 8))
    assert {r.y for r in keys.bbox_tiles(spark, *box, 3, True).collect()} == set(range(4, 16))
    edges = [(-9e5, -5.9e7, 9e5, -5.9e7), (9e5, -5.9e7, 9e5, -5.5e7), (9e5, -5.5e7, -9e5, -5.5e7), (-9e5, -5.5e7, -9e5, -5.9e7)]
    assert {r.y for r in keys.polygon_tiles(spark, *box, 3, edges, True).collect()} == {14, 15} and keys.polygon_tiles(spark, *box, 3, edges).isEmpty()


def test_many_small_raw_files_are_one_scan(spark, tmp_path, monkeypatch):
    px = np.arange(60 * 5 * 2, dtype=np.uint16).astype(np.uint8).reshape(60, 5, 2)
    for k in range(20):
        (tmp_path / f"{k:02d}.raw").write_bytes(px[3 * k : 3 * k + 3].tobytes())
        side = {"geo_transform": [0.0, 1.0, 0.0, -3.0 * k, 0.0, -1.0], "srs": "EPSG:3857", "bands": ["gray", "alpha"], "width": 5, "height": 3}
        (tmp_path / f"{k:02d}.raw.json").write_text(json.dumps(side))

    def read():
        blocks = raster.read_blocks(spark, str(tmp_path), 4)
        out = np.zeros_like(px)
        for b in blocks.collect():
            y, x = b.block_y * 4 + b.py, b.block_x * 4 + b.px
            out[y : y + b.h, x : x + b.w] = np.frombuffer(bytes(b.buf), np.uint8).reshape(b.h, b.w, 2)
        return out, blocks.rdd.getNumPartitions()

    got, parts = read()
    assert (got == px).all() and parts < 20  # each file was a reader of two partitions
    monkeypatch.setattr(raster, "WHOLE", 0)
    assert (read()[0] == px).all()


def test_pixels_reach_python_as_numbers(spark):
    rows = spark.range(2000).selectExpr("cast(id div 4 as int) tx", "3 ty", "cast(id % 2 as int) ix", "cast(id div 2 % 2 as int) iy", "cast(id % 251 as int) g", "255 a")
    tiles = pyramid.from_pixels(rows, 6, 2)
    assert "struct<ix" not in tiles._jdf.queryExecution().analyzed().children().apply(0).schema().simpleString()  # a dict a pixel in Python
    got = {r.x: bytes(r.buf) for r in tiles.collect()}
    assert got == {x: bytes(v for i in range(4 * x, 4 * x + 4) for v in (i % 251, 255)) for x in range(500)}


def test_decoded_tiles_are_passed_on_in_parts(spark, monkeypatch):
    tiles = spark.range(50).selectExpr("6 z", "cast(id as int) x", "3 y", "cast(repeat(chr(65 + id % 26), 8) as binary) buf")
    monkeypatch.setattr(pyramid, "HELD", 1)
    back = pyramid.decode(pyramid.encode(tiles, 2, 2, "png", 85), 2, 2)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tiles.collect()))
    assert pyramid.to_pixels_table(back, 2).count() == 200


def test_python_gets_small_batches_of_tiles(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    pyramid.from_pixels(spark.createDataFrame([], "tx int, ty int, ix int, iy int, g int, a int"), 6, 2)
    assert spark.conf.get(name) == "4m"


def test_strips_are_written_many_at_a_time(spark, tall, tmp_path, monkeypatch):
    calls, put_all = [], build_queries.put_all
    monkeypatch.setattr(build_queries, "put_all", lambda spark, files: (calls.append(len(files)), put_all(spark, files)))
    monkeypatch.setattr(build_queries, "HELD", 5)
    rows = build_queries.cropped(spark, tall)
    build_queries.write_strips(spark, rows, str(tmp_path))
    assert calls == [10, 10, 2]  # 988 rows are 11 strips, each with its sidecar; they were written one by one
    got = raster.read_blocks(spark, str(tmp_path), 32).selectExpr("sum(w * h)", "count(distinct path)").first()
    assert tuple(got) == (rows.count(), 11)
