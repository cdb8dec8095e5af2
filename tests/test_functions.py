import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.functions import codec, crs, resample
from quadloom.functions import tiles as t


def test_tile_algebra(spark):
    rows = spark.createDataFrame([(5, 17, 9), (0, 0, 0), (12, 2200, 1400)], "z int, x int, y int")
    kids = rows.select("z", "x", "y", F.posexplode(t.children("z", "x", "y")).alias("i", "c"))
    back = kids.select((t.parent("c.x") == F.col("x")) & (t.parent("c.y") == F.col("y")) & (t.sector("c.x", 1) == F.col("i") % 2) & (t.sector("c.y", 1) == F.floor(F.col("i") / 2)))
    assert all(r[0] for r in back.collect())
    assert rows.where(t.reversed_y("z", t.reversed_y("z", "y")) != F.col("y")).isEmpty()
    t.register_functions(spark)
    rows.createOrReplaceTempView("keys")
    same = spark.sql("SELECT tile_parent(x), tile_ancestor(x, 3), tile_sector(x, 3), tile_reversed_y(z, y), tile_morton(x, y), tile_bounds(z, x, y).min_x, tile_children(z, x, y)[3].x FROM keys")
    mine = rows.select(t.parent("x"), t.ancestor("x", 3), t.sector("x", 3), t.reversed_y("z", "y"), t.morton("x", "y"), t.bounds("z", "x", "y")["min_x"], F.get(t.children("z", "x", "y"), F.lit(3))["x"])
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, mine.collect()))


def test_morton_keeps_quadrants_together(spark):
    rows = spark.range(256).select((F.col("id") % 16).cast("int").alias("x"), F.floor(F.col("id") / 16).cast("int").alias("y"))
    keys = rows.select(t.morton("x", "y").alias("m"), (t.ancestor("x", 2) + 4 * t.ancestor("y", 2)).alias("q")).groupBy("q").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b - r.a + 1 == r.n == 16 for r in keys)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 4), st.integers(0, 2**32 - 1))
def test_png_round_trip(h, w, bands, seed):
    a = np.random.default_rng(seed).integers(0, 256, (h, w, bands)).astype(np.uint8)
    assert (codec.decode_png(codec.encode_png(a)) == a).all()


def test_jpeg_is_near_and_readable_by_spark(spark, tmp_path):
    y, x = np.mgrid[:50, :37]
    img = np.stack([x * 5, y * 4, (x + y) * 2], 2).astype(np.uint8)
    for bands in (1, 3):
        data = codec.encode_jpeg(img[:, :, :bands], 95)
        assert np.abs(codec.decode_jpeg(data).astype(int) - img[:, :, :bands]).max() <= 4
        (tmp_path / f"{bands}.jpg").write_bytes(data)
    for r in spark.read.format("image").load(str(tmp_path)).collect():
        bands = r.image.nChannels
        px = np.frombuffer(r.image.data, np.uint8).reshape(r.image.height, r.image.width, bands)[:, :, ::-1]
        assert np.abs(px.astype(int) - img[:, :, :bands]).max() <= 6
    with pytest.raises(ValueError):
        codec.decode_png(b"nothing of the kind")


def test_alpha_planes():
    a = np.full((4, 4), 255, np.uint8)
    assert codec.compress_alpha(a) == b"" and (codec.decompress_alpha(b"", 4, 4) == 255).all()
    a[1, 2] = 7
    assert (codec.decompress_alpha(codec.compress_alpha(a), 4, 4) == a).all()
    px = np.dstack([a, a, a, a])
    assert (codec.join_alpha(*codec.split_alpha(px)) == px).all()


def test_lanczos_keeps_constants():
    assert abs(sum(w for _, w in resample.taps()) - 1) < 1e-8
    assert (resample.halve(np.full((32, 16, 4), 77, np.uint8)) == 77).all()
    px, inside = resample.sample(np.full((9, 9, 2), 50, np.uint8), np.array([[0.5, 4.2, 20.0]]), np.array([[0.5, 4.9, 1.0]]))
    assert (px[0, :2] == 50).all() and inside.tolist() == [[True, True, False]]


PIPELINES = ("EPSG:5514 krovak", "EPSG:8353 krovak", "EPSG:3857", "EPSG:4326", "+proj=pipeline +step +inv +proj=krovak +step +proj=push +v_3 +step +proj=cart +ellps=bessel +step +proj=helmert +x=485.0 +y=169.5 +z=483.8 +rx=7.786 +ry=4.398 +rz=4.103 +s=0 +step +inv +proj=cart +ellps=WGS84 +step +proj=pop +v_3 +step +proj=webmerc")


@pytest.mark.parametrize("text", PIPELINES)
def test_transforms_invert(text):
    tr = crs.parse(text.removesuffix(" krovak"))
    x = np.array([-500000.0, -300000.0]) if "krovak" in text else np.array([17.1, 18.9])
    y = np.array([-1200000.0, -1250000.0]) if "krovak" in text else np.array([48.2, 49.5])
    a, b = tr.inverse(*tr.forward(x, y))
    assert np.allclose(a, x, atol=2e-3) and np.allclose(b, y, atol=2e-3)


def test_krovak_lies_in_central_europe():
    # the published example of the method: 50 12 32.442 N, 16 50 59.179 E gives southing 1050538.64 and westing 568991.00
    lon, lat = math.radians(16 + 50 / 60 + 59.179 / 3600), math.radians(50 + 12 / 60 + 32.442 / 3600)
    x, y = crs.STEPS["krovak"]((np.array([lon]), np.array([lat]), np.zeros(1), np.zeros(1)), False, {})[:2]
    assert abs(x[0] + 568991.00) < 0.1 and abs(y[0] + 1050538.64) < 0.1


def test_unsupported_steps_are_named():
    with pytest.raises(ValueError, match="hgridshift.*x.gsb"):
        crs.parse("+proj=pipeline +step +proj=hgridshift +grids=x.gsb")
    with pytest.raises(ValueError, match="vgridshift"):
        crs.parse("+proj=pipeline +step +proj=vgridshift +grids=x.gtx")
    with pytest.raises(ValueError, match="EPSG:8353"):
        crs.parse("EPSG:32633")
    with pytest.raises(ValueError):
        t.mega_size(256, 8)


def gsb(south, north, east, west, step, shifts, order="<"):
    """An NTv2 file of one grid; degrees, west positive; shifts(lat, lon west) in arc seconds."""
    import struct

    def record(name, kind, v):
        return name.encode().ljust(8) + (struct.pack(order + kind, v).ljust(8, b"\0") if kind != "s" else v.encode().ljust(8))

    rows, columns = round((north - south) / step) + 1, round((west - east) / step) + 1
    head = [("NUM_OREC", "i", 11), ("NUM_SREC", "i", 11), ("NUM_FILE", "i", 1), ("GS_TYPE", "s", "SECONDS"), ("VERSION", "s", "TEST"), ("SYSTEM_F", "s", "A"), ("SYSTEM_T", "s", "B"), *((x, "d", 1.0) for x in ("MAJOR_F", "MINOR_F", "MAJOR_T", "MINOR_T"))]
    sub = [("SUB_NAME", "s", "G"), ("PARENT", "s", "NONE"), ("CREATED", "s", ""), ("UPDATED", "s", ""), *((n, "d", v * 3600) for n, v in (("S_LAT", south), ("N_LAT", north), ("E_LONG", east), ("W_LONG", west), ("LAT_INC", step), ("LONG_INC", step))), ("GS_COUNT", "i", rows * columns)]
    nodes = b"".join(struct.pack(order + "4f", *shifts(south + r * step, east + c * step), 0, 0) for r in range(rows) for c in range(columns))
    return b"".join(record(*x) for x in head + sub) + nodes


@pytest.mark.parametrize("order", ["<", ">"])
def test_grid_shift(order):
    data = gsb(48, 50, -19, -17, 0.5, lambda lat, lon: ((lat - 48) * 3, (lon + 19) * 2 + (lat - 48)), order)
    tr = crs.parse("+proj=pipeline +step +proj=unitconvert +xy_in=deg +xy_out=rad +step +proj=hgridshift +grids=g.gsb,@none.gsb +step +proj=unitconvert +xy_in=rad +xy_out=deg", {"g.gsb": data}.get)
    lon, lat = np.array([18.3, 17.2, 18.99, 25.0]), np.array([48.7, 48.1, 49.9, 49.0])
    x, y = tr.forward(lon, lat)
    # linear shifts are reproduced by bilinear interpolation; longitudes of the grid are west positive
    assert np.allclose(y[:3], lat[:3] + (lat[:3] - 48) * 3 / 3600, atol=1e-9)
    assert np.allclose(x[:3], lon[:3] - ((-lon[:3] + 19) * 2 + (lat[:3] - 48)) / 3600, atol=1e-9)
    assert np.isinf(x[3])
    a, b = tr.inverse(x[:3], y[:3])
    assert np.allclose(a, lon[:3], atol=1e-9) and np.allclose(b, lat[:3], atol=1e-9)


def test_codes_of_krovak_systems_agree_within_their_accuracy():
    x, y = np.array([-450000.0, -500000.0]), np.array([-1200000.0, -1250000.0])
    a, b = (np.array(crs.parse(c).forward(x, y)) for c in ("EPSG:5514", "EPSG:8353"))
    assert 0 < np.abs(a - b).max() < 12  # Mercator metres; both realisations lie some metres apart
    lon, lat = crs.parse("EPSG:4326").inverse(*a)
    assert ((lon > 17) & (lon < 19) & (lat > 48) & (lat < 50)).all()
