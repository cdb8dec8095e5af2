"""The driver's queries over the tile engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import crs
from quadloom.functions import tiles as t
from quadloom.functions.resample import HALF_UP, taps
from quadloom.operators import keys, pixels, pyramid
from quadloom.plans import build, build_queries
from quadloom.plans import fixtures as fx
from quadloom.streaming import stats

QUERIES: dict = {}
SQL: dict[str, str] = {}
Z, TS, RZ, OFFSET = fx.ZOOM, fx.TILE, fx.RASTER_ZOOM, 3

# ---- inputs in SQL
COVER = f"cover AS (SELECT DISTINCT CAST({Z} AS INT) AS z, CAST(2200 + l_partkey % 200 AS INT) AS x, CAST(1400 + l_suppkey % 100 AS INT) AS y FROM lineitem)"
CLOSED = f"closed AS (SELECT DISTINCT CAST({Z} - k AS INT) AS z, CAST(x >> k AS INT) AS x, CAST(y >> k AS INT) AS y FROM (SELECT x, y, CAST(unnest(generate_series(0, {Z})) AS INT) AS k FROM cover))"
LIMITS = "limits AS (SELECT z, min(x) AS min_x, max(x) AS max_x, CAST(min((1 << z) - 1 - y) AS INT) AS min_y, CAST(max((1 << z) - 1 - y) AS INT) AS max_y FROM closed GROUP BY z)"
RASTER = f"""raw AS (SELECT CAST(vec_id AS INT) AS py, label, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS px FROM embeddings),
placed AS (SELECT px, py, label, CAST(floor((v + 1) * 127.5) AS INT) AS g, CAST(20 + px // {TS} AS INT) AS tx, CAST(10 + py // {TS} AS INT) AS ty FROM raw),
raster AS (SELECT px, py, g, CAST(CASE WHEN (tx + ty) % 5 = 0 THEN 0 WHEN (tx + ty) % 5 = 1 THEN 255 WHEN label < 3 THEN 128 WHEN label = 3 THEN 0 ELSE 255 END AS INT) AS a, tx, ty, px % {TS} AS ix, py % {TS} AS iy FROM placed)"""
TILES = "tiles AS (SELECT tx, ty, count(*) AS n_pixels, CAST(sum(CASE WHEN a > 0 THEN g ELSE 0 END) AS BIGINT) AS masked_sum, max(a) > 0 AS has_data, bool_and(a = 255) AS opaque FROM raster GROUP BY tx, ty)"
STATS = "stats AS (SELECT epoch_us(ts) // 60000 AS t, event_type AS metric, CAST(round(value * 1000) AS BIGINT) AS d FROM events)"
TAPS = "taps(o, w) AS (VALUES " + ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in taps()) + ")"
MORTON = " | ".join(f"(((CAST(x AS BIGINT) >> {i}) & 1) << {2 * i}) | (((CAST(y AS BIGINT) >> {i}) & 1) << {2 * i + 1})" for i in range(Z))
ROUND = lambda v: f"CAST(floor(greatest(0, least(255, {v})) + {HALF_UP}) AS INT)"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {COVER} SELECT * FROM cover")
def q01_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.coverage(spark, sf_dir)


@query(f"WITH {COVER}, {CLOSED} SELECT * FROM closed")
def q02_pyramid_closure(spark, sf_dir):
    return keys.closure(fx.coverage(spark, sf_dir), Z)


@query(f"WITH {COVER} SELECT z, x, y, {MORTON} AS m FROM cover")
def q03_zorder(spark, sf_dir):
    return keys.ordered(fx.coverage(spark, sf_dir))


@query(f"WITH {COVER}, {CLOSED}, {LIMITS} SELECT * FROM limits")
def q04_limits(spark, sf_dir):
    return keys.limits(keys.closure(fx.coverage(spark, sf_dir), Z))


@query(f"""WITH {COVER}, {CLOSED}, {LIMITS} SELECT 'limits' AS name, '{{' || string_agg('"' || z || '":{{"min_x":' || min_x || ',"max_x":' || max_x || ',"min_y":' || min_y || ',"max_y":' || max_y || '}}', ',' ORDER BY z) || '}}' AS value FROM limits""")
def q05_limits_json(spark, sf_dir):
    return keys.limits_json(keys.limits(keys.closure(fx.coverage(spark, sf_dir), Z)))


@query(f"WITH {COVER} SELECT CAST(z - {OFFSET} AS INT) AS az, CAST(x >> {OFFSET} AS INT) AS ax, CAST(y >> {OFFSET} AS INT) AS ay, count(*) AS n_tiles, min(x & 7) AS min_sx, max(x & 7) AS max_sx, min(y & 7) AS min_sy, max(y & 7) AS max_sy FROM cover GROUP BY ALL")
def q06_task_groups(spark, sf_dir):
    return keys.task_groups(fx.coverage(spark, sf_dir), OFFSET)


@query(f"""WITH {COVER}, keyed AS (SELECT x >> {OFFSET} AS ax, y >> {OFFSET} AS ay, {MORTON} AS m FROM cover),
marked AS (SELECT ax, ay, CASE WHEN lag(ax) OVER (ORDER BY m) IS NULL OR lag(ax) OVER (ORDER BY m) <> ax OR lag(ay) OVER (ORDER BY m) <> ay THEN 1 ELSE 0 END AS s FROM keyed)
SELECT CAST(ax AS INT) AS ax, CAST(ay AS INT) AS ay, CAST(sum(s) AS BIGINT) AS n_islands, count(*) AS n_tiles FROM marked GROUP BY ALL""")
def q07_task_islands(spark, sf_dir):
    return keys.task_islands(fx.coverage(spark, sf_dir), OFFSET)


@query(f"""WITH {COVER}, pending AS (SELECT * FROM cover WHERE (x + y) % 8 = 0), done AS (SELECT * FROM cover WHERE (x + y) % 8 <> 0)
SELECT DISTINCT CAST(x >> 1 AS INT) AS x, CAST(y >> 1 AS INT) AS y FROM done d WHERE NOT EXISTS (SELECT 1 FROM pending p WHERE p.x >> 1 = d.x >> 1 AND p.y >> 1 = d.y >> 1)""")
def q08_ready_parents(spark, sf_dir):
    cover = fx.coverage(spark, sf_dir)
    pending = (F.col("x") + F.col("y")) % 8 == 0
    return keys.ready_parents(cover.where(~pending), cover.where(pending))


@query(f"WITH {COVER} SELECT * FROM cover WHERE (x * 31 + y * 17) % 3 <> 0")
def q09_resume_todo(spark, sf_dir):
    cover = fx.coverage(spark, sf_dir)
    return keys.todo(cover, cover.where((F.col("x") * 31 + F.col("y") * 17) % 3 == 0))


@query(f"WITH {COVER} SELECT CAST(z + 1 AS INT) AS z, CAST(x * 2 + (i & 1) AS INT) AS x, CAST(y * 2 + (i >> 1) AS INT) AS y FROM cover, (SELECT CAST(unnest(generate_series(0, 3)) AS INT) AS i)")
def q10_children_explode(spark, sf_dir):
    return fx.coverage(spark, sf_dir).select(F.explode(t.children("z", "x", "y")).alias("c")).select("c.*")


_MX = "radians({lon}) * 6378137.0"
_MY = "ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137.0"
_SIDE10 = f"({2 * t.HALF!r} / 1024)"


@query(f"""SELECT c_custkey, CAST(greatest(0, least(1023, floor(({_MX.format(lon='(c_custkey % 360 - 180)')} + {t.HALF!r}) / {_SIDE10}))) AS INT) AS x,
CAST(greatest(0, least(1023, floor(({t.HALF!r} - {_MY.format(lat='(c_custkey % 170 - 85)')}) / {_SIDE10}))) AS INT) AS y FROM customer""")
def q11_mercator(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "customer")
    x, y = t.tile_of(*t.mercator(F.col("c_custkey") % 360 - 180, F.col("c_custkey") % 170 - 85), 10)
    return rows.select("c_custkey", x.alias("x"), y.alias("y"))


_RING = f"""box AS (SELECT min(c_custkey % 20 + 10) AS x0, max(c_custkey % 20 + 10) AS x1, min(c_custkey % 15 + 40) AS y0, max(c_custkey % 15 + 40) AS y1 FROM customer),
steps AS (SELECT *, unnest(generate_series(0, {crs.EDGE})) / {float(crs.EDGE)} AS f FROM box),
ring AS (SELECT x0 + f * (x1 - x0) AS lon, y0 AS lat FROM steps UNION ALL SELECT x0 + f * (x1 - x0), y1 FROM steps UNION ALL SELECT x0, y0 + f * (y1 - y0) FROM steps UNION ALL SELECT x1, y0 + f * (y1 - y0) FROM steps),
metres AS (SELECT {_MX.format(lon='lon')} AS mx, {_MY.format(lat='lat')} AS my FROM ring),
bounds AS (SELECT min(mx) AS min_x, min(my) AS min_y, max(mx) AS max_x, max(my) AS max_y FROM metres)"""


def _bounds(spark, sf_dir) -> tuple[float, float, float, float]:
    """Bounds in metres of the box of customers' stand-in coordinates: four numbers."""
    lon, lat = F.col("c_custkey") % 20 + 10, F.col("c_custkey") % 15 + 40
    box = fx.read(spark, sf_dir, "customer").agg(F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first()
    return crs.parse("EPSG:4326").bounds(*map(float, box))


@query(f"WITH {_RING} SELECT CAST(floor(min_x) AS BIGINT) AS min_x, CAST(floor(min_y) AS BIGINT) AS min_y, CAST(floor(max_x) AS BIGINT) AS max_x, CAST(floor(max_y) AS BIGINT) AS max_y FROM bounds")
def q12_bounds_densify(spark, sf_dir):
    return spark.createDataFrame([tuple(int(v // 1) for v in _bounds(spark, sf_dir))], "min_x long, min_y long, max_x long, max_y long")


_SIDE12 = f"({2 * t.HALF!r} / 4096)"


@query(f"""WITH {_RING}, ends AS (SELECT CAST(floor((min_x + {t.HALF!r}) / {_SIDE12}) AS INT) AS x0, CAST(floor((max_x + {t.HALF!r}) / {_SIDE12}) AS INT) AS x1, CAST(floor(({t.HALF!r} - max_y) / {_SIDE12}) AS INT) AS y0, CAST(floor(({t.HALF!r} - min_y) / {_SIDE12}) AS INT) AS y1 FROM bounds),
xs AS (SELECT unnest(generate_series(x0, x1)) AS x FROM ends), ys AS (SELECT unnest(generate_series(y0, y1)) AS y FROM ends)
SELECT CAST(12 AS INT) AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM xs, ys""")
def q13_bbox_cover(spark, sf_dir):
    return keys.bbox_tiles(spark, *_bounds(spark, sf_dir), 12)


_EDGES = [(*a, *b) for a, b in zip(fx.TRIANGLE, fx.TRIANGLE[1:] + fx.TRIANGLE[:1], strict=True)]
_CROSS = [f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)" for x in ("x", "(x + 1)") for y in ("y", "(y + 1)")]


@query(f"""WITH {COVER}, edges(x1, y1, x2, y2) AS (VALUES {', '.join('(' + ', '.join(f'CAST({v} AS DOUBLE)' for v in e) + ')' for e in _EDGES)}),
hits AS (SELECT z, x, y, bool_or(least(x1, x2) <= x + 1 AND greatest(x1, x2) >= x AND least(y1, y2) <= y + 1 AND greatest(y1, y2) >= y AND least({', '.join(_CROSS)}) <= 0 AND greatest({', '.join(_CROSS)}) >= 0) AS touches,
sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) AS crossings FROM cover, edges GROUP BY z, x, y)
SELECT z, x, y FROM hits WHERE touches OR crossings % 2 = 1""")
def q14_polygon_semi_join(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return keys.in_polygon(fx.coverage(spark, sf_dir), _EDGES, {"min_x": x, "min_y": y, "max_x": x + 1, "max_y": y + 1})


@query(f"WITH {RASTER} SELECT px, py, g, a FROM raster")
def q15_pixels(spark, sf_dir):
    return fx.raster(spark, sf_dir).select("px", "py", "g", "a")


@query(f"WITH {RASTER}, {TILES} SELECT tx, ty, n_pixels FROM tiles WHERE has_data")
def q16_base_tiles(spark, sf_dir):
    return pixels.base_tiles(fx.raster(spark, sf_dir)).where("has_data").select("tx", "ty", "n_pixels")


@query(f"WITH {RASTER}, {TILES} SELECT tx, ty, opaque FROM tiles WHERE has_data")
def q17_opaque_tiles(spark, sf_dir):
    return pixels.base_tiles(fx.raster(spark, sf_dir)).where("has_data").select("tx", "ty", "opaque")


@query(f"WITH {RASTER}, {TILES} SELECT tx, ty, masked_sum, CAST(px_in AS INT) AS sector_x FROM (SELECT *, tx & 7 AS px_in FROM tiles) WHERE has_data")
def q18_masked_sum(spark, sf_dir):
    return pixels.base_tiles(fx.raster(spark, sf_dir)).where("has_data").select("tx", "ty", "masked_sum", t.sector("tx", 3).alias("sector_x"))


@query(f"WITH {RASTER} SELECT py, string_agg(g || ',' || a, ';' ORDER BY px) AS row FROM raster GROUP BY py")
def q19_interleave(spark, sf_dir):
    return pixels.interleaved(fx.raster(spark, sf_dir))


@query(f"WITH {RASTER} SELECT px, py, CAST(CASE WHEN g = 128 THEN 0 ELSE g END AS INT) AS g, CAST(CASE WHEN g = 128 THEN 0 ELSE a END AS INT) AS a FROM raster")
def q20_nodata(spark, sf_dir):
    return pixels.without_nodata(fx.raster(spark, sf_dir), 128).select("px", "py", "g", "a")


@query(f"""WITH {RASTER}, {TAPS}, size AS (SELECT max(px) + 1 AS w, max(py) + 1 AS h FROM raster),
ys AS (SELECT CAST(unnest(generate_series(0, h // 2 - 1)) AS INT) AS oy FROM size), xs AS (SELECT CAST(unnest(generate_series(0, w // 2 - 1)) AS INT) AS ox FROM size),
down AS (SELECT px, oy, sum(g * w) / sum(w) AS g FROM ys, taps JOIN raster ON py = 2 * oy + 1 + o GROUP BY px, oy)
SELECT ox AS px, oy AS py, {ROUND('sum(g * w) / sum(w)')} AS g FROM xs, taps JOIN down ON px = 2 * ox + 1 + o GROUP BY ox, oy""")
def q21_lanczos_halve(spark, sf_dir):
    raster = fx.raster(spark, sf_dir)
    w, h = raster.agg(F.max("px") + 1, F.max("py") + 1).first()
    return pixels.halved(raster, w, h)


@query(f"""WITH {RASTER}, {TAPS}, have AS (SELECT tx >> 1 AS p, ty >> 1 AS q, (tx % 2) * {TS} + ix AS x, (ty % 2) * {TS} + iy AS y, CASE WHEN a > 0 THEN g ELSE 0 END AS g, a FROM raster),
span AS (SELECT CAST(unnest(generate_series(0, {2 * TS - 1})) AS INT) AS v), outs AS (SELECT CAST(unnest(generate_series(0, {TS - 1})) AS INT) AS v),
kept AS (SELECT DISTINCT p, q FROM have h WHERE EXISTS (SELECT 1 FROM have k WHERE k.p = h.p AND k.q = h.q AND k.a > 0)),
canvas AS (SELECT k.p, k.q, sx.v AS x, sy.v AS y, coalesce(h.g, 0) AS g, coalesce(h.a, 0) AS a FROM kept k CROSS JOIN span sx CROSS JOIN span sy LEFT JOIN have h ON h.p = k.p AND h.q = k.q AND h.x = sx.v AND h.y = sy.v),
down AS (SELECT p, q, x, v AS y, sum(g * w) / sum(w) AS g, sum(a * w) / sum(w) AS a FROM outs, taps JOIN canvas ON y = 2 * v + 1 + o GROUP BY p, q, x, v)
SELECT CAST(p AS INT) AS p, CAST(q AS INT) AS q, v AS x, y, {ROUND('sum(g * w) / sum(w)')} AS g, {ROUND('sum(a * w) / sum(w)')} AS a FROM outs, taps JOIN down ON x = 2 * v + 1 + o GROUP BY p, q, v, y""")
def q22_lanczos_tile_local(spark, sf_dir):
    raster = pixels.masked(fx.raster(spark, sf_dir))
    data = pixels.base_tiles(raster).where("has_data").select("tx", "ty")
    return pixels.parents(raster.join(data, ["tx", "ty"], "left_semi"), TS)


@query(SQL["q22_lanczos_tile_local"])
def q22b_lanczos_buffers(spark, sf_dir):
    """The same parents by the build's own path: byte buffers, reduced in numpy."""
    raster = pixels.masked(fx.raster(spark, sf_dir))
    return pyramid.to_pixels_table(pyramid.subtree(pyramid.from_pixels(raster, RZ, TS), TS, 2, 1), TS)


@query(f"WITH {RASTER}, {TILES}, closed AS (SELECT DISTINCT CAST({RZ} - k AS INT) AS z, CAST(tx >> k AS INT) AS x, CAST(ty >> k AS INT) AS y FROM (SELECT tx, ty, CAST(unnest(generate_series(0, {RZ})) AS INT) AS k FROM tiles WHERE has_data)) SELECT * FROM closed")
def q24b_pyramid_levels(spark, sf_dir):
    """Keys of all buffers of a pyramid over the raster's tiles with data, climbed several zooms a shuffle."""
    base = pyramid.from_pixels(pixels.masked(fx.raster(spark, sf_dir)), RZ, TS)
    low = pyramid.subtree(base, TS, 2, 4)
    top = pyramid.subtree(low.where(F.col("z") == RZ - 4), TS, 2, RZ - 4)
    return base.unionByName(low).unionByName(top).select("z", "x", "y")


_METRES = lambda v: f"CAST(floor({v}) AS BIGINT)"


@query(f"""WITH {COVER}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cover)
SELECT 'name' AS name, 'Tiles' AS value UNION ALL SELECT 'format', 'jpeg' UNION ALL SELECT 'minzoom', '0' UNION ALL SELECT 'maxzoom', '{Z}' UNION ALL
SELECT 'bounds', concat_ws(',', {_METRES(f'x0 * {_SIDE12} - {t.HALF!r}')}, {_METRES(f'{t.HALF!r} - (y1 + 1) * {_SIDE12}')}, {_METRES(f'(x1 + 1) * {_SIDE12} - {t.HALF!r}')}, {_METRES(f'{t.HALF!r} - y0 * {_SIDE12}')}) FROM b""")
def q23_metadata_rows(spark, sf_dir):
    b = t.bounds("z", "x", "y")
    whole = fx.coverage(spark, sf_dir).agg(*(F.floor((F.min if k.startswith("min") else F.max)(v)) for k, v in b.items())).first()
    return spark.createDataFrame(build.metadata_rows(build.TilerOptions("", "", Z), tuple(whole)), "name string, value string")


@query(f"""WITH {RASTER}, {TILES} SELECT CAST({RZ} AS INT) AS zoom_level, tx AS tile_column, CAST((1 << {RZ}) - 1 - ty AS INT) AS tile_row,
CASE WHEN has_data THEN (SELECT string_agg(CASE WHEN a > 0 THEN g ELSE 0 END || ',' || a, ';' ORDER BY iy, ix) FROM raster r WHERE r.tx = tiles.tx AND r.ty = tiles.ty) ELSE '' END AS tile_data FROM tiles""")
def q24_tiles_table(spark, sf_dir):
    rows = pixels.masked(fx.raster(spark, sf_dir))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("iy", "ix", "g", "a"))), lambda p: F.concat_ws(",", p["g"], p["a"])), ";")
    tiles = rows.groupBy("tx", "ty").agg(F.when(F.max("a") > 0, body).otherwise("").alias("tile_data"))
    return tiles.select(F.lit(RZ).alias("zoom_level"), F.col("tx").alias("tile_column"), t.reversed_y(F.lit(RZ), "ty").alias("tile_row"), "tile_data")


_IN = " + ".join(f"CASE WHEN ({y1!r} > py + 0.5) <> ({y2!r} > py + 0.5) AND px + 0.5 < ({x2!r} - {x1!r}) * (py + 0.5 - {y1!r}) / ({y2!r} - {y1!r}) + {x1!r} THEN 1 ELSE 0 END" for x1, y1, x2, y2 in fx.MASK_EDGES)


@query(f"WITH {RASTER} SELECT px, py, g, CAST(CASE WHEN ({_IN}) % 2 = 1 THEN 255 ELSE 0 END AS INT) AS a FROM raster")
def q31_polygon_mask(spark, sf_dir):
    """A polygon burnt into the raster as its alpha band."""
    return pixels.with_alpha(fx.raster(spark, sf_dir).drop("a"), fx.MASK_EDGES).select("px", "py", "g", "a")


@query(f"WITH {STATS} SELECT metric, CAST(sum(d) AS BIGINT) AS total, count(*) AS n, CAST(sum(d) AS BIGINT) || '/' || count(*) || '=' || CAST(sum(d) // count(*) AS BIGINT) AS label FROM stats GROUP BY metric")
def q25_stats_by_metric(spark, sf_dir):
    return stats.by_metric(fx.statistics(spark, sf_dir))


@query(f"""WITH RECURSIVE {STATS}, w(opened) AS (SELECT min(t) FROM stats UNION ALL SELECT (SELECT min(t) FROM stats WHERE t >= w.opened + {stats.PERIOD_MS}) FROM w WHERE w.opened IS NOT NULL),
wins AS (SELECT opened, lead(opened) OVER (ORDER BY opened) AS closed FROM w WHERE opened IS NOT NULL)
SELECT opened, closed, count(*) AS n, CAST(sum(d) AS BIGINT) AS total FROM wins JOIN stats ON t >= opened AND t < closed WHERE closed IS NOT NULL GROUP BY opened, closed""")
def q26_throttle_windows(spark, sf_dir):
    return stats.throttled(fx.statistics(spark, sf_dir))


@query(f"WITH {COVER} SELECT x, y, CAST(floor((row_number() OVER (ORDER BY {MORTON}) - 1) * 100000 / count(*) OVER ()) AS BIGINT) AS pct_thousandths FROM cover")
def q27_progress(spark, sf_dir):
    rows = keys.z_order_position(fx.coverage(spark, sf_dir))
    return rows.select("x", "y", F.floor((F.col("n") - 1) * 100000 / F.col("total")).alias("pct_thousandths"))


@query(f"WITH {STATS} SELECT CAST(sum(d) FILTER (WHERE metric <> 'view') AS BIGINT) AS total FROM stats")
def q28_total_without_metric(spark, sf_dir):
    return stats.total_without(fx.statistics(spark, sf_dir), "view")


@query(f"WITH {COVER}, {CLOSED} SELECT count(*) AS total_work FROM closed")
def q29_total_work(spark, sf_dir):
    return keys.closure(fx.coverage(spark, sf_dir), Z).agg(F.count("*").alias("total_work"))


@query(f"WITH {STATS} SELECT metric, arg_max(d, t * 1000000 + d) AS last_d FROM stats GROUP BY metric")
def q30_last_gauge(spark, sf_dir):
    rows = fx.statistics(spark, sf_dir)
    return stats.gauges(rows, {"last_d": "d"}, F.col("t") * 1000000 + F.col("d"), "metric")


_MEETS = f"bool_or(least(x1, x2) <= x + 1 AND greatest(x1, x2) >= x AND least(y1, y2) <= y + 1 AND greatest(y1, y2) >= y AND least({', '.join(_CROSS)}) <= 0 AND greatest({', '.join(_CROSS)}) >= 0)"
_DESCENT = f"""WITH edges(x1, y1, x2, y2) AS (VALUES {', '.join('(' + ', '.join(f'CAST({v} AS DOUBLE)' for v in e) + ')' for e in _EDGES)}),
box AS (SELECT CAST({Z} AS INT) AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT unnest(generate_series(2200, 2399)) AS x), (SELECT unnest(generate_series(1400, 1499)) AS y)),
hits AS (SELECT z, x, y, {_MEETS} AS touches, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) AS crossings FROM box, edges GROUP BY z, x, y)
SELECT z, x, y FROM hits WHERE touches OR crossings % 2 = 1"""
build_queries.register(query, RASTER, SQL["q22_lanczos_tile_local"], STATS, COVER, _DESCENT)
