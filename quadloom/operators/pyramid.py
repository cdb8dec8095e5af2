"""Pixels of a build: warping megatiles, composing parents, and encoding tiles. Buffers are bytes, bands interleaved by pixel."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import codec, resample
from quadloom.functions.crs import Transform
from quadloom.functions.tiles import HALF
from quadloom.operators.lineage import small_batches
from quadloom.sources.raster import RasterMeta

TILE_SCHEMA = "z int, x int, y int, buf binary"
#: Zooms between tiles and the ancestor whose tiles are reduced by one call at least: at most 4^GROUP tiles.
GROUP = 4
#: Source pixels around a megatile's outline that the kernel may need.
HALO = 4
#: Source pixels a side that a megatile takes at most, but for the halo (four bands: 256 MB).
MEGA_SOURCE = 1 << 13
#: Bytes of decoded tiles, and pixels as rows, that a worker holds before it passes them on, about.
HELD, PIXELS = 1 << 22, 1 << 16


def _outline(meta: RasterMeta, transform: Transform, z: int, x: int, y: int, n: int = 22):
    """Source columns and rows of a grid of points over tile z, x, y, and source pixels a target step at `n` steps a side."""
    side = 2 * HALF / (1 << z)
    u = np.arange(n + 1) / n
    mx, my = np.meshgrid(x * side - HALF + u * side, HALF - y * side - u * side)
    return to_pixels(meta, transform, mx, my)


def to_pixels(meta: RasterMeta, transform: Transform, mx, my):
    g = meta.geo_transform
    sx, sy = transform.inverse(mx, my)
    det = g[1] * g[5] - g[2] * g[4]
    dx, dy = sx - g[0], sy - g[3]
    return (g[5] * dx - g[2] * dy) / det, (g[1] * dy - g[4] * dx) / det


def base_tiles(cover: DataFrame, blocks: DataFrame, meta: RasterMeta, transform: Transform, tile_size: int, offset: int, block: int, use_nodata: bool = False) -> DataFrame:
    """z, x, y, buf of the base tiles in `cover` that hold any pixel with alpha over 0.

    Tiles that share an ancestor `offset` levels up are warped together. Each such megatile asks for the blocks under it, plus the
    kernel's reach, by their keys; an equi-join brings them, and one task samples, masks and slices them. Sources without alpha
    get an opaque one inside their extent. use_nodata: source pixels with a no-data value in any band become transparent.

    A source that is much finer than the tiles is first warped to a deeper zoom, from which tiles are reduced: a megatile's pixels
    are MEGA_SOURCE a side at most, whatever the scales.
    """
    step = source_step(meta, transform, tile_size, cover)
    deeper = max(0, math.floor(math.log2(step)) - 1) if step else 0
    if deeper:
        at = cover.select((F.col("z") + deeper).alias("z"), F.explode(F.sequence(F.lit(0), F.lit((1 << deeper) - 1))).alias("i"), "x", "y")
        at = at.select("z", (F.col("x") * (1 << deeper) + F.col("i")).alias("x"), "y", F.explode(F.sequence(F.lit(0), F.lit((1 << deeper) - 1))).alias("j"))
        at = at.select("z", "x", (F.col("y") * (1 << deeper) + F.col("j")).alias("y"))
        fine = _warped(at, blocks, meta, transform, tile_size, min(offset, deeper), block, use_nodata)
        reduced = subtree(fine, tile_size, (len(meta.bands) + 1) // 2 * 2, deeper)
        return reduced.join(cover.select("z", "x", "y"), ["z", "x", "y"], "left_semi").select("z", "x", "y", "buf")
    while offset and (tile_size << offset) * step > MEGA_SOURCE:
        offset -= 1
    return _warped(cover, blocks, meta, transform, tile_size, offset, block, use_nodata)


def source_step(meta: RasterMeta, transform: Transform, tile_size: int, cover: DataFrame) -> float:
    """Source pixels a target pixel in the middle of the cover; 0 where there is none."""
    one = cover.agg(F.first("z").alias("z"), F.floor(F.avg("x")).cast("long").alias("x"), F.floor(F.avg("y")).cast("long").alias("y")).first()
    if one.z is None:
        return 0.0
    c, r = _outline(meta, transform, one.z, one.x, one.y, 2)
    step = max(float(np.nanmax(np.abs(np.diff(c, axis=1)))), float(np.nanmax(np.abs(np.diff(r, axis=0))))) * 2 / tile_size
    return step if math.isfinite(step) else 0.0


def _warped(cover: DataFrame, blocks: DataFrame, meta: RasterMeta, transform: Transform, tile_size: int, offset: int, block: int, use_nodata: bool) -> DataFrame:
    """base_tiles() of one zoom, sampled from the source's own pixels."""
    bands = len(meta.bands)
    has_alpha = meta.bands[-1] == "alpha"
    size = tile_size << offset

    def ask(batches):
        for pdf in batches:
            rows = []
            for az, ax, ay, tiles in zip(pdf["az"], pdf["ax"], pdf["ay"], pdf["tiles"], strict=True):
                c, r = _outline(meta, transform, az, ax, ay)
                ok = np.isfinite(c) & np.isfinite(r)
                if not ok.any():
                    continue
                halo = HALO * max(1.0, (np.nanmax(c[ok]) - np.nanmin(c[ok])) / size, (np.nanmax(r[ok]) - np.nanmin(r[ok])) / size) + 1
                c0, c1 = max(0, int(c[ok].min() - halo)), min(meta.width - 1, int(c[ok].max() + halo))
                r0, r1 = max(0, int(r[ok].min() - halo)), min(meta.height - 1, int(r[ok].max() + halo))
                for by in range(r0 // block, r1 // block + 1) if r1 >= r0 and c1 >= c0 else ():
                    for bx in range(c0 // block, c1 // block + 1):
                        rows.append((az, ax, ay, tiles, bx, by))
            yield type(pdf)(rows, columns=["az", "ax", "ay", "tiles", "block_x", "block_y"])

    def warp(key, pdf):
        az, ax, ay = (int(k) for k in key)
        bx0, by0 = int(pdf["block_x"].min()), int(pdf["block_y"].min())
        w, h = (int(pdf["block_x"].max()) - bx0 + 1) * block, (int(pdf["block_y"].max()) - by0 + 1) * block
        src = np.zeros((min(h, meta.height - by0 * block), min(w, meta.width - bx0 * block), bands + (not has_alpha)), np.uint8)
        pdf = pdf.sort_values("ordinal", kind="stable")  # later files lie over earlier ones
        for bx, by, ox, oy, bw, bh, buf in zip(pdf["block_x"], pdf["block_y"], pdf["px"], pdf["py"], pdf["w"], pdf["h"], pdf["buf"], strict=True):
            y0, x0 = (by - by0) * block + oy, (bx - bx0) * block + ox
            src[y0 : y0 + bh, x0 : x0 + bw, :bands] = np.frombuffer(buf, np.uint8).reshape(bh, bw, bands)
            if not has_alpha:
                src[y0 : y0 + bh, x0 : x0 + bw, -1] = 255
        if use_nodata and any(v is not None for v in meta.nodata):
            hit = np.zeros(src.shape[:2], bool)
            for b, v in enumerate(meta.nodata[: src.shape[2] - 1]):
                if v is not None:
                    hit |= src[:, :, b] == int(max(0, min(255, v)))
            src[hit] = 0
        side = 2 * HALF / (1 << az)
        u = (np.arange(size) + 0.5) / size
        out_rows = []
        wanted = {(int(t["x"]), int(t["y"])) for t in pdf["tiles"].iloc[0]}
        for ty in range(1 << offset):
            for tx in range(1 << offset):
                x, y = (ax << offset) + tx, (ay << offset) + ty
                if (x, y) not in wanted:
                    continue
                mx, my = np.meshgrid(ax * side - HALF + u[tx * tile_size : (tx + 1) * tile_size] * side, HALF - ay * side - u[ty * tile_size : (ty + 1) * tile_size] * side)
                c, r = to_pixels(meta, transform, mx, my)
                step = max(float(np.nanmedian(np.abs(np.diff(c, axis=1)))) if tile_size > 1 else 1.0, float(np.nanmedian(np.abs(np.diff(r, axis=0)))) if tile_size > 1 else 1.0)
                finite = np.isfinite(c) & np.isfinite(r)
                px, inside = resample.sample(src, np.where(finite, c, -1) - bx0 * block, np.where(finite, r, -1) - by0 * block, step)
                px[~inside | (px[:, :, -1] == 0)] = 0
                if px[:, :, -1].any():
                    out_rows.append((az + offset, x, y, px.tobytes()))
        return type(pdf)(out_rows, columns=["z", "x", "y", "buf"])

    keyed = cover.select((F.col("z") - offset).alias("az"), F.shiftright("x", offset).alias("ax"), F.shiftright("y", offset).alias("ay"), F.struct("x", "y").alias("t"))
    megas = keyed.groupBy("az", "ax", "ay").agg(F.collect_list("t").alias("tiles"))  # at most 4^offset
    asked = megas.mapInPandas(ask, "az int, ax int, ay int, tiles array<struct<x:int,y:int>>, block_x int, block_y int")
    joined = asked.join(blocks.select("ordinal", "block_x", "block_y", "px", "py", "w", "h", "buf"), ["block_x", "block_y"])
    return joined.groupBy("az", "ax", "ay").applyInPandas(warp, TILE_SCHEMA)


def compose(children: dict[tuple[int, int], np.ndarray], tile_size: int, bands: int) -> np.ndarray:
    """A parent from its children by sector; missing ones are transparent black and take part in the reduction."""
    canvas = np.zeros((2 * tile_size, 2 * tile_size, bands), np.uint8)
    for (sx, sy), px in children.items():
        canvas[sy * tile_size : (sy + 1) * tile_size, sx * tile_size : (sx + 1) * tile_size] = px
    return resample.halve(canvas)


def subtree(tiles: DataFrame, tile_size: int, bands: int, levels: int) -> DataFrame:
    """All tiles of the next `levels` zooms above `tiles` (all of one zoom): one shuffle by the common ancestor, then each subtree is
    reduced depth first in its task, which holds at most four buffers a level besides its input. Few levels are reduced for many
    neighbours at a time, as a call costs more than a small tile."""

    def reduce(pdf):
        now = {(int(x), int(y)): np.frombuffer(b, np.uint8).reshape(tile_size, tile_size, bands) for x, y, b in zip(pdf["x"], pdf["y"], pdf["buf"], strict=True)}
        z, rows = int(pdf["z"].iloc[0]), []
        for _ in range(levels):
            z, groups = z - 1, {}
            for (x, y), px in now.items():
                groups.setdefault((x >> 1, y >> 1), {})[(x & 1, y & 1)] = px
            now = {k: compose(v, tile_size, bands) for k, v in groups.items()}
            rows += [(z, x, y, px.tobytes()) for (x, y), px in now.items()]
        return type(pdf)(rows, columns=["z", "x", "y", "buf"])

    shift = max(levels, GROUP)
    return tiles.groupBy(F.shiftright("x", shift).alias("gx"), F.shiftright("y", shift).alias("gy")).applyInPandas(reduce, TILE_SCHEMA)


def encode(tiles: DataFrame, tile_size: int, bands: int, kind: str, quality: int) -> DataFrame:
    """zoom_level, tile_column, tile_row (TMS), tile_data, tile_alpha of tiles (z, x, y, buf). JPEG keeps alpha apart as zstd (empty if
    opaque), PNG keeps it in place and has an empty tile_alpha. A null buf gives the marker of an empty tile: no bytes at all."""

    def run(batches):
        for pdf in batches:
            data, alphas = [], []
            for buf in pdf["buf"]:
                if buf is None:
                    data.append(b"")
                    alphas.append(b"")
                    continue
                px = np.frombuffer(buf, np.uint8).reshape(tile_size, tile_size, bands)
                if kind == "jpeg":
                    colour, alpha = codec.split_alpha(px)
                    data.append(codec.encode_jpeg(colour, quality))
                    alphas.append(codec.compress_alpha(alpha))
                else:
                    data.append(codec.encode_png(px))
                    alphas.append(b"")
            yield type(pdf)({"zoom_level": pdf["z"], "tile_column": pdf["x"], "tile_row": np.left_shift(1, pdf["z"].to_numpy()) - 1 - pdf["y"], "tile_data": data, "tile_alpha": alphas})

    return small_batches(tiles).mapInPandas(run, "zoom_level int, tile_column int, tile_row int, tile_data binary, tile_alpha binary")


def decode(stored: DataFrame, tile_size: int, bands: int) -> DataFrame:
    """z, x, y, buf of stored tiles in either format; empty markers are left out."""

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf["tile_data"].map(len) > 0]
            pdf = pdf.assign(y=np.left_shift(1, pdf["zoom_level"].to_numpy()) - 1 - pdf["tile_row"])
            rows = []
            for z, x, y, data, alpha in zip(*(pdf[c] for c in ("zoom_level", "tile_column", "y", "tile_data", "tile_alpha")), strict=True):
                data = bytes(data)
                if data[:2] == b"\xff\xd8":
                    px = codec.join_alpha(codec.decode_jpeg(data), codec.decompress_alpha(bytes(alpha or b""), tile_size, tile_size))
                else:
                    px = codec.decode_png(data)
                rows.append((z, x, y, px.tobytes()))
                if len(rows) * px.size > HELD:
                    yield type(pdf)(rows, columns=["z", "x", "y", "buf"])
                    rows = []
            yield type(pdf)(rows, columns=["z", "x", "y", "buf"])

    return small_batches(stored).select("zoom_level", "tile_column", "tile_row", "tile_data", "tile_alpha").mapInPandas(run, TILE_SCHEMA)


def from_pixels(pixels: DataFrame, z: int, tile_size: int) -> DataFrame:
    """z, x, y, buf of the tiles with data of a relational gray+alpha raster (tx, ty, ix, iy, g, a)."""

    def pack(batches):
        for pdf in batches:
            bufs = []
            for ix, iy, g, a in zip(pdf["ix"], pdf["iy"], pdf["g"], pdf["a"], strict=True):
                px = np.zeros((tile_size, tile_size, 2), np.uint8)
                px[iy, ix, 0], px[iy, ix, 1] = g, a
                bufs.append(px.tobytes())
            yield type(pdf)({"z": z, "x": pdf["tx"], "y": pdf["ty"], "buf": bufs})

    tiles = pixels.groupBy("tx", "ty").agg(F.collect_list(F.struct("ix", "iy", "g", "a")).alias("cells"), F.max("a").alias("most")).where("most > 0")  # tile_size^2 cells
    # arrays of numbers: structs would become a dict a pixel in Python
    return small_batches(tiles).select("tx", "ty", *(F.col(f"cells.{c}").alias(c) for c in ("ix", "iy", "g", "a"))).mapInPandas(pack, TILE_SCHEMA)


def to_pixels_table(tiles: DataFrame, tile_size: int) -> DataFrame:
    """p, q (tile), x, y, g, a of gray+alpha buffers, one row a pixel."""

    def unpack(batches):
        y, x = (v.ravel() for v in np.mgrid[:tile_size, :tile_size])
        for pdf in batches:
            for start in range(0, len(pdf), step):
                some = pdf.iloc[start : start + step]
                px = np.frombuffer(b"".join(some["buf"]), np.uint8).reshape(-1, 2)
                n = len(some)
                yield type(pdf)({"p": np.repeat(some["x"].to_numpy(), x.size), "q": np.repeat(some["y"].to_numpy(), x.size), "x": np.tile(x, n), "y": np.tile(y, n), "g": px[:, 0], "a": px[:, 1]})

    step = max(1, PIXELS // tile_size**2)
    return small_batches(tiles).mapInPandas(unpack, "p int, q int, x int, y int, g int, a int")
