"""Rasters as block tables. A raster is one file or many on one grid of pixels, in any file system that Spark reads.

PNG and PNM (P5, P6) files are decoded whole, one task a file, so large rasters of these formats are given as many files. RAW files
(8 bit, bands interleaved by pixel, no header) may be of any size: large ones are read by ranges of pixel rows. Each file has a JSON
sidecar <file>.json that names the geotransform, the coordinate system and, if need be, band meanings and no-data values; with width and
height in it (RAW files need them), no pixel is read for metadata. Where files overlap, the last by path wins.
"""

import json
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.codec import decode_png
from quadloom.operators.lineage import small_batches

BLOCK = 256
DECODED, RAW = "png,pgm,ppm,pnm", "raw"
FILES = f"{DECODED},{RAW}"
#: Bytes of a RAW file that is read whole, at most: all of these are one scan, while each larger one is a reader of its own in the plan.
WHOLE = 1 << 24
#: Bytes of pieces that are held before they are passed on, about.
HELD = 1 << 22
#: Bytes of a RAW file that a task reads, about.
SPLIT = 1 << 27
LAYOUTS = (("gray",), ("gray", "alpha"), ("red", "green", "blue"), ("red", "green", "blue", "alpha"))
#: Pieces of blocks: px, py is the piece's place inside its block, ordinal the file's place by path.
BLOCK_SCHEMA = "path string, ordinal int, block_x int, block_y int, px int, py int, w int, h int, bands int, buf binary"


@dataclass(frozen=True)
class RasterMeta:
    """What is known of a raster without its pixels."""

    path: str
    width: int
    height: int
    bands: tuple[str, ...]
    geo_transform: tuple[float, ...]
    srs: str | None = None
    nodata: tuple[int | None, ...] = field(default=())

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        """min_x, min_y, max_x, max_y; rotation terms are ignored."""
        g = self.geo_transform
        return g[0], self.height * g[5] + g[3], self.width * g[1] + g[0], g[3]


def check_layout(bands: tuple[str, ...]) -> None:
    if tuple(bands) not in LAYOUTS:
        raise ValueError(f"bands {', '.join(bands)}: only gray, gray+alpha, RGB and RGBA in that order are supported")


def resolve_srs(given: str | None, meta: RasterMeta) -> str:
    """The given coordinate system, else the raster's own."""
    if given is None and meta.srs is None:
        raise ValueError("the raster names no coordinate system: give source_srs or transform_pipeline")
    return given or meta.srs


def decode_file(data: bytes) -> np.ndarray:
    """(h, w, bands) of a PNG or binary PNM."""
    if data[:2] in (b"P5", b"P6"):
        m = re.match(rb"P([56])(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+(\d+)(?:\s+#[^\n]*)*\s+255\s", data)
        if not m:
            raise ValueError("only binary PNM with 255 levels is read")
        w, h, bands = int(m[2]), int(m[3]), 1 if m[1] == b"5" else 3
        return np.frombuffer(data, np.uint8, h * w * bands, m.end()).reshape(h, w, bands)
    return decode_png(data)


def _size(data: bytes) -> tuple[int, int, int]:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big"), {0: 1, 4: 2, 2: 3, 6: 4}.get(data[25], 0)
    a = decode_file(data)
    return a.shape[1], a.shape[0], a.shape[2]


def _listed(spark: SparkSession, path: str, kind: str, suffix: str = "", files: str = FILES):
    """A reader's files at `path` (a file, folder or pattern) whose names end as `files` do, plus `suffix`."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = fs.exists(p) and fs.getFileStatus(p).isDirectory()
    reader = spark.read.format(kind).option("pathGlobFilter", f"*.{{{files}}}{suffix}").option("wholetext", "true")
    return reader.load(path if folder else path + suffix)


def read_meta(spark: SparkSession, path: str) -> list[RasterMeta]:
    """Metadata of the rasters at `path` (a file, folder or pattern), one entry a file, by path. One job reads all sidecars; files whose
    sidecar has no width and height are opened for them."""
    sides = {r.p.removesuffix(".json"): json.loads(r.value) for r in _listed(spark, path, "text", ".json").select(F.col("_metadata.file_path").alias("p"), "value").collect()}  # one row a file
    names = sorted(r.path for r in _listed(spark, path, "binaryFile").select("path").collect())
    clean = lambda p: re.sub(r"^file:/+", "file:/", p)
    sides = {clean(p): v for p, v in sides.items()}
    bare = [p for p in names if not {"width", "height"} <= sides.get(clean(p), {}).keys()]
    # where all PNG and PNM files are opened, the folder is listed once; a reader of single paths lists each by a task of its own
    alike = bare == [p for p in names if not p.endswith(f".{RAW}")]
    opened = (_listed(spark, path, "binaryFile", files=DECODED) if alike else spark.read.format("binaryFile").load(bare)) if bare else None
    sizes = {clean(r.path): (r.w, r.h, r.n) for r in small_batches(opened).select("path", "content").mapInPandas(_sizes, "path string, w int, h int, n int").collect()} if bare else {}
    out = []
    for p in names:
        side = sides.get(clean(p))
        if side is None:
            raise ValueError(f"{p}: no {p}.json beside it")
        w, h, n = sizes.get(clean(p)) or (side["width"], side["height"], len(side["bands"]) if "bands" in side else side.get("band_count", 1))
        bands = tuple(side.get("bands", {k + 1: x for k, x in enumerate(LAYOUTS)}[n]))
        check_layout(bands)
        if len(bands) != n:
            raise ValueError(f"{p}: {n} bands, but {len(bands)} are named")
        out.append(RasterMeta(p, w, h, bands, tuple(map(float, side["geo_transform"])), side.get("srs"), tuple(side.get("nodata", [None] * n))))
    return out


def _sizes(batches):
    for pdf in batches:
        rows = [(p, *_size(bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
        yield type(pdf)(rows, columns=["path", "w", "h", "n"])


def together(metas: list[RasterMeta]) -> tuple[RasterMeta, dict[str, tuple[int, int, int]]]:
    """The raster that files on one grid of pixels make, and for each path its ordinal, column and row there.

    Files must agree on bands, coordinate system, no-data values and pixel size, and lie whole pixels apart (a 100th of one is allowed).
    """
    if not metas:
        raise ValueError("no raster found")
    first = metas[0]
    g = first.geo_transform
    places = []
    for m in metas:
        if (m.bands, m.srs, m.nodata) != (first.bands, first.srs, first.nodata):
            raise ValueError(f"{m.path}: bands, coordinate system or no-data values differ from those of {first.path}")
        o = m.geo_transform
        if any(abs(o[i] - g[i]) * max(m.width, m.height) > 0.01 * max(abs(g[1]), abs(g[5])) for i in (1, 2, 4, 5)):
            raise ValueError(f"{m.path}: pixels differ in size from those of {first.path}")
        det = g[1] * g[5] - g[2] * g[4]
        dx, dy = o[0] - g[0], o[3] - g[3]
        col, row = (g[5] * dx - g[2] * dy) / det, (g[1] * dy - g[4] * dx) / det
        if max(abs(col - round(col)), abs(row - round(row))) > 0.01:
            raise ValueError(f"{m.path}: not on the pixel grid of {first.path}")
        places.append((round(col), round(row)))
    c0, r0 = min(c for c, _ in places), min(r for _, r in places)
    width = max(c + m.width for (c, _), m in zip(places, metas, strict=True)) - c0
    height = max(r + m.height for (_, r), m in zip(places, metas, strict=True)) - r0
    origin = (g[0] + c0 * g[1] + r0 * g[2], g[1], g[2], g[3] + c0 * g[4] + r0 * g[5], g[4], g[5])
    whole = RasterMeta(first.path, width, height, first.bands, origin, first.srs, first.nodata)
    return whole, {m.path: (i, c - c0, r - r0) for i, (m, (c, r)) in enumerate(zip(metas, places, strict=True))}


def _pieces(path: str, place: tuple[int, int, int], a: np.ndarray, top: int, block: int):
    """Rows of BLOCK_SCHEMA: an array that lies `top` rows below its file's first one, cut along the blocks of the whole raster."""
    ordinal, col, row = place
    y = row + top
    end, right = y + a.shape[0], col + a.shape[1]
    while y < end:
        y1, x = min(end, (y // block + 1) * block), col
        while x < right:
            x1 = min(right, (x // block + 1) * block)
            part = a[y - row - top : y1 - row - top, x - col : x1 - col]
            yield (path, ordinal, x // block, y // block, x % block, y % block, x1 - x, y1 - y, a.shape[2], part.tobytes())
            x = x1
        y = y1


def _raw_rows(spark: SparkSession, meta: RasterMeta, place: tuple[int, int, int], block: int):
    """Pieces of a RAW file. A split is a run of pixel rows, of which `block` at a time are held."""
    n, bands, width, height = meta.width * len(meta.bands), len(meta.bands), meta.width, meta.height
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(n), "mapreduce.input.fileinputformat.split.maxsize": str(max(SPLIT, n))}
    rows = spark.sparkContext.newAPIHadoopFile(meta.path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)

    def cut(records):
        held, first = [], None
        for i, row in records:
            if i >= height:
                continue
            if held and (first + len(held) != i or (place[2] + i) % block == 0):
                yield from _pieces(meta.path, place, np.stack(held), first, block)
                held = []
            if not held:
                first = i
            held.append(np.frombuffer(bytes(row), np.uint8).reshape(width, bands))
        if held:
            yield from _pieces(meta.path, place, np.stack(held), first, block)

    return rows.mapPartitions(cut)


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK, metas: list[RasterMeta] | None = None) -> DataFrame:
    """Pixels of the raster at `path` as pieces of blocks (BLOCK_SCHEMA), bands interleaved by pixel. One file gives one piece a block;
    where several share a block, each gives its own, and RAW files may give several. Files read whole are one scan, however many."""
    metas = read_meta(spark, path) if metas is None else metas
    places = together(metas)[1]
    clean = lambda p: re.sub(r"^file:/+", "file:/", p)
    by_path = {clean(p): (p, v) for p, v in places.items()}

    shapes = {clean(m.path): (m.height, m.width, len(m.bands)) for m in metas if m.path.endswith(f".{RAW}")}

    def pixels_of(p, content):
        if p not in shapes:
            return decode_file(content)
        height, width, bands = shapes[p]
        whole_rows, rest = divmod(len(content), width * bands)
        if rest and whole_rows < height:
            raise ValueError(f"{p}: ends inside a row of pixels")
        return np.frombuffer(content, np.uint8, min(height, whole_rows) * width * bands).reshape(-1, width, bands)

    def cut(batches):
        columns = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
        for pdf in batches:
            rows, n = [], 0
            for p, content in zip(map(clean, pdf["path"]), pdf["content"], strict=True):
                if p not in by_path:
                    continue
                name, place = by_path[p]
                a = pixels_of(p, bytes(content))
                for top in range(0, a.shape[0], block):
                    part = a[top : top + block]
                    rows += _pieces(name, place, part, top, block)
                    n += part.size
                    if n > HELD:
                        yield type(pdf)(rows, columns=columns)
                        rows, n = [], 0
            yield type(pdf)(rows, columns=columns)

    scan = lambda files: small_batches(_listed(spark, path, "binaryFile", files=files))
    parts = [scan(DECODED).select("path", "content").mapInPandas(cut, BLOCK_SCHEMA)] if len(shapes) < len(metas) else []
    if shapes:
        large = {clean(r.path) for r in scan(RAW).where(F.col("length") > WHOLE).select("path").collect()}  # lengths only
        if shapes.keys() - large:
            parts.append(scan(RAW).where(F.col("length") <= WHOLE).select("path", "content").mapInPandas(cut, BLOCK_SCHEMA))
        raw = [_raw_rows(spark, m, places[m.path], block) for m in metas if clean(m.path) in shapes.keys() & large]
        if raw:
            parts.append(spark.createDataFrame(spark.sparkContext.union(raw), BLOCK_SCHEMA))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tile_index(meta: list[RasterMeta], spark: SparkSession) -> DataFrame:
    """Footprint of each file: path, min_x, min_y, max_x, max_y in its own coordinates."""
    return spark.createDataFrame([(m.path, *map(float, m.bbox)) for m in meta], "path string, min_x double, min_y double, max_x double, max_y double")
