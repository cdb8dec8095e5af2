"""MBTiles files: a Python data source that reads tiles by zoom, and a writer with one connection.

A SQLite file has one writer by nature. The canonical result of a build is a Parquet table; an MBTiles file is exported from it
in one task, into a temporary file that replaces the target when it is complete, so a retried task does no harm.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = ("zoom_level", "tile_column", "tile_row", "tile_data", "tile_alpha")
SCHEMA = "zoom_level int, tile_column int, tile_row int, tile_data binary, tile_alpha binary"
#: Columns of tiles a read partition takes.
STRIPE = 4096


def create_schema(con: sqlite3.Connection, alpha: bool) -> None:
    """Tables metadata and tiles, with a column for alpha planes if asked for, and the unique index on the tile key."""
    con.execute("CREATE TABLE metadata (name TEXT NOT NULL, value TEXT NOT NULL, UNIQUE (name))")
    extra = ", tile_alpha BLOB NOT NULL" if alpha else ""
    con.execute(f"CREATE TABLE tiles (zoom_level INTEGER NOT NULL, tile_column INTEGER NOT NULL, tile_row INTEGER NOT NULL, tile_data BLOB NOT NULL{extra})")
    con.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")


def _columns(con: sqlite3.Connection) -> list[str]:
    return [r[1] for r in con.execute("PRAGMA table_info(tiles)")]


class Stripe(InputPartition):
    def __init__(self, zoom: int, low: int, high: int):
        self.zoom, self.low, self.high = zoom, low, high


class MBTilesReader(DataSourceReader):
    def __init__(self, path: str, zooms: set[int] | None):
        self.path, self.zooms = path, zooms

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            ranges = con.execute("SELECT zoom_level, min(tile_column), max(tile_column) FROM tiles GROUP BY zoom_level").fetchall()
        return [Stripe(z, c, min(c + STRIPE, b + 1)) for z, a, b in ranges if self.zooms is None or z in self.zooms for c in range(a, b + 1, STRIPE)]

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:  # what Spark asks for where there is no partition
            return
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            alpha = "tile_alpha" if "tile_alpha" in _columns(con) else "NULL"
            yield from con.execute(f"SELECT zoom_level, tile_column, tile_row, tile_data, {alpha} FROM tiles WHERE zoom_level = ? AND tile_column >= ? AND tile_column < ?", (partition.zoom, partition.low, partition.high))


class MBTilesSource(DataSource):
    """spark.read.format("mbtiles").option("zooms", "5,6").load(path): the tiles, alpha null where the file has none, all zooms by default.

    Zooms are an option, as filters that are pushed into a Python reader belong to the relation: two scans of one frame with different
    filters in one plan would both get the last one's.
    """

    @classmethod
    def name(cls) -> str:
        return "mbtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        zooms = self.options.get("zooms")
        return MBTilesReader(self.options["path"], None if zooms is None else {int(z) for z in zooms.split(",") if z})


def read_mbtiles(spark: SparkSession, path: str, zooms: list[int] | None = None) -> DataFrame:
    """The tiles of a file; only those of `zooms` are read, if they are given."""
    spark.dataSource.register(MBTilesSource)
    reader = spark.read.format("mbtiles")
    return (reader if zooms is None else reader.option("zooms", ",".join(map(str, zooms)))).load(path)


def read_metadata(path: str) -> dict[str, str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return dict(con.execute("SELECT name, value FROM metadata"))


def export(tiles: DataFrame, metadata: DataFrame, path: str, alpha: bool, base: str | None = None) -> None:
    """Writes tiles (COLUMNS; tile_alpha only if `alpha`) and metadata (name, value) to an MBTiles file at a path that the one
    writing task reaches. base: a file whose rows are taken over first; rows with the same key or name replace them. Duplicate keys
    within `tiles` are an error."""
    names = [c for c in COLUMNS if alpha or c != "tile_alpha"]
    rows = metadata.select(F.lit(0).alias("part"), *(F.lit(None).cast("int").alias(c) for c in names[:3]), *(F.lit(None).cast("binary").alias(c) for c in names[3:]), "name", "value")
    both = tiles.select(F.lit(1).alias("part"), *names, F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value")).unionByName(rows)

    def write(batches):
        temporary = f"{path}.{uuid.uuid4().hex}"
        con = sqlite3.connect(temporary)
        con.execute("PRAGMA synchronous=OFF")
        con.execute("PRAGMA journal_mode=WAL")
        create_schema(con, alpha)
        if base:
            con.execute("ATTACH ? AS base", (base,))
            con.execute(f"INSERT INTO tiles SELECT {', '.join(names)} FROM base.tiles")
            con.execute("INSERT INTO metadata SELECT name, value FROM base.metadata")
        n, marks = 0, ", ".join("?" * len(names))
        verb = "INSERT OR REPLACE" if base else "INSERT"
        for pdf in batches:
            own = pdf[pdf["part"] == 1]
            con.executemany(f"{verb} INTO tiles ({', '.join(names)}) VALUES ({marks})", ([int(r[c]) if c in names[:3] else bytes(r[c]) for c in names] for r in own.to_dict("records")))
            con.executemany("INSERT OR REPLACE INTO metadata VALUES (?, ?)", pdf.loc[pdf["part"] == 0, ["name", "value"]].values.tolist())
            n += len(own)
        con.commit()
        con.execute("PRAGMA journal_mode=DELETE")  # one file again, which may be read where nothing can be written
        con.close()
        os.replace(temporary, path)
        yield type(pdf)({"n": [n]}) if n or base else type(pdf)({"n": [0]})

    both.coalesce(1).mapInPandas(write, "n long").collect()  # one row
