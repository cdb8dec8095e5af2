"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import itertools
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators.lineage import small_batches  # noqa: F401

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir. A local folder stands in where nothing is set and all tasks run on this machine, as in
    tests; on a cluster without the setting this is an error, as executors would not share such a folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quadloom-checkpoint-"))


#: Checkpoints between two times that what is out of use is given back.
ROUNDS = 4
_count = itertools.count(1)


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage by a reliable checkpoint.

    Spark deletes the shuffle files and checkpoints of frames that are out of use only when the driver collects its garbage, which
    it may not do for half an hour; jobs of many rounds would fill the disks meanwhile. So every ROUNDS-th call asks for it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if next(_count) % ROUNDS == 0:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


#: `join_hot`: at most so many keys are broadcast.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, groups: DataFrame, key: str | list[str], n: str, total: int) -> DataFrame:
    """rows joined with groups (one row a key; n: how many of the `total` rows have it) on a key, however many rows share it.

    Keys with more than a HOT_KEYS-th of all rows, of which there are less than HOT_KEYS, are broadcast, so their rows stay where they
    are; the others meet by a shuffle. Null keys join nothing. Both frames are read more than once: pass saved ones.
    """
    hot, key = F.col(n) > total // HOT_KEYS, [key] if isinstance(key, str) else key
    few = F.broadcast(groups.where(hot))
    columns = [*rows.columns, *(c for c in groups.columns if c not in key)]
    many = rows.join(few.select(key), key, "left_anti").join(groups.where(~hot), key)
    return rows.join(few, key).select(columns).unionByName(many.select(columns))


def text_of(docs: DataFrame, name: str = "text") -> Column:
    return F.coalesce(docs[name], F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches, column: str, most: int = 1 << 21):
    """Arrow batches cut to runs of rows with about `most` bytes in `column`, so one batch never holds much more than one text."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.names.index(column))).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
