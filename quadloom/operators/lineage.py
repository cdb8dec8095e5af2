"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir. A local folder stands in where nothing is set and all tasks run on this machine, as
    in tests; on a cluster without the setting this is an error, as executors would not share such a folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quadloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch that goes to Python workers; with several workers an executor, larger ones add up.
BATCH = "4m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to BATCH, as Spark reads the setting when a frame runs, not when it is made. A caller's
    own setting, if there is one, stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, BATCH)
    return df
