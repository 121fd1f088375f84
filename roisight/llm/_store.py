"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  Only a local master, which has one machine, may do without and take a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.nonEmpty():
            folder = held.get()
        elif re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="checkpoint")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the cluster's checkpoint folder; a local folder serves only where none is set."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def small_enough(df: DataFrame, row_bytes: int, limit: int) -> bool:
    """Whether the rows of a table, at so many bytes each, stay under a bound for broadcasting."""
    return df.count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = 48 << 20) -> DataFrame:
    """A hint to broadcast after its size was checked; else Spark picks a join that shuffles."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df.hint("merge")
