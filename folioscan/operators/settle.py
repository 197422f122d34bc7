"""Results of a batch that several later steps read."""

from __future__ import annotations

import re
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a settled table that every executor may be sent.
FEW = 1 << 16


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once: a reliable checkpoint in the folder that the session names, else kept in memory and on disk."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None and (named := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True) if context.getCheckpointDir() else df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """The folder of the checkpoints, which the driver and all executors share; in local mode a temporary one where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def side(df: DataFrame, most: int = FEW) -> DataFrame:
    """A settled table as a join's side: sent to all executors if it has few rows, which are counted, and never otherwise; Spark
    takes the size of an exploded table for that of its source, and would send millions of rows through the driver."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def detailed(ranked: DataFrame, rows: DataFrame, on: str = "doc_id") -> DataFrame:
    """Ranked rows with the columns of `rows`, each found once: they are settled and, where few, sent to the tasks that read
    `rows`, so that no texts are shuffled."""
    return rows.join(side(settled(ranked)), on)
