"""Intermediate tables of the engine, written down in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list = []
SENT = 4 << 20  # bytes of a table that a join broadcasts at most


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and everything runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = have.get() if have.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read back: one evaluation, and nothing that follows computes it again, lost executors or not."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kindred-engine-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def room(*texts: str) -> Column:
    """Bytes that a table of these text columns takes, counted over its rows."""
    return F.sum(sum((F.octet_length(c) for c in texts), F.lit(64)))


def lesser(table: DataFrame, size: int | None) -> DataFrame:
    """``table`` of so many bytes as the smaller side of a join: broadcast up to ``SENT`` bytes, met by a shuffle beyond.

    What it meets are substrings cut from texts, of which plans take the size of
    the file for theirs: left to itself a plan may broadcast those.
    """
    return F.broadcast(table) if (size or 0) <= SENT else table.hint("merge")


@atexit.register
def clear() -> None:
    """Delete all tables that were written."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
