"""Intermediate tables in the shared folder, and small helpers that every operator here uses."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list = []


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


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without
    computing ``df`` again, and its row count is metadata.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kindred-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append((spark, path))
    sweep(spark)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files behind frames that are gone; those of a frame being staged are held until its caller has let go of it."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df_or_all: DataFrame | None = None) -> None:
    """Delete staged tables: one that is no longer needed, or all of them."""
    names = None if df_or_all is None else {f.rpartition("/")[0] for f in df_or_all.inputFiles()}
    for item in list(_written):
        if names is None or any(n.endswith(_plain(item[1])) for n in names):
            _delete(item)


def _plain(path: str) -> str:
    return path.removeprefix("file:").lstrip("/")


def _delete(item: tuple[SparkSession, str]) -> None:
    spark, path = item
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)
    _written.remove(item)


atexit.register(discard)


@contextlib.contextmanager
def clearing(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes the tables staged inside, but those in the list that it gives."""
    before, saved = {path for _, path in _written}, list(kept)
    try:
        yield saved
    finally:
        names = {f.rpartition("/")[0] for df in saved for f in df.inputFiles()}
        for item in [x for x in _written if x[1] not in before]:
            if not any(n.endswith(_plain(item[1])) for n in names):
                _delete(item)


def lookup(rows: DataFrame, table: DataFrame, key: str, share: int = 2000) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that has each key once, where a key may hold any part of ``rows``.

    Keys of more than 1/``share`` of all rows are fewer than ``share``, so their
    rows meet the table's by a broadcast of bounded size and never shuffle; any
    other key brings at most that part of the rows to one task. ``rows`` should
    be staged: it is read three times.
    """
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("k_many")).filter(F.col("k_many") > max(256, total // share)).select(key)
    hot = staged(hot.join(table, key), "hot")  # fewer than share rows, whatever the table holds
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Smaller Arrow batches for what runs inside: whole texts are sent in them, and both ends hold one."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def slices(batch: pa.RecordBatch, column: int, size: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about so many bytes of text, or one text, and their texts (null as empty)."""
    held = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) + 64)])
    at = 0
    while at < batch.num_rows:
        end = min(batch.num_rows, max(at + 1, int(np.searchsorted(held, held[at] + size, "right")) - 1))
        part = batch.slice(at, end - at)
        yield part, [t or "" for t in part.column(column).to_pylist()]
        at = end


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A top-level column, whatever its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
