"""Small Spark helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are compared: it is smaller than no other id.
NO_ID = (1 << 63) - 1


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function yields batches with the columns of ``schema`` in order."""
    return df.mapInArrow(fn, schema)


def held_out(doc_id: Column) -> Column:
    """True for the third of all ids that models never learn from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def kept(df: DataFrame) -> DataFrame:
    """A DataFrame of small rows that several later steps read: computed once, recomputed if an executor is lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; where it is unset a temporary one, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration's state by a reliable checkpoint in the cluster's shared folder.

    The garbage collection lets Spark drop the shuffle files that led to it.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    context._jvm.System.gc()
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, key: str) -> DataFrame:
    """Bring the rows of a key to one task: as many partitions as the session's shuffles have."""
    return df.repartition(partitions(df.sparkSession), key)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` and nothing else, so that columns of other names cannot clash."""
    return df.select("doc_id", "text", *more)


@contextlib.contextmanager
def released(*frames: DataFrame):
    """Unpersist frames when a block of driver-side work is over."""
    try:
        yield
    finally:
        for x in frames:
            x.unpersist()
