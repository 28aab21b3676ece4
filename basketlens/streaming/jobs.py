"""Feeds as streams: the batch functions on micro-batches, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, path: str, schema: str, checkpoint: str, load: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand new files of a folder to ``load`` once each; a file never falls into two micro-batches."""
    rows = spark.readStream.schema(schema).option("header", True).csv(path)
    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_prices(log: DataFrame, late: str | None = None) -> DataFrame:
    """The price of greatest time for each item and branch; works on batches and, in update mode, on streams."""
    rows = log.withWatermark("seen", late) if late else log
    return rows.groupBy("product_id", "store_id").agg(F.max_by("price", "seen").alias("price"), F.max("seen").alias("seen"))


def feed_windows(log: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Rows and value of each source in tumbling windows."""
    rows = log.withWatermark("ts", late) if late else log
    return rows.groupBy(F.window("ts", width).alias("w"), "source").agg(F.count("*").alias("n")).select("source", F.col("w.start").alias("start"), "n")
