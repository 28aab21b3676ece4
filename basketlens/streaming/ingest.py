"""Continuous ingestion: new feed files of a folder into the catalogue, each batch once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from basketlens.sinks.catalog import Catalog
from basketlens.sources.feeds import IDENTITY, forward_fill


def feed_stream(spark: SparkSession, path: str, columns: Sequence[str], files_at_once: int = 100) -> DataFrame:
    """New CSV files of a folder as string columns with ``file`` and ``ord``; a file is never split over two batches."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", `_bad` string"
    read = spark.readStream.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_bad").option("escape", '"').option("multiLine", True).option("enforceSchema", True)
    return read.option("maxFilesPerTrigger", files_at_once).csv(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("made"))


def ordered(batch: DataFrame) -> DataFrame:
    """Rows with ``ord`` (files by their time, then rows as they stand) and the identity of their block filled in."""
    rows = batch.withColumn("row", F.monotonically_increasing_id()).filter(F.col("_bad").isNull()).drop("_bad")
    filled = forward_fill(rows, [c for c in IDENTITY if c in rows.columns], "file", "row")
    return filled.withColumn("ord", F.struct("made", "file", "row")).drop("made", "row")


def ingest(stream: DataFrame, source: str, load: Callable[[DataFrame, tuple[str, int]], object], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to a load of the catalogue; ``(source, batch number)`` lets it pass over what it has taken in.

    A batch that died after some tables were switched comes again with the same rows and
    number when the stream is started again.
    """

    def each(batch: DataFrame, number: int) -> None:
        load(ordered(batch), (source, number))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_prices(spark: SparkSession, path: str, columns: Sequence[str], catalog: Catalog, checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Price feeds of a folder into products, prices and availability."""
    return ingest(feed_stream(spark, path, columns, files_at_once), "prices", catalog.load_prices, checkpoint)


def ingest_stores(spark: SparkSession, path: str, columns: Sequence[str], catalog: Catalog, checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Store feeds of a folder into stores."""
    return ingest(feed_stream(spark, path, columns, files_at_once), "stores", catalog.load_stores, checkpoint)
