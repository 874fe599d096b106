"""Watching a folder: files are converted as they arrive. Each micro-batch is written as rows of a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fileloom.plans import batch

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of pending rows; an id is a hash of the path, so it stays the same when a batch is repeated."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)
    named = files.select(F.substring_index("path", "/", -1).alias("name"), "content", F.xxhash64("path").alias("file_id"))
    return batch.ingest(named, "file_id")


def convert_arrivals(spark: SparkSession, folder: str, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Converts what arrives and appends name, target, status, output and error to a Parquet folder, each file once."""
    rows = batch.convert_all(watch(spark, folder)).drop("content")
    writer = rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
