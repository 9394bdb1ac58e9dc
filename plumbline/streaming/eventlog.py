"""Exactly-once ingestion of append-only logs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tolerant_json(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of JSON lines; a torn or corrupt line is dropped, not fatal."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    parsed = raw.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.filter(F.col("r").isNotNull() & F.col("r._corrupt").isNull()).select("r.*").drop("_corrupt")


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder as a stream."""
    schema = spark.read.parquet(os.path.join(folder, name)).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def once_per_step(stream: DataFrame, step: str) -> DataFrame:
    """First record of each step over the life of the checkpoint.

    The done-set has no time bound, so it is kept in the state store, hashed
    over the shuffle partitions, and spills to disk with the RocksDB store.
    """
    return stream.dropDuplicates([step])


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet table: all that is there now, then stop between batches."""
    return (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
