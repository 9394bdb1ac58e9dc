"""Table access of the pipeline operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir, stage

__all__ = ["read", "shared_dir", "split_small", "stage", "text_key"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_key(text: Column) -> Column:
    """32 bits of a text; with doc_id they tell rows apart that share an id."""
    return F.hash(text)


def bound_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small, whatever the length of the texts: a worker and its JVM hold some of them at once.

    Spark takes the sizes from the session when a plan runs, so they are set there, and only ever lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def split_small(df: DataFrame) -> DataFrame:
    """Made ready for Python tasks: Arrow batches are bounded, and a table of fewer splits than cores is dealt over the cores."""
    bound_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
