"""Writers: upserts, snapshots, appended logs, JSON tables and pivot reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.resolve import first_writer, last_writer


def upsert(spark: SparkSession, path: str, staged: str, rows: DataFrame, key: list[str], seq: str, keep: str = "last") -> str:
    """Merge rows into a keyed table by writing a new snapshot beside the old one; returns its path.

    The committer publishes the snapshot as a whole, so a reader of the old
    path is never given half a table.
    """
    merged = rows
    if path:
        merged = spark.read.parquet(path).unionByName(rows)
    pick = last_writer if keep == "last" else first_writer
    pick(merged, key, [seq]).write.mode("overwrite").parquet(staged)
    return staged


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def json_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def csv_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One Markdown table line per row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def check_claims(claims: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Does the text under a key match the pattern a recorded value leads one to expect?"""
    joined = claims.join(texts, key, "left")
    return joined.withColumn("holds", F.coalesce(F.expr("text rlike pattern"), F.lit(False)))
