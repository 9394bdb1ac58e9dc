"""Joins and orderings that survive one key, bucket or value holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stage

# A key with about this many rows on the left is salted. At most rows / HOT_ROWS
# keys can be, which bounds what is broadcast.
HOT_ROWS = 1_000_000
SALTS = 64
# Share of the rows looked at to find hot keys; it decides balance only.
LOOK_AT = 0.01
SMALL_ROWS = 200_000
# Rows that one task sorts and groups at once.
TASK_ROWS = 500_000


def hot_keys(df: DataFrame, on: list[str], hot_rows: int = HOT_ROWS, look_at: float = LOOK_AT, drawn: bool = False) -> DataFrame | None:
    """The keys that need salting as a small written table, or None; ``drawn`` tells that ``df`` is the share already.

    The table is written so that both sides of a join see the same keys, on
    every retry.
    """
    seen = df.select(*on) if look_at >= 1 or drawn else df.select(*on).sample(look_at, seed=11)
    counted = seen.dropna(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = stage(counted.filter(F.col("_n") >= max(1.0, hot_rows * look_at)).select(*on, F.lit(True).alias("_hot")))
    return None if hot.isEmpty() else hot


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    row_id: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    count_on: DataFrame | None = None,
    look_at: float = LOOK_AT,
    drawn: bool = False,
) -> DataFrame:
    """Join where single keys of ``left`` may be hot and ``right`` is unique on the key.

    Rows of a hot key are spread over ``salts`` sub-keys by a hash of their own
    columns, so a retried task places a row where the first attempt placed it;
    only the hot keys of ``right`` are repeated. Without hot keys it is a plain
    join. ``count_on`` is a cheaper frame with the same keys to look at, or a share ``look_at`` of it where it is ``drawn``.
    """
    hot = hot_keys(left if count_on is None else count_on, on, hot_rows, look_at, drawn)
    if hot is None:
        return left.join(right, on, how)
    marked = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.xxhash64(*row_id), F.lit(salts)).cast("int")).otherwise(F.lit(0)),
    )
    repeated = right.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return marked.drop("_hot").join(repeated.drop("_hot"), [*on, "_salt"], how).drop("_salt")


def attach(left: DataFrame, right: DataFrame, on: list[str], row_id: list[str], how: str = "left") -> DataFrame:
    """Join a table of few keys, unique on them, to many rows.

    Few keys mean large groups, so the left side must not be shuffled by them.
    The right side is written and counted: small, it is broadcast; else the
    join is salted.
    """
    table = stage(right)
    if table.count() <= SMALL_ROWS:
        return left.join(F.broadcast(table), on, how)
    return salted_join(left, table, on, row_id, how)


def dealt(df: DataFrame, on: list[str], task_rows: int | None = None) -> DataFrame:
    """Deal the rows of a table by key over as many tasks as keep one of them at about ``task_rows`` rows.

    Rows of a few numbers shrink to some bytes in a shuffle, and tasks made by
    bytes then hold millions of them. A table of too few rows for all cores is
    left alone, and one with a hot key, whose join Spark splits by itself.
    """
    spark = df.sparkSession
    parts = df.count() // (task_rows or TASK_ROWS)
    if parts < spark.sparkContext.defaultParallelism or hot_keys(df, on) is not None:
        return df
    return df.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *on)


def ordered_buckets(df: DataFrame, order_by: list[str], rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Add ``_bucket``, a range number that follows the order of ``order_by`` (nulls first).

    Spark deals the rows out by range. The result is written, so every branch
    and every retry sees the same ranges; they decide balance only, never the
    result. The number of ranges grows with the rows.
    """
    buckets = df.count() // rows_per_bucket
    if buckets < 2:
        return df.withColumn("_bucket", F.lit(0))
    return stage(df.repartitionByRange(buckets, *order_by).withColumn("_bucket", F.spark_partition_id()))


def running_total(
    df: DataFrame,
    value: str,
    order_by: list[str],
    out: str,
    keys: tuple[str, ...] = (),
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """Cumulative sum in a total order, without one task that holds all rows.

    Range buckets are summed on their own; the bucket totals (one per key and
    bucket) are accumulated and added back.
    """
    ranged = ordered_buckets(df, order_by, rows_per_bucket)
    parts = [*keys, "_bucket"]
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*parts).agg(F.sum(value).alias("_sum"))
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*parts).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    offsets = offsets.select(*[F.col(c).alias(f"_o{c}") for c in parts], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in parts]  # rows without a key have an order of their own
    joined = ranged.withColumn("_inside", F.sum(value).over(inside)).join(offsets, same).drop(*[f"_o{c}" for c in parts])
    return joined.withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_bucket")


def number_rows(
    df: DataFrame, order_by: list[str], out: str, keys: tuple[str, ...] = (), rows_per_bucket: int = 1_000_000
) -> DataFrame:
    """Row numbers 1..n in a total order, computed range by range."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_total(ones, "_one", order_by, out, keys, rows_per_bucket).drop("_one")
