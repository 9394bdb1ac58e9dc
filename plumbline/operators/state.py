"""Append-only logs, resume sets, keyed notes, request caches and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import running_total


def completed(log: DataFrame, step: str, order: list[str]) -> DataFrame:
    """Each step once, with the first record of it."""
    first = F.min(F.struct(*order)).alias("_f")
    return log.groupBy(step).agg(first, F.count(F.lit(1)).alias("records")).select(step, *[F.col(f"_f.{c}").alias(f"first_{c}") for c in order], "records")


def pending(planned: DataFrame, log: DataFrame, step: str) -> DataFrame:
    """Planned steps the log does not hold."""
    return planned.join(log.select(step).distinct(), step, "left_anti")


def live_notes(ops: DataFrame, key: str, seq: str, op: str, rest: list[str]) -> DataFrame:
    """Notes whose latest operation is an addition."""
    last = ops.groupBy(key).agg(F.max_by(F.struct(op, seq, *rest), seq).alias("_l"))
    return last.filter(F.col("_l")[op] == "add").select(key, *[F.col("_l")[c].alias(c) for c in (seq, *rest)])


def request_key(*fields: str) -> Column:
    """Content address of a request: the digest of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def with_cached(requests: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Requests beside their cached value; ``hit`` tells a miss, which a replay must not answer."""
    return requests.join(cache.select(key, value), key, "left").withColumn("hit", F.col(value).isNotNull())


def spend(meter: DataFrame, cost: str, order: list[str], budget: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Running cost in order, and whether the budget was already spent before each call."""
    total = running_total(meter, cost, order, "spent", keys)
    return total.withColumn("refused", F.col("spent") - F.col(cost) >= budget)
