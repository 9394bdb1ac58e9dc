"""Deterministic draws by hash, per-group heads, strides and seeded corruptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.cells import top_per_group
from plumbline.operators.skew import number_rows

# A word no text holds.
FOREIGN_WORD = "zyxwv"


def draw_key(seed: int, *ids: str) -> Column:
    """A sortable key that looks random and is the same on every engine and every run."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def uniform(seed: int, *ids: str) -> Column:
    """A number in [0, 1) from the first eight hex digits of the draw key."""
    return F.conv(F.left(draw_key(seed, *ids), F.lit(8)), 16, 10).cast("long") / F.lit(4294967296.0)


def sample(df: DataFrame, seed: int, ids: list[str], n: int) -> DataFrame:
    """n rows at random; a top-n per task, never a full sort."""
    return df.orderBy(draw_key(seed, *ids), *ids).limit(n)


def head_per_class(df: DataFrame, seed: int, ids: list[str], cls: str, n: int) -> DataFrame:
    """Up to n random rows of each class."""
    return top_per_group(df, [cls], [draw_key(seed, *ids), *[F.col(i) for i in ids]], n, "_rk").drop("_rk")


def strided(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """Every k-th row so that about n remain, first n of them."""
    numbered = number_rows(df, order_by, "_i")
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    step = F.greatest(F.lit(1), F.expr(f"_total div {n}"))
    return (
        numbered.crossJoin(F.broadcast(total))  # one row
        .filter((F.col("_i") - 1) % step == 0).orderBy("_i").limit(n).drop("_i", "_total")
    )


def corruptions(df: DataFrame, key: str, words: str) -> DataFrame:
    """Seeded faults of a passage: negated, one word swapped, three words dropped."""
    w = F.col(words)
    join = lambda a: F.array_join(a, " ")
    tail = lambda k: F.slice(w, F.lit(k), F.greatest(F.lit(0), F.size(w) - k + 1))
    return df.select(
        key, join(w).alias("genuine"), F.concat(F.lit("not "), join(w)).alias("negated"),
        join(F.concat(F.slice(w, 1, 2), F.array(F.lit(FOREIGN_WORD)), tail(4))).alias("swapped"),
        join(F.concat(F.slice(w, 1, 2), tail(6))).alias("dropped"),
    )
