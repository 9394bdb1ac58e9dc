"""Set-overlap join by an inverted index: pairs of rows whose token sets share at least `least` tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import SMALL_ROWS, salted_join
from plumbline.session import stage

# Rows of the right side that one (key, token) group may hold before it is dealt over sub-groups.
GROUP_ROWS = 100_000


def by_rarity(entries: DataFrame, frequency: DataFrame, keys: list[str], row_id: str, least: int) -> DataFrame:
    """(keys, row_id, tokens, token): each row's tokens, rarest first, and one row for each token of its prefix.

    Two sets that share ``least`` tokens share one among the first ``size - least + 1`` of either.
    """
    known = salted_join(entries, frequency, [*keys, "token"], [row_id], "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")
    sets = known.groupBy(*keys, row_id).agg(F.array_sort(F.collect_set(rank)).alias("ranked"))
    sets = sets.select(*keys, row_id, F.col("ranked.token").alias("tokens"))
    prefix = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.size("tokens") - (least - 1)))
    return sets.withColumn("token", F.explode(prefix))


def asked_for(entries: DataFrame, asking: DataFrame, keys: list[str]) -> DataFrame:
    """Entries whose token some row of the other side holds under the same keys: no other can be shared.

    Where that side has few tokens, what none of its rows holds is left out before anything is shuffled.
    """
    wanted = stage(asking.select(*keys, "token").distinct())
    few = wanted.select("token").distinct()
    if keys and few.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        entries = entries.join(F.broadcast(few), "token", "left_semi")
    return entries.join(wanted, [*keys, "token"], "left_semi")


def overlap_pairs(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, on: Sequence[str] = (), least: int = 1, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(on, left_id, right_id, shared): pairs with equal ``on`` that share ``least`` tokens or more, and those tokens, rarest first.

    Postings are (on, token) lists of the rows; rows meet only at a token of both prefixes, and a
    pair is kept at its rarest shared token alone, so it comes once. Tokens that many rows hold are dealt over sub-lists
    by a hash of the right row, and only those are repeated on the left. Rows with a null or empty set, or a null
    in ``on``, have no pairs; repeated ids of a side count as one row that holds all their tokens.
    """
    keys = list(on)
    a = left.select(*keys, F.col(left_id).alias("_l"), F.explode(tokens).alias("token")).dropna(subset=["token", *keys])
    b = right.select(*keys, F.col(right_id).alias("_r"), F.explode(tokens).alias("token")).dropna(subset=["token", *keys])
    b = stage(asked_for(b, a, keys).distinct())
    frequency = stage(b.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n")))
    lists: Column = F.ceil(F.col("n") / group_rows).cast("int")
    dealt = frequency.where(F.col("n") > group_rows).select(*keys, "token", lists.alias("_lists"))  # at most rows / group_rows tokens
    many = F.coalesce("_lists", F.lit(1))
    p = by_rarity(a, frequency, keys, "_l", least).join(F.broadcast(dealt), [*keys, "token"], "left")
    q = by_rarity(b, frequency, keys, "_r", least).join(F.broadcast(dealt), [*keys, "token"], "left")
    p = p.withColumn("_list", F.explode(F.sequence(F.lit(0), many - 1))).withColumnRenamed("tokens", "_a").drop("_lists")
    q = q.withColumn("_list", F.pmod(F.xxhash64("_r"), many).cast("int")).withColumnRenamed("tokens", "_b").drop("_lists")
    met = p.join(q, [*keys, "token", "_list"]).withColumn("shared", F.array_intersect("_a", "_b"))
    kept = met.where((F.get("shared", F.lit(0)) == F.col("token")) & (F.size("shared") >= least))
    return kept.select(*keys, F.col("_l").alias(left_id), F.col("_r").alias(right_id), "shared")
