"""Feedback to a drafter: true lines, lines aimed at verified items, and mixtures of the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.episodes import citation_line, quote_line
from plumbline.operators.sampling import draw_key, uniform
from plumbline.operators.skew import number_rows, salted_join
from plumbline.session import stage, union_all

# --- fixed values -----------------------------------------------------------
NONE_MARK = "__NONE__"
KEEP = {"scrambled": None, "quarter": 0.25, "half": 0.5, "threequarter": 0.75}
QUOTE_BRANCH = 0.5
# ----------------------------------------------------------------------------


def feedback(items: DataFrame, draft: str, item: str, seed: int = 30) -> DataFrame:
    """(draft, item, arm, origin, line) for the seven arms.

    ``items`` has, beside the two ids, kind ('citation' or 'quote'), verdict, citation, quote and passage. A citation that is
    not found and a quotation that fails give one line each. `none` has one mark for a draft with any; `passage` names
    the closest passage where one is known. In `scrambled` every line is aimed at a verified item of the same draft instead, and
    in the mixtures those that a draw does not keep: at a quotation by a second draw, else at a citation; a mixture
    keeps a line that finds no verified item, `scrambled` drops it.

    Failed and verified items of a draft are each put in an order by hash, and the n-th line takes the n-th verified item
    from an offset drawn for the draft and arm: lines get different items as long as there are enough. Items meet by (draft,
    branch, place), so a draft of many items is no single task; draws are hashes, the same on every run.
    """
    cited = F.col("citation").isNotNull()
    bad = ((F.col("kind") == "citation") & (F.col("verdict") == "not_found")) | (
        (F.col("kind") == "quote") & F.col("verdict").isin("inaccurate", "near_miss") & cited
    )
    good = ((F.col("kind") == "citation") & (F.col("verdict") == "exists")) | (
        (F.col("kind") == "quote") & (F.col("verdict") == "accurate") & cited
    )
    line = F.when(F.col("kind") == "citation", citation_line(F.col("citation"))).otherwise(quote_line(F.col("quote"), F.col("citation")))
    key = draw_key(seed, item)
    failed = number_rows(
        items.where(bad).select(draft, item, "kind", "quote", "citation", "passage", line.alias("true_line"), key.alias("_k")), ["_k", item], "_p", (draft,)
    )
    failed = stage(failed.drop("_k"))
    verified = number_rows(items.where(good).select(draft, item, F.col("kind").alias("_branch"), line.alias("_line"), key.alias("_k")), ["_k", item], "_at", (draft, "_branch"))
    verified = stage(verified.select(draft, "_branch", "_at", "_line"))
    held = lambda branch: F.count_if(F.col("_branch") == branch)
    counts = verified.groupBy(draft).agg(held("quote").alias("_quotes"), held("citation").alias("_citations"))

    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).cast("double").alias("keep")) for a, k in KEEP.items()])).alias("a")
    drawn = salted_join(failed, counts, [draft], [item]).select("*", arms).select("*", "a.*").drop("a")
    keep = F.col("keep").isNotNull()
    branch = (
        F.when(keep & (uniform(seed + 1, "arm", item) < F.col("keep")), "true")
        .when((F.col("_quotes") > 0) & (uniform(seed + 2, "arm", item) < QUOTE_BRANCH), "quote")
        .when(F.col("_citations") > 0, "citation").when(keep, "true")
    )
    drawn = drawn.withColumn("_branch", branch).where("_branch IS NOT NULL")
    n = F.when(F.col("_branch") == "quote", F.col("_quotes")).otherwise(F.col("_citations"))
    offset = F.conv(F.left(draw_key(seed + 3, "arm", draft), F.lit(8)), 16, 10).cast("long")
    placed = drawn.withColumn("_at", F.when(F.col("_branch") != "true", F.pmod(F.col("_p") - 1 + offset, n) + 1))
    aimed = placed.join(verified, [draft, "_branch", "_at"], "left")
    mixed = aimed.select(draft, item, "arm", F.col("_branch").alias("origin"), F.coalesce("_line", "true_line").alias("line"))

    named = F.when(F.col("kind") == "quote", quote_line(F.col("quote"), F.col("citation"), F.col("passage"))).otherwise(F.col("true_line"))
    plain = lambda arm, text: failed.select(draft, item, F.lit(arm).alias("arm"), F.lit("true").alias("origin"), text.alias("line"))
    none = failed.select(draft).distinct().select(
        draft, F.lit(None).cast(failed.schema[item].dataType).alias(item), F.lit("none").alias("arm"), F.lit("mark").alias("origin"), F.lit(NONE_MARK).alias("line")
    )
    return union_all([plain("true", F.col("true_line")), plain("passage", named), none, mixed])


def side_by_parity(index: Column) -> Column:
    return F.when(index % 2 == 0, "petitioner").otherwise("respondent")


def numbered_from_zero(df: DataFrame, order_by: list[str], out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return number_rows(df, order_by, "_n", keys).withColumn(out, F.col("_n") - 1).drop("_n")


def zip_by_position(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of a key on the left beside the n-th on the right; what has no counterpart stands alone.

    Columns other than the key must differ. ``place`` counts from 0; the lengths tell which keys do not fit (``unequal``).
    """
    a = numbered_from_zero(left, left_order, "place", (key,)).withColumn("_left", F.lit(True))
    b = numbered_from_zero(right, right_order, "place", (key,)).withColumn("_right", F.lit(True))
    pairs = a.join(b, [key, "place"], "full")
    return pairs.withColumn("alone", F.col("_left").isNull() | F.col("_right").isNull()).drop("_left", "_right")


def unequal_lengths(pairs: DataFrame, key: str) -> DataFrame:
    """Keys whose two lists differ in length, and by how much."""
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("longer"), F.count_if(~F.col("alone")).alias("shorter")).where("longer <> shorter")


def carried_panel(planned: DataFrame, observed: DataFrame, episode: list[str], round_: str, value: str, rounds: int) -> DataFrame:
    """Every planned episode in every round 0..rounds: a missing round has the value before it, an episode without any has 0."""
    grid = planned.select(*episode, F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias(round_))
    seen = observed.where(F.col(round_).between(0, rounds)).select(*episode, F.col(round_).cast("int").alias(round_), value)
    before = Window.partitionBy(*episode).orderBy(round_).rowsBetween(Window.unboundedPreceding, 0)  # rounds + 1 rows
    return grid.join(seen, [*episode, round_], "left").withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(before), F.lit(0)))
