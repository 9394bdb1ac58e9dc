"""Grouped counts, totals, medians, top lists and comparison tables over verdict records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rates as R


def cell_table(records: DataFrame, cell: list[str]) -> DataFrame:
    """All verdict counts and the two headline rates of every cell in one pass."""
    counted = [
        F.count_if((F.col("kind") == kind) & (F.col("verdict") == v)).alias(f"{v}_n")
        for kind, verdicts in (
            ("citation", ("exists", "not_found", "unresolvable")),
            ("quote", ("accurate", "near_miss", "inaccurate", "unverifiable", "unpaired")),
        )
        for v in verdicts
    ]
    return records.groupBy(*cell).agg(
        *counted, R.existence_rate().alias("existence_rate"), R.strict_rate().alias("strict_rate")
    )


def tally(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Counter per group, rendered ``value=count`` in value order."""
    n = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    pair = F.struct(F.col(value).alias("v"), F.concat(value, F.lit("="), F.col("c").cast("string")).alias("s"))
    listed = n.groupBy(*group).agg(F.array_sort(F.collect_list(pair)).alias("l"))  # one entry per distinct value
    return listed.select(*group, F.array_join(F.transform("l", lambda x: x["s"]), ",").alias("tally"))


def with_totals(rows: DataFrame, cell: list[str], measures: dict[str, Column]) -> DataFrame:
    """Cells, per-first-key totals and the grand total; totals carry ``_all`` in the key columns.

    The measures are additive counts, so the totals are rolled up from the
    cells and the records are read and shuffled once.
    """
    base = rows.groupBy(*cell).agg(*[c.alias(n) for n, c in measures.items()])
    rolled = base.rollup(*cell).agg(*[F.sum(n).alias(n) for n in measures], F.grouping_id().alias("_g"))
    full = (1 << len(cell)) - 1
    keep = [0, *[(1 << i) - 1 for i in range(1, len(cell))], full]
    out = rolled.filter(F.col("_g").isin(*keep)).drop("_g")
    return out.select(*[F.coalesce(F.col(c), F.lit("_all")).alias(c) for c in cell], *measures)


def run_spread(runs: DataFrame, cell: list[str], rate: str, complete: int) -> DataFrame:
    """Mean, sample deviation and range of a rate across runs, for cells with enough runs."""
    return (
        runs.groupBy(*cell)
        .agg(
            F.count(rate).alias("runs"), F.round(F.avg(rate), 9).alias("mean_rate"),
            F.round(F.stddev_samp(rate), 9).alias("sd_rate"), (F.max(rate) - F.min(rate)).alias("range_rate"),
        )
        .filter(F.col("runs") >= complete)
    )


def upper_median(rows: DataFrame, cell: list[str], value: str, out: str) -> DataFrame:
    """The element at position n // 2 of the sorted values.

    Values are counted first, so a cell of any size is a short list of
    distinct values by the time it is put in order.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*cell, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*cell).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*cell)))
    reached = ranked.filter(F.col("_upto") > F.floor(F.col("n") / 2))
    return reached.groupBy(*cell).agg(F.max("n").alias("n"), F.min(value).alias(out))


def quantiles(rows: DataFrame, cell: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Interpolated quantiles from value counts."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*cell, value).agg(F.count(F.lit(1)).alias("_c"))
    return counted.groupBy(*cell).agg(*[F.percentile(value, p, F.col("_c")).alias(n) for n, p in points.items()])


def most_common(rows: DataFrame, key: list[str], position: str, k: int) -> DataFrame:
    """The k most frequent keys; the one seen first wins a tie."""
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_pos"))
    return counted.orderBy(F.desc("n"), "first_pos").limit(k)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, out: str) -> DataFrame:
    """First k rows of each group; Spark cuts to k per task before the shuffle."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(out) <= k)


def per_expected_draft(records: DataFrame, cell: list[str], expected: int) -> DataFrame:
    """Counts per draft over the planned number of drafts, present or not."""
    per = lambda c: c.cast("double") / F.lit(expected)
    v = lambda *names: F.count_if(F.col("verdict").isin(*names))
    n = F.count(F.lit(1))
    return records.filter("kind = 'quote'").groupBy(*cell).agg(
        n.alias("quotes"), per(n).alias("quotes_per_draft"), per(v("accurate")).alias("accurate_per_draft"),
        per(v("near_miss", "inaccurate")).alias("inaccurate_per_draft"),
        R.share(v(*R.SCORED_QUOTES), n).alias("paired_share"),
    )


def compare_scorings(
    rates: DataFrame, tag: str, first: str, second: str, group: str, condition: str, rate: str
) -> DataFrame:
    """Largest and mean cell difference of two scorings, and how often their contrasts agree in sign."""
    wide = rates.groupBy(group, condition).pivot(tag, [first, second]).agg(F.first(rate))
    wide = wide.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    base = wide.filter(F.col(condition) == "baseline").select(
        group, F.col(first).alias("_b1"), F.col(second).alias("_b2")
    )
    joined = wide.join(base, group)
    gap = F.abs(F.col(first) - F.col(second))
    other = F.col(condition) != "baseline"
    same = F.signum(F.col(first) - F.col("_b1")) == F.signum(F.col(second) - F.col("_b2"))
    return joined.groupBy(group).agg(
        F.max(gap).alias("max_abs_diff"), F.round(F.avg(gap), 9).alias("mean_abs_diff"),
        F.count_if(other & same).alias("same_sign"), F.count_if(other).alias("contrasts"),
    )


def matrix(fits: DataFrame, present: DataFrame, columns: dict[str, str], expected: int) -> DataFrame:
    """Every model and condition beside its value in each fit, null where a fit lacks the cell."""
    models = fits.select("model").distinct()
    conditions = fits.select("condition").distinct()
    wide = fits.groupBy("model", "condition").pivot("template", list(columns.values())).agg(F.first("n"))
    grid = models.crossJoin(conditions)  # distinct keys of two small dimensions
    joined = grid.join(wide, ["model", "condition"], "left").join(present, ["model", "condition"], "left")
    return joined.select(
        "model", "condition", *[F.col(tag).alias(name) for name, tag in columns.items()],
        (F.lit(expected) - F.coalesce("have", F.lit(0))).alias("missing_drafts"),
    )


def macros(cells: DataFrame, cell: list[str], values: dict[str, Column]) -> DataFrame:
    """Long (name, value) rows for a report."""
    first, second = cell
    stem = F.concat(F.upper(first), F.upper(F.left(second, F.lit(1))), F.substring(second, 2, 1000))
    pairs = F.array(
        *[F.struct(F.concat(F.lit(p), stem).alias("name"), v.alias("value")) for p, v in values.items()]
    )
    return cells.select(F.explode(pairs).alias("p")).select("p.name", "p.value")
