"""Clustered logistic fits, step-down correction, rank tests, bootstraps and exact tables.

Spark reduces the records to counts per cluster and cell; what the numpy
kernels see is as large as the design, not as the data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import rates as R

CONTRASTS = ["quota", "temporal", "stakes", "combo"]
Z = 1.96
FIT_SCHEMA = (
    "model string, kind string, term string, odds_ratio double, ci_low double, ci_high double, p double, n long, note string"
)


def scored(records: DataFrame, lenient: bool = False) -> DataFrame:
    """Adjudicable rows with their success indicator; the other verdicts leave both counts."""
    good = ["exists", "accurate", *(["near_miss"] if lenient else [])]
    kept = ((F.col("kind") == "citation") & F.col("verdict").isin(*R.SCORED_CITATIONS)) | (
        (F.col("kind") == "quote") & F.col("verdict").isin(*R.SCORED_QUOTES)
    )
    return records.filter(kept).withColumn("y", F.col("verdict").isin(*good).cast("long"))


def sufficient(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Trials and successes of each key: exact input for the fit, since all rows of a key share a mean."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))


def _exchangeable_fit(x: np.ndarray, n: np.ndarray, s: np.ndarray, cluster: np.ndarray, rounds: int = 60):
    """Logistic estimating equations with exchangeable correlation on grouped counts: (beta, covariance)."""
    p = x.shape[1]
    size = np.bincount(cluster, weights=n)
    pairs = (size * (size - 1) / 2).sum()
    by_cluster = lambda v: np.column_stack([np.bincount(cluster, weights=v[:, j]) for j in range(v.shape[1])])
    beta, alpha = np.zeros(p), 0.0
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-x @ beta))
        var = mu * (1 - mu)
        f, k = 1 / (1 - alpha), alpha / (1 + (size - 1) * alpha)
        w = by_cluster((n * np.sqrt(var))[:, None] * x)
        resid = (s - n * mu) / np.sqrt(var)
        summed = np.bincount(cluster, weights=resid)
        hess = f * ((x * (n * var)[:, None]).T @ x - (w * k[:, None]).T @ w)
        score = f * (by_cluster((s - n * mu)[:, None] * x) - (k * summed)[:, None] * w)
        step = np.linalg.solve(hess, score.sum(axis=0))
        beta = beta + step
        squares = (s * (1 - mu) ** 2 + (n - s) * mu**2) / var
        per = np.bincount(cluster, weights=squares)
        scale = per.sum() / (n.sum() - p)
        alpha = ((summed**2 - per) / 2).sum() / scale / (pairs - p)
        if np.abs(step).max() < 1e-9:
            break
    bread = np.linalg.inv(hess)
    return beta, bread @ (score.T @ score) @ bread


def _fit_group(pdf: pd.DataFrame, conditions: list[str], effects: list[str], covariate: str | None) -> pd.DataFrame:
    model, kind = pdf["model"].iloc[0], pdf["kind"].iloc[0]
    n, s = pdf["n"].to_numpy(float), pdf["s"].to_numpy(float)
    columns = [np.ones(len(pdf)), *[(pdf["condition"] == c).to_numpy(float) for c in conditions]]
    for effect in effects:
        columns += [(pdf[effect] == level).to_numpy(float) for level in sorted(pdf[effect].unique())[1:]]
    if covariate:
        columns.append(pdf[covariate].to_numpy(float))
    total = int(n.sum())
    blank = [(model, kind, c, None, None, None, None, total, "no variation") for c in conditions]
    names = [f.split(" ")[0] for f in FIT_SCHEMA.split(", ")]
    if s.sum() in (0, n.sum()):
        return pd.DataFrame(blank, columns=names)
    try:
        with np.errstate(all="raise", under="ignore"):
            beta, cov = _exchangeable_fit(np.column_stack(columns), n, s, pd.factorize(pdf["matter"])[0])
            se = np.sqrt(np.diag(cov))
    except (np.linalg.LinAlgError, FloatingPointError) as e:
        return pd.DataFrame([(*row[:-1], str(e)[:80]) for row in blank], columns=names)
    out = []
    for i, c in enumerate(conditions, 1):
        b, e = float(beta[i]), float(se[i])
        out.append((model, kind, c, math.exp(b), math.exp(b - Z * e), math.exp(b + Z * e), math.erfc(abs(b / e) / math.sqrt(2)), total, None))
    return pd.DataFrame(out, columns=names)


def clustered_fits(
    stats: DataFrame, conditions: list[str] = CONTRASTS, effects: tuple[str, ...] = (), covariate: str | None = None
) -> DataFrame:
    """One fit per model and kind from sufficient statistics (``matter``, ``condition``, effects, ``n``, ``s``)."""
    run = lambda pdf: _fit_group(pdf, conditions, list(effects), covariate)
    return stats.groupBy("model", "kind").applyInPandas(run, FIT_SCHEMA)


def holm(tests: DataFrame, family: list[str], p: str, order: list[str], out: str = "holm_p", digits: int | None = None) -> DataFrame:
    """Step-down correction without a running maximum; p may be rounded before it is ranked."""
    value = F.round(p, digits) if digits is not None else F.col(p)
    tests = tests.withColumn("_p", value)
    group = Window.partitionBy(*family)
    rank = F.row_number().over(group.orderBy(F.col("_p").asc_nulls_last(), *order))
    m = F.count("_p").over(group)
    return tests.withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.col("_p") * (m - rank + 1)))).drop("_p")


def signed_rank(pairs: DataFrame, group: list[str], diff: str) -> DataFrame:
    """W+, W-, pairs, zeros and the tie term of a signed-rank test, from counts of distinct differences."""
    counted = pairs.groupBy(*group, F.abs(diff).alias("_a")).agg(
        F.count(F.lit(1)).alias("_t"), F.count_if(F.col(diff) > 0).alias("_up")
    )
    nonzero = counted.filter("_a > 0")
    order = Window.partitionBy(*group).orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)
    mean_rank = F.sum("_t").over(order) - (F.col("_t") - 1) / 2
    ranked = nonzero.withColumn("_r", mean_rank)
    w = ranked.groupBy(*group).agg(
        F.sum(F.col("_r") * F.col("_up")).alias("w_plus"), F.sum(F.col("_r") * (F.col("_t") - F.col("_up"))).alias("w_minus"),
        F.sum("_t").alias("n_pairs"), F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("ties"),
    )
    zeros = counted.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("_a") == 0, F.col("_t"))), F.lit(0)).alias("zeros"))
    return zeros.join(w, group, "left")


def _signed_rank_p(w: float, n: int, ties: int, zeros: int) -> float:
    if not n:
        return 1.0
    if n <= 50 and not ties and not zeros:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r].copy()
        return min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(w - n * (n + 1) / 4) / spread / math.sqrt(2)) if spread else 1.0


@F.pandas_udf(T.DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    """Two-sided p: exact for up to fifty untied pairs, else normal with the tie term."""
    filled = zip(w.fillna(0), n.fillna(0), ties.fillna(0), zeros.fillna(0))
    return pd.Series([_signed_rank_p(float(a), int(b), int(c), int(d)) for a, b, c, d in filled], dtype=float)


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact p of a 2x2 table: all tables with the same margins that are no likelier."""
    def one(a: int, b: int, c: int, d: int) -> float:
        lg = math.lgamma
        row, col, total = a + b, a + c, a + b + c + d
        fixed = lg(row + 1) + lg(total - row + 1) + lg(col + 1) + lg(total - col + 1) - lg(total + 1)
        lo, hi = max(0, row + col - total), min(row, col)
        k = np.arange(lo, hi + 1)
        logp = np.array([fixed - lg(i + 1) - lg(row - i + 1) - lg(col - i + 1) - lg(total - row - col + i + 1) for i in k])
        return float(min(1.0, np.exp(logp[logp <= logp[a - lo] + 1e-7]).sum()))

    return pd.Series([one(*map(int, r)) for r in zip(a, b, c, d)], dtype=float)


def draw_weights(spark: SparkSession, clusters: DataFrame, key: str, seed: int, draws: int) -> DataFrame:
    """(draw, key, weight): how often each cluster enters each resample, the same draws for every contrast.

    A draw picks as many clusters as there are. Each slot's pick is an md5 of
    (seed, draw, slot), so any engine can redo it. ``clusters`` is numbered by
    rank, and slots are made per cluster row, not on the driver.
    """
    from plumbline.operators.skew import number_rows

    numbered = number_rows(clusters.select(key).distinct(), [key], "_i").withColumn("_i", F.col("_i") - 1)
    m = numbered.agg(F.count(F.lit(1)).alias("_m"))
    slots = numbered.select(F.col("_i").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    pick = F.conv(F.left(F.md5(F.concat_ws("-", F.lit(str(seed)), "draw", "slot")), F.lit(8)), 16, 10).cast("long")
    picked = slots.crossJoin(F.broadcast(m)).select("draw", (pick % F.col("_m")).alias("_i"))  # one row
    weights = picked.groupBy("draw", "_i").agg(F.count(F.lit(1)).alias("weight"))
    return weights.join(numbered, "_i").select("draw", key, "weight")


def index_percentile(values: DataFrame, group: list[str], value: str, share: float, out: str) -> DataFrame:
    """The element at position int(share * n) of the sorted values."""
    order = Window.partitionBy(*group).orderBy(value)
    ranked = values.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(value).over(Window.partitionBy(*group)))
    return ranked.filter(F.col("_i") == F.floor(F.lit(share) * F.col("_n"))).select(*group, F.col(value).alias(out))


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    """Chance-corrected agreement of two raters from the four counts."""
    n = both + only_a + only_b + neither
    observed = (both + neither) / n
    chance = ((both + only_a) * (both + only_b) + (only_b + neither) * (only_a + neither)) / (n * n)
    return F.try_divide(observed - chance, 1 - chance)


DRAWS_A_TASK = 20
SURVIVAL_SCHEMA = "model string, term string, hit boolean, odds double"


def reclassification_survival(stats: DataFrame, shares: dict[str, float], draws: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """How often a contrast survives when failed quotations are removed at random with a given share per condition.

    Rows of a cell are exchangeable, so the number removed from a cell is one
    binomial draw on its count of failures. The correction is taken within the
    model's contrasts. Draws are dealt over tasks, each with its own seed.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, first = pdf["model"].iloc[0], int(pdf["_first"].iloc[0])
        pdf = pdf.drop(columns="_first").sort_values(["kind", "matter", "condition"], kind="stable")
        share = pdf["condition"].map(shares).fillna(0.0).to_numpy()
        failed = (pdf["n"] - pdf["s"]).to_numpy()
        rows = []
        for draw in range(first, min(first + DRAWS_A_TASK, draws)):
            rng = np.random.default_rng([seed, draw, *model.encode()])
            d = pdf.assign(n=pdf["n"] - rng.binomial(failed, share))
            fit = _fit_group(d[d["n"] > 0], CONTRASTS, [], None).sort_values("p", kind="stable")
            for i, (term, p, odds) in enumerate(zip(fit["term"], fit["p"], fit["odds_ratio"])):
                fitted = p is not None and not pd.isna(p)
                rows.append((model, term, bool(fitted and min(1.0, p * (len(fit) - i)) < alpha), odds if fitted else None))
        return pd.DataFrame(rows, columns=["model", "term", "hit", "odds"])

    firsts = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_A_TASK))).alias("_first")
    dealt = stats.select("*", firsts).repartition(stats.sparkSession.sparkContext.defaultParallelism, "model", "_first")  # few bytes, long fits
    each = dealt.groupBy("model", "_first").applyInPandas(run, SURVIVAL_SCHEMA)
    return each.groupBy("model", "term").agg(
        (F.count_if("hit") / draws).alias("survival"), F.percentile("odds", 0.5).alias("median_or"), F.lit(draws).cast("long").alias("draws")
    )
