"""Statistical kernels against row-level restatements and known values."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import rates as R
from plumbline.operators import inference as I


def row_level_gee(x, y, groups, rounds=100):
    """Exchangeable logistic estimating equations with the full correlation matrix of every cluster."""
    beta, alpha, p = np.zeros(x.shape[1]), 0.0, x.shape[1]
    ids = np.unique(groups)
    for _ in range(rounds):
        hess, meat, score = np.zeros((p, p)), np.zeros((p, p)), np.zeros(p)
        resid = {}
        for g in ids:
            xg, yg = x[groups == g], y[groups == g]
            mu = 1 / (1 + np.exp(-xg @ beta))
            sd = np.sqrt(mu * (1 - mu))
            corr = np.full((len(yg), len(yg)), alpha)
            np.fill_diagonal(corr, 1)
            vinv = np.linalg.inv(sd[:, None] * corr * sd[None, :])
            d = (sd**2)[:, None] * xg
            q = d.T @ vinv @ (yg - mu)
            hess, meat, score = hess + d.T @ vinv @ d, meat + np.outer(q, q), score + q
            resid[g] = (yg - mu) / sd
        step = np.linalg.solve(hess, score)
        beta = beta + step
        scale = sum((r**2).sum() for r in resid.values()) / (len(y) - p)
        pairs = sum(len(r) * (len(r) - 1) / 2 for r in resid.values())
        alpha = sum((r.sum() ** 2 - (r**2).sum()) / 2 for r in resid.values()) / scale / (pairs - p)
        if np.abs(step).max() < 1e-9:
            break
    return beta, np.linalg.inv(hess) @ meat @ np.linalg.inv(hess)


def simulated(seed=5, matters=20):
    r = np.random.default_rng(seed)
    rows = []
    for m, c in itertools.product(range(matters), ["baseline", *I.CONTRASTS]):
        for _ in range(r.integers(1, 9)):
            p = 1 / (1 + math.exp(-(0.4 + 0.5 * (m % 3) - 0.6 * (c == "combo"))))
            rows.append(("m", "quote", m, c, int(r.random() < p)))
    return pd.DataFrame(rows, columns=["model", "kind", "matter", "condition", "y"])


def test_grouped_fit_equals_row_level_fit(spark):
    df = simulated()
    x = np.column_stack([np.ones(len(df)), *[(df.condition == c).to_numpy(float) for c in I.CONTRASTS]])
    beta, cov = row_level_gee(x, df.y.to_numpy(float), df.matter.to_numpy())
    fits = {r.term: r for r in I.clustered_fits(I.sufficient(spark.createDataFrame(df), ["model", "kind", "matter", "condition"])).collect()}
    for i, c in enumerate(I.CONTRASTS, 1):
        se = math.sqrt(cov[i, i])
        assert fits[c].odds_ratio == pytest.approx(math.exp(beta[i]), rel=1e-6)
        assert fits[c].ci_low == pytest.approx(math.exp(beta[i] - 1.96 * se), rel=1e-6)
        assert fits[c].p == pytest.approx(math.erfc(abs(beta[i] / se) / math.sqrt(2)), rel=1e-5)
        assert fits[c].n == len(df)


def test_no_variation_yields_null_and_a_note(spark):
    df = simulated().assign(y=1)
    for r in I.clustered_fits(I.sufficient(spark.createDataFrame(df), ["model", "kind", "matter", "condition"])).collect():
        assert r.odds_ratio is None and r.p is None and r.note == "no variation"


def test_holm_has_no_running_maximum(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.021), ("d", None)], "k string, p double").withColumn("g", F.lit(1))
    got = {r.k: r.holm_p for r in I.holm(p, ["g"], "p", ["k"]).collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == pytest.approx(0.04) and got["c"] == pytest.approx(0.021) and got["d"] is None


def test_signed_rank(spark):
    d = [3, -1, 4, 6, -2, 5, 7, 0.5]
    rows = spark.createDataFrame([("g", float(x)) for x in d], "g string, d double")
    w = I.signed_rank(rows, ["g"], "d").first()
    assert (w.w_plus, w.w_minus, w.n_pairs, w.zeros, w.ties) == (31.0, 5.0, 8, 0, 0)
    n, low = 8, 5
    at_most = sum(1 for s in itertools.product([0, 1], repeat=n) if sum(r for r, b in zip(range(1, n + 1), s) if b) <= low)
    assert I._signed_rank_p(5.0, n, 0, 0) == pytest.approx(2 * at_most / 2**n)
    tied = I.signed_rank(spark.createDataFrame([("g", float(x)) for x in [1, -1, 1, 2, 0, 0]], "g string, d double"), ["g"], "d").first()
    assert (tied.w_plus, tied.w_minus, tied.n_pairs, tied.zeros, tied.ties) == (8.0, 2.0, 4, 2, 24)


def test_fisher(spark):
    t = spark.createDataFrame([(3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 0, 7)], "a long, b long, c long, d long")
    p = [r.p for r in t.select(I.fisher_p("a", "b", "c", "d").alias("p")).collect()]
    assert p[0] == pytest.approx(0.4857142857) and p[1] == pytest.approx(0.034965035) and p[2] == pytest.approx(1.0)


def test_wilson_and_kappa(spark):
    r = spark.range(1).select(R.wilson(F.lit(8), F.lit(40), 1).alias("hi"), R.wilson(F.lit(8), F.lit(40), -1).alias("lo"),
                              I.kappa(*[F.lit(float(v)) for v in (20, 5, 10, 15)]).alias("k")).first()
    assert r.hi == pytest.approx(0.347554, abs=1e-3) and r.lo == pytest.approx(0.104930, abs=1e-3) and r.k == pytest.approx(0.4)


def test_draws_resample_as_many_as_there_are(spark):
    m = spark.range(12).select((F.col("id") * 5).alias("matter"))
    w = I.draw_weights(spark, m, "matter", 1, 9).groupBy("draw").agg(F.sum("weight").alias("n")).collect()
    assert len(w) == 9 and {r.n for r in w} == {12}


def test_survival_is_one_without_removal(spark):
    df = simulated(3, 40)
    stats = I.sufficient(spark.createDataFrame(df), ["model", "kind", "matter", "condition"])
    fit = {r.term: r.holm_p for r in I.holm(I.clustered_fits(stats), ["model"], "p", ["term"]).collect()}
    for r in I.reclassification_survival(stats, {}, 3, 1).collect():
        assert r.survival == float(fit[r.term] < 0.05)


def test_queries_take_the_draws_of_the_reference(spark, folder):
    from plumbline.plans import registry

    q = registry.queries()
    assert max(r.draws for r in q["cluster_bootstrap"](spark, folder).collect()) == 2000  # a draw may miss all matters of a sparse contrast
    got = q["reclassification_survival"](spark, folder).collect()
    assert {r.draws for r in got} == {200} and len({(r.model, r.term) for r in got}) == len(got)


def test_survival_does_not_depend_on_the_order_of_rows(spark):
    stats = I.sufficient(spark.createDataFrame(simulated(3, 40)), ["model", "kind", "matter", "condition"])
    shares = dict.fromkeys(I.CONTRASTS, 0.3)
    one, two = (sorted(map(tuple, I.reclassification_survival(s, shares, 45, 7).collect())) for s in (stats, stats.orderBy(F.rand(1))))
    assert one == two and {r[4] for r in one} == {45}
