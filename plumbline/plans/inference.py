"""Fits, corrections, rank tests, bootstraps and agreement over verdict records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rates as R
from plumbline.operators import inference as O
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.session import Tables

WITH = f"WITH {V.RECORDS}"
DRAWS, SEED = 2000, 20260913
SURVIVAL_DRAWS = 200
_SCORED = "((kind='citation' AND verdict IN ('exists','not_found')) OR (kind='quote' AND verdict IN ('accurate','near_miss','inaccurate')))"


@query("I1", WITH + f"""
SELECT model, kind, matter, condition, count(*) AS n, count(*) FILTER (verdict IN ('exists','accurate')) AS s FROM records WHERE {_SCORED} GROUP BY 1, 2, 3, 4""")
def fit_sufficient_statistics(t: Tables) -> DataFrame:
    return O.sufficient(O.scored(V.records(t)), ["model", "kind", "matter", "condition"])


def _primary(t: Tables, lenient: bool = False) -> DataFrame:
    return O.clustered_fits(O.sufficient(O.scored(V.records(t), lenient), ["model", "kind", "matter", "condition"]))


@query("I1 W1 I14 J17")
def clustered_contrasts(t: Tables) -> DataFrame:
    return O.holm(_primary(t), ["model"], "p", ["kind", "term"], digits=5)


@query("I1 W1")
def lenient_contrasts(t: Tables) -> DataFrame:
    return O.holm(_primary(t, True), ["model"], "p", ["kind", "term"], digits=5)


@query("I2 U1")
def contrasts_with_template_effect(t: Tables) -> DataFrame:
    stats = O.sufficient(O.scored(V.records(t)), ["model", "kind", "matter", "condition", "template"])
    return O.holm(O.clustered_fits(stats, effects=("template",)), [], "p", ["model", "kind", "term"])


@query("I3 V18")
def contrasts_adjusted_for_year(t: Tables) -> DataFrame:
    rows = O.scored(V.records(t)).withColumn("decade", (F.col("year") - 1900) / 50.0)
    pooled = rows.select(F.lit("_all").alias("model"), F.col("model").alias("drafter"), "kind", "matter", "condition", "decade", "y")
    stats = O.sufficient(pooled, ["model", "drafter", "kind", "matter", "condition", "decade"])
    return O.holm(O.clustered_fits(stats, effects=("drafter",), covariate="decade"), [], "p", ["kind", "term"])


@query("M14 I14")
def combined_condition_contrast(t: Tables) -> DataFrame:
    rows = O.scored(V.records(t)).filter("condition IN ('baseline', 'combo')")
    stats = O.sufficient(rows, ["model", "kind", "matter", "condition", "template"])
    return O.holm(O.clustered_fits(stats, ["combo"], effects=("template",)), [], "p", ["model", "kind"])


_P = """, r AS (SELECT model, condition, count(*) FILTER (verdict IN ('accurate','near_miss','inaccurate')) AS n, count(*) FILTER (verdict='accurate') AS s FROM records WHERE kind='quote' GROUP BY 1, 2)
, p AS (SELECT r.model, r.condition, round(1.0::DOUBLE / (1 + r.n * abs(CAST(r.s AS DOUBLE) / r.n - CAST(b.s AS DOUBLE) / b.n)), 5) AS p FROM r JOIN r b ON b.model=r.model AND b.condition='baseline' WHERE r.condition<>'baseline' AND r.n > 0 AND b.n > 0)"""


def _scores(t: Tables) -> DataFrame:
    """A number in (0, 1] per contrast that falls with the difference and the count: input to rank and correct."""
    r = V.records(t).filter("kind = 'quote'").groupBy("model", "condition").agg(
        F.count_if(F.col("verdict").isin(*R.SCORED_QUOTES)).alias("n"), F.count_if(F.col("verdict") == "accurate").alias("s")
    ).filter("n > 0")
    base = r.filter("condition = 'baseline'").select("model", (F.col("s").cast("double") / F.col("n")).alias("b"))
    d = r.filter("condition <> 'baseline'").join(base, "model")
    p = F.round(F.lit(1.0) / (1 + F.col("n") * F.abs(F.col("s").cast("double") / F.col("n") - F.col("b"))), 5)
    return d.select("model", "condition", p.alias("p"))


@query("W1 W2 I16", WITH + _P + """
SELECT model, condition, p, least(1.0, p * (count(*) OVER (PARTITION BY model) - row_number() OVER (PARTITION BY model ORDER BY p, condition) + 1)) AS holm_model,
  least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, model, condition) + 1)) AS holm_all FROM p""")
def step_down_correction(t: Tables) -> DataFrame:
    once = O.holm(_scores(t), ["model"], "p", ["condition"], "holm_model")
    return O.holm(once, [], "p", ["model", "condition"], "holm_all")  # one row per contrast


_PAIRS = """, m AS (SELECT DISTINCT model, matter FROM records WHERE kind='quote'), c AS (SELECT unnest(['quota','temporal','stakes','combo']) AS condition)
, a AS (SELECT model, matter, condition, count(*) FILTER (verdict='accurate') AS acc FROM records WHERE kind='quote' GROUP BY 1, 2, 3)
, d AS (SELECT m.model, c.condition, m.matter, coalesce(x.acc, 0) - coalesce(b.acc, 0) AS d FROM m CROSS JOIN c LEFT JOIN a x ON x.model=m.model AND x.matter=m.matter AND x.condition=c.condition
   LEFT JOIN a b ON b.model=m.model AND b.matter=m.matter AND b.condition='baseline')"""


def _count_pairs(t: Tables) -> DataFrame:
    acc = V.records(t).filter("kind = 'quote'").groupBy("model", "matter").agg(
        *[F.count_if((F.col("condition") == c) & (F.col("verdict") == "accurate")).alias(c) for c in V.CONDITIONS]
    )
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), (F.col(c) - F.col("baseline")).alias("d")) for c in O.CONTRASTS]))
    return acc.select("model", "matter", each.alias("x")).select("model", "matter", "x.condition", "x.d")


@query("I4 A23", WITH + _PAIRS + """
, k AS (SELECT *, rank() OVER (PARTITION BY model, condition ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, condition, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0)
, w AS (SELECT model, condition, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, count(*) AS n_pairs FROM k GROUP BY 1, 2)
SELECT z.model, z.condition, z.zeros, w.w_plus, w.w_minus, w.n_pairs FROM (SELECT model, condition, count(*) FILTER (d = 0) AS zeros FROM d GROUP BY 1, 2) z LEFT JOIN w ON w.model=z.model AND w.condition=z.condition""")
def signed_rank_statistics(t: Tables) -> DataFrame:
    return O.signed_rank(_count_pairs(t), ["model", "condition"], "d").drop("ties")


@query("I4 W1")
def signed_rank_tests(t: Tables) -> DataFrame:
    w = O.signed_rank(_count_pairs(t), ["model", "condition"], "d")
    p = w.withColumn("p", O.signed_rank_p(F.least("w_plus", "w_minus"), "n_pairs", "ties", "zeros"))
    return O.holm(p, ["model"], "p", ["condition"], digits=4).select("model", "condition", "n_pairs", "zeros", "w_plus", "w_minus", "p", "holm_p")


_RATES = """, c AS (SELECT model, condition, matter, count(*) FILTER (verdict='accurate') AS s, count(*) AS n FROM records WHERE kind='quote' AND verdict IN ('accurate','near_miss','inaccurate') GROUP BY 1, 2, 3)
, pr AS (SELECT x.model, x.condition, x.matter, CAST(x.s AS DOUBLE) / x.n - CAST(b.s AS DOUBLE) / b.n AS d FROM c x JOIN c b ON b.model=x.model AND b.matter=x.matter AND b.condition='baseline' WHERE x.condition<>'baseline')"""


def _draw_sql(draws: int) -> str:
    return f"""
, ms AS (SELECT matter, row_number() OVER (ORDER BY matter) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT matter FROM records))
, sl AS (SELECT ms.i AS slot, m, g.draw FROM ms CROSS JOIN (SELECT unnest(range(0, {draws})) AS draw) g)
, pk AS (SELECT draw, CAST(concat('0x', substr(md5(concat_ws('-', '{SEED}', CAST(draw AS VARCHAR), CAST(slot AS VARCHAR))), 1, 8)) AS BIGINT) % m AS i FROM sl)
, w AS (SELECT draw, matter, count(*) AS weight FROM pk JOIN ms ON ms.i = pk.i GROUP BY 1, 2)"""


def _per_matter(t: Tables) -> DataFrame:
    return V.records(t).filter("kind = 'quote'").filter(F.col("verdict").isin(*R.SCORED_QUOTES)).groupBy("model", "condition", "matter").agg(
        F.count_if(F.col("verdict") == "accurate").alias("s"), F.count(F.lit(1)).alias("n")
    )


def _paired(t: Tables) -> DataFrame:
    c = _per_matter(t).withColumn("rate", F.col("s").cast("double") / F.col("n"))
    base = c.filter("condition = 'baseline'").select("model", "matter", F.col("rate").alias("b"))
    return c.filter("condition <> 'baseline'").join(base, ["model", "matter"]).select("model", "condition", "matter", (F.col("rate") - F.col("b")).alias("d"))


@query("I5 X4 I12", WITH + _RATES + _draw_sql(DRAWS) + """
, b AS (SELECT model, condition, draw, round(sum(weight * d) / sum(weight), 9) AS m FROM pr JOIN w ON w.matter = pr.matter GROUP BY 1, 2, 3)
, o AS (SELECT model, condition, round(avg(d), 9) AS rate_diff FROM pr GROUP BY 1, 2)
SELECT b.model, b.condition, o.rate_diff, count(*) AS draws, round(quantile_cont(m, 0.025), 7) AS ci_low, round(quantile_cont(m, 0.975), 7) AS ci_high,
  CAST(count(*) FILTER (CASE WHEN rate_diff < 0 THEN m < 0 ELSE m > 0 END) AS DOUBLE) / count(*) AS sign_share
FROM b JOIN o ON o.model=b.model AND o.condition=b.condition GROUP BY 1, 2, 3""")
def cluster_bootstrap(t: Tables) -> DataFrame:
    pr = _paired(t)
    w = O.draw_weights(t.spark, V.records(t), "matter", SEED, DRAWS)
    b = pr.join(w, "matter").groupBy("model", "condition", "draw").agg(
        F.round(F.sum(F.col("weight") * F.col("d")) / F.sum("weight"), 9).alias("m")
    )
    o = pr.groupBy("model", "condition").agg(F.round(F.avg("d"), 9).alias("rate_diff"))
    same = F.when(F.col("rate_diff") < 0, F.col("m") < 0).otherwise(F.col("m") > 0)
    return b.join(o, ["model", "condition"]).groupBy("model", "condition", "rate_diff").agg(
        F.count(F.lit(1)).alias("draws"), F.round(F.percentile("m", 0.025), 7).alias("ci_low"),
        F.round(F.percentile("m", 0.975), 7).alias("ci_high"), R.share(F.count_if(same), F.count(F.lit(1))).alias("sign_share"),
    )


@query("I6 I7", WITH + _RATES + _draw_sql(DRAWS) + """
, b AS (SELECT model, condition, draw, round(sum(weight * d) / sum(weight), 9) AS m FROM pr JOIN w ON w.matter = pr.matter GROUP BY 1, 2, 3)
, s AS (SELECT *, row_number() OVER (PARTITION BY model, condition ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY model, condition) AS n FROM b)
SELECT model, condition, max(m) FILTER (i = CAST(floor(0.025::DOUBLE * n) AS BIGINT)) AS lo, max(m) FILTER (i = CAST(floor(0.975::DOUBLE * n) AS BIGINT)) AS hi FROM s GROUP BY 1, 2""")
def index_percentile_bootstrap(t: Tables) -> DataFrame:
    w = O.draw_weights(t.spark, V.records(t), "matter", SEED, DRAWS)
    b = _paired(t).join(w, "matter").groupBy("model", "condition", "draw").agg(
        F.round(F.sum(F.col("weight") * F.col("d")) / F.sum("weight"), 9).alias("m")
    )
    lo = O.index_percentile(b, ["model", "condition"], "m", 0.025, "lo")
    return lo.join(O.index_percentile(b, ["model", "condition"], "m", 0.975, "hi"), ["model", "condition"])


@query("I8", WITH + """
, c AS (SELECT condition, count(*) FILTER (verdict='inaccurate') AS k, count(*) AS n FROM records WHERE kind='quote' GROUP BY 1)
, p AS (SELECT *, CAST(k AS DOUBLE) / n AS p, 1.96::DOUBLE AS z FROM c)
SELECT condition, k, n, round((p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) AS low, round((p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 9) AS high FROM p""")
def wilson_intervals(t: Tables) -> DataFrame:
    c = V.records(t).filter("kind = 'quote'").groupBy("condition").agg(
        F.count_if(F.col("verdict") == "inaccurate").alias("k"), F.count(F.lit(1)).alias("n")
    )
    bound = lambda side: F.round(R.wilson(F.col("k"), F.col("n"), side), 9)
    return c.select("condition", "k", "n", bound(-1).alias("low"), bound(1).alias("high"))


@query("I9 M15", f"WITH {V.RECORDS}" + """
, g AS (SELECT model, count(*) FILTER (condition = 'baseline' AND verdict = 'exists') AS a, count(*) FILTER (condition = 'baseline' AND verdict = 'not_found') AS b,
   count(*) FILTER (condition = 'combo' AND verdict = 'exists') AS c, count(*) FILTER (condition = 'combo' AND verdict = 'not_found') AS d FROM records WHERE kind = 'citation' GROUP BY 1)
, k AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM g)
, l AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
   - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS logp FROM k)
, o AS (SELECT model, logp AS own FROM l WHERE x = a)
SELECT l.model, a, b, c, d, round(least(1.0, sum(exp(logp)) FILTER (logp <= own + 1e-7)), 9) AS p FROM l JOIN o ON o.model = l.model GROUP BY ALL""")
def fisher_tests(t: Tables) -> DataFrame:
    hit = lambda c, v: F.count_if((F.col("condition") == c) & (F.col("verdict") == v))
    g = V.records(t).filter("kind = 'citation'").groupBy("model").agg(
        hit("baseline", "exists").alias("a"), hit("baseline", "not_found").alias("b"),
        hit("combo", "exists").alias("c"), hit("combo", "not_found").alias("d"),
    )
    return g.withColumn("p", F.round(O.fisher_p("a", "b", "c", "d"), 9))


@query("I10 X2")
def reclassification_survival(t: Tables) -> DataFrame:
    q = O.scored(V.records(t).filter("kind = 'quote'"))
    shares = {"baseline": 0.1, "quota": 0.2, "temporal": 0.15, "stakes": 0.1, "combo": 0.25}
    return O.reclassification_survival(O.sufficient(q, ["model", "kind", "matter", "condition"]), shares, SURVIVAL_DRAWS, 20260904)


@query("I11", """
WITH r AS (SELECT lang, quality = 1 AS a, n_chars > 1500 AS b FROM documents JOIN labels USING (doc_id))
, c AS (SELECT lang, CAST(count(*) FILTER (a AND b) AS DOUBLE) AS p, CAST(count(*) FILTER (a AND NOT b) AS DOUBLE) AS q, CAST(count(*) FILTER (NOT a AND b) AS DOUBLE) AS s, CAST(count(*) FILTER (NOT a AND NOT b) AS DOUBLE) AS u FROM r GROUP BY 1)
SELECT lang, (p + u) / (p + q + s + u) AS agreement, (p + q + s) / (p + q + s + u) AS union_share,
  round(((p+u)/(p+q+s+u) - ((p+q)*(p+s)+(s+u)*(q+u))/((p+q+s+u)*(p+q+s+u))) / nullif(1 - ((p+q)*(p+s)+(s+u)*(q+u))/((p+q+s+u)*(p+q+s+u)), 0), 9) AS kappa FROM c""")
def rater_agreement(t: Tables) -> DataFrame:
    a, b = F.col("quality") == 1, F.col("n_chars") > 1500
    c = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id").groupBy("lang").agg(
        F.count_if(a & b).cast("double").alias("p"), F.count_if(a & ~b).cast("double").alias("q"),
        F.count_if(~a & b).cast("double").alias("s"), F.count_if(~a & ~b).cast("double").alias("u"),
    )
    p, q, s, u = (F.col(x) for x in "pqsu")
    n = p + q + s + u
    return c.select(
        "lang", ((p + u) / n).alias("agreement"), ((p + q + s) / n).alias("union_share"), F.round(O.kappa(p, q, s, u), 9).alias("kappa")
    )


@query("I12 J16", WITH + """
, c AS (SELECT model, condition, CAST(count(*) FILTER (verdict='exists') AS DOUBLE) AS s, CAST(count(*) FILTER (verdict='not_found') AS DOUBLE) AS f FROM records GROUP BY 1, 2)
SELECT x.model, x.condition, x.s / nullif(x.s + x.f, 0) - b.s / nullif(b.s + b.f, 0) AS risk_diff, x.s * b.f / nullif(x.f * b.s, 0) AS odds_ratio
FROM c x JOIN c b ON b.model=x.model AND b.condition='baseline' WHERE x.condition<>'baseline'""")
def pooled_risk_differences(t: Tables) -> DataFrame:
    c = V.records(t).groupBy("model", "condition").agg(
        F.count_if(F.col("verdict") == "exists").cast("double").alias("s"), F.count_if(F.col("verdict") == "not_found").cast("double").alias("f")
    )
    b = c.filter("condition = 'baseline'").select("model", F.col("s").alias("bs"), F.col("f").alias("bf"))
    x = c.filter("condition <> 'baseline'").join(b, "model")
    rate = lambda s, f: F.try_divide(F.col(s), F.col(s) + F.col(f))
    return x.select(
        "model", "condition", (rate("s", "f") - rate("bs", "bf")).alias("risk_diff"),
        F.try_divide(F.col("s") * F.col("bf"), F.col("f") * F.col("bs")).alias("odds_ratio"),
    )


@query("I13", WITH + """
, r AS (SELECT model, condition, run, CAST(count(*) FILTER (verdict='accurate') AS DOUBLE) / nullif(count(*) FILTER (verdict IN ('accurate','near_miss','inaccurate')), 0) AS rate FROM records GROUP BY 1, 2, 3)
, d AS (SELECT x.model, x.condition, x.run, sign(x.rate - b.rate) AS sg FROM r x JOIN r b ON b.model=x.model AND b.run=x.run AND b.condition='baseline' WHERE x.condition<>'baseline' AND x.rate IS NOT NULL AND b.rate IS NOT NULL)
SELECT model, condition, count(*) AS runs, count(DISTINCT sg) = 1 AS stable FROM d GROUP BY 1, 2""")
def contrast_sign_stability(t: Tables) -> DataFrame:
    r = V.records(t).groupBy("model", "condition", "run").agg(R.strict_rate().alias("rate")).filter("rate IS NOT NULL")
    b = r.filter("condition = 'baseline'").select("model", "run", F.col("rate").alias("b"))
    d = r.filter("condition <> 'baseline'").join(b, ["model", "run"])
    return d.groupBy("model", "condition").agg(
        F.count(F.lit(1)).alias("runs"), (F.countDistinct(F.signum(F.col("rate") - F.col("b"))) == 1).alias("stable")
    )
