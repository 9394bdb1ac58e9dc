"""Cell counts, rates and pooled totals over verdict records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import citations as C
from plumbline.functions import rates as R
from plumbline.operators import cells as O
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.session import Tables, union_all

WITH = f"WITH {V.RECORDS} "
SCORED = "('accurate','near_miss','inaccurate')"
CELL = ["model", "condition"]


@query("A1 A2 A4 S3", WITH + f"""
SELECT model, condition,
  count(*) FILTER (kind='citation' AND verdict='exists') AS exists_n,
  count(*) FILTER (kind='citation' AND verdict='not_found') AS not_found_n,
  count(*) FILTER (kind='citation' AND verdict='unresolvable') AS unresolvable_n,
  count(*) FILTER (kind='quote' AND verdict='accurate') AS accurate_n,
  count(*) FILTER (kind='quote' AND verdict='near_miss') AS near_miss_n,
  count(*) FILTER (kind='quote' AND verdict='inaccurate') AS inaccurate_n,
  count(*) FILTER (kind='quote' AND verdict='unverifiable') AS unverifiable_n,
  count(*) FILTER (kind='quote' AND verdict='unpaired') AS unpaired_n,
  CAST(count(*) FILTER (kind='citation' AND verdict='exists') AS DOUBLE)
    / nullif(count(*) FILTER (kind='citation' AND verdict IN ('exists','not_found')), 0) AS existence_rate,
  CAST(count(*) FILTER (kind='quote' AND verdict='accurate') AS DOUBLE)
    / nullif(count(*) FILTER (kind='quote' AND verdict IN {SCORED}), 0) AS strict_rate
FROM records GROUP BY 1, 2""")
def cell_counts(t: Tables) -> DataFrame:
    return O.cell_table(V.records(t), CELL)


@query("A3 A8", WITH + f"""
SELECT model, condition,
  CAST(count(*) FILTER (verdict='accurate') AS DOUBLE)
    / nullif(count(*) FILTER (verdict IN ('accurate','inaccurate')), 0) AS first_edition_rate,
  CAST(count(*) FILTER (verdict IN ('accurate','near_miss')) AS DOUBLE)
    / nullif(count(*) FILTER (verdict IN {SCORED}), 0) AS lenient_rate,
  CAST(count(*) FILTER (verdict='near_miss') AS DOUBLE)
    / nullif(count(*) FILTER (verdict IN {SCORED}), 0) AS near_miss_share,
  CAST(count(*) FILTER (verdict='near_miss') AS DOUBLE) / nullif(count(*) FILTER (kind='quote'), 0) AS near_miss_rate,
  CAST(count(*) FILTER (verdict='unverifiable') AS DOUBLE) / nullif(count(*) FILTER (kind='quote'), 0) AS unverifiable_rate,
  CAST(count(*) FILTER (verdict='unresolvable') AS DOUBLE) / nullif(count(*) FILTER (kind='citation'), 0) AS unresolvable_rate
FROM records GROUP BY 1, 2""")
def cell_shares(t: Tables) -> DataFrame:
    v = lambda *names: F.count_if(F.col("verdict").isin(*names))
    quoted, cited = F.count_if(F.col("kind") == "quote"), F.count_if(F.col("kind") == "citation")
    return V.records(t).groupBy(*CELL).agg(
        R.first_edition_rate().alias("first_edition_rate"),
        R.lenient_rate().alias("lenient_rate"),
        R.share(v("near_miss"), v(*R.SCORED_QUOTES)).alias("near_miss_share"),
        R.share(v("near_miss"), quoted).alias("near_miss_rate"),
        R.share(v("unverifiable"), quoted).alias("unverifiable_rate"),
        R.share(v("unresolvable"), cited).alias("unresolvable_rate"),
    )


@query("A5", WITH + """
, n AS (SELECT model, kind, verdict, count(*) AS c FROM records GROUP BY 1, 2, 3)
SELECT model, kind, string_agg(concat(verdict, '=', CAST(c AS VARCHAR)), ',' ORDER BY verdict) AS tally
FROM n GROUP BY 1, 2""")
def verdict_tally(t: Tables) -> DataFrame:
    return O.tally(V.records(t), ["model", "kind"], "verdict")


@query("A7", WITH + """
SELECT model, condition, kind,
  count(*) FILTER (verdict='exists') AS exists, count(*) FILTER (verdict='not_found') AS not_found,
  count(*) FILTER (verdict='unresolvable') AS unresolvable, count(*) FILTER (verdict='accurate') AS accurate,
  count(*) FILTER (verdict='near_miss') AS near_miss, count(*) FILTER (verdict='inaccurate') AS inaccurate,
  count(*) FILTER (verdict='unverifiable') AS unverifiable, count(*) FILTER (verdict='unpaired') AS unpaired
FROM records GROUP BY 1, 2, 3""")
def raw_counts_pivot(t: Tables) -> DataFrame:
    verdicts = ["exists", "not_found", "unresolvable", "accurate", "near_miss", "inaccurate", "unverifiable", "unpaired"]
    wide = V.records(t).groupBy("model", "condition", "kind").pivot("verdict", verdicts).count()
    return wide.na.fill(0, verdicts)


@query("A6 A20", WITH + """
, drafts AS (SELECT model, condition, matter,
    count(*) FILTER (kind='citation') AS cites,
    count(*) FILTER (verdict='exists') AS ok, count(*) FILTER (verdict='not_found') AS bad
  FROM records GROUP BY 1, 2, 3)
SELECT condition, count(*) AS drafts, count(*) FILTER (cites = 0) AS abstained,
  CAST(sum(cites) AS BIGINT) AS citations_total,
  CAST(sum(ok) AS DOUBLE) / nullif(CAST(sum(ok + bad) AS DOUBLE), 0) AS existence_micro,
  round(avg(CAST(ok AS DOUBLE) / nullif(ok + bad, 0)), 9) AS existence_macro
FROM drafts GROUP BY 1""")
def draft_to_condition_rollup(t: Tables) -> DataFrame:
    drafts = V.records(t).groupBy(*CELL, "matter").agg(
        F.count_if(F.col("kind") == "citation").alias("cites"),
        F.count_if(F.col("verdict") == "exists").alias("ok"),
        F.count_if(F.col("verdict") == "not_found").alias("bad"),
    )
    return drafts.groupBy("condition").agg(
        F.count(F.lit(1)).alias("drafts"),
        F.count_if(F.col("cites") == 0).alias("abstained"),
        F.sum("cites").alias("citations_total"),
        R.share(F.sum("ok"), F.sum(F.col("ok") + F.col("bad"))).alias("existence_micro"),
        F.round(F.avg(R.share(F.col("ok"), F.col("ok") + F.col("bad"))), 9).alias("existence_macro"),
    )


@query("A9", WITH + f"""
SELECT coalesce(model, '_all') AS model, coalesce(condition, '_all') AS condition,
  count(*) FILTER (verdict='exists') AS exists_n, count(*) FILTER (verdict='not_found') AS not_found_n,
  count(*) FILTER (verdict IN {SCORED}) AS scored_n
FROM records GROUP BY GROUPING SETS ((model, condition), (model), ())""")
def cells_with_totals(t: Tables) -> DataFrame:
    v = lambda *names: F.count_if(F.col("verdict").isin(*names))
    return O.with_totals(
        V.records(t), CELL,
        {"exists_n": v("exists"), "not_found_n": v("not_found"), "scored_n": v(*R.SCORED_QUOTES)},
    )


_FAMILY = """CASE replace(replace(reporter,' ',''),'.','') WHEN 'US' THEN 'us' WHEN 'F3d' THEN 'federal'
  WHEN 'F2d' THEN 'federal' WHEN 'FSupp2d' THEN 'federal' WHEN 'SCt' THEN 'sct_led' WHEN 'LEd2d' THEN 'sct_led'
  WHEN 'CalApp4th' THEN 'state' ELSE 'other' END"""


@query("A10 F19", WITH + f"""
, g AS (SELECT {_FAMILY} AS family, verdict FROM records WHERE kind='citation')
SELECT coalesce(family, '_all') AS family, count(*) FILTER (verdict='exists') AS exists_n,
  count(*) FILTER (verdict='not_found') AS not_found_n, count(*) FILTER (verdict='unresolvable') AS unresolvable_n,
  CAST(count(*) FILTER (verdict='exists') AS DOUBLE)
    / nullif(count(*) FILTER (verdict IN ('exists','not_found')), 0) AS existence_rate
FROM g GROUP BY GROUPING SETS ((family), ())
UNION ALL
SELECT '_us_and_federal', count(*) FILTER (verdict='exists'), count(*) FILTER (verdict='not_found'),
  count(*) FILTER (verdict='unresolvable'), CAST(count(*) FILTER (verdict='exists') AS DOUBLE)
    / nullif(count(*) FILTER (verdict IN ('exists','not_found')), 0)
FROM g WHERE family IN ('us','federal')""")
def existence_by_reporter_family(t: Tables) -> DataFrame:
    # one pass over the records; the totals are sums of the five family rows
    per = (
        V.records(t).filter("kind = 'citation'").groupBy(C.reporter_family("reporter").alias("family"))
        .agg(*[F.count_if(F.col("verdict") == v).alias(f"{v}_n") for v in ("exists", "not_found", "unresolvable")])
    )
    sums = [F.sum(f"{v}_n").alias(f"{v}_n") for v in ("exists", "not_found", "unresolvable")]
    labels = F.array(
        F.col("family"), F.lit("_all"), F.when(F.col("family").isin("us", "federal"), F.lit("_us_and_federal"))
    )
    out = per.withColumn("family", F.explode(F.filter(labels, lambda x: x.isNotNull()))).groupBy("family").agg(*sums)
    return out.withColumn("existence_rate", R.share(F.col("exists_n"), F.col("exists_n") + F.col("not_found_n")))


@query("A11 A20", WITH + f"""
, d AS (SELECT model, condition, matter, CAST(count(*) FILTER (verdict='accurate') AS DOUBLE)
    / nullif(count(*) FILTER (verdict IN {SCORED}), 0) AS strict FROM records GROUP BY 1, 2, 3)
SELECT model, condition, count(*) AS drafts, count(strict) AS scored_drafts, round(avg(strict), 9) AS mean_strict
FROM d GROUP BY 1, 2""")
def mean_of_draft_rates(t: Tables) -> DataFrame:
    d = V.records(t).groupBy(*CELL, "matter").agg(R.strict_rate().alias("strict"))
    return d.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("drafts"), F.count("strict").alias("scored_drafts"),
        F.round(F.avg("strict"), 9).alias("mean_strict"),
    )


@query("A12 A19 I13", WITH + """
, s AS (SELECT model, condition, run, CAST(count(*) FILTER (verdict='accurate') AS DOUBLE)
    / nullif(count(*) FILTER (verdict IN ('accurate','near_miss','inaccurate')), 0) AS rate FROM records GROUP BY 1, 2, 3)
SELECT model, condition, count(rate) AS runs, round(avg(rate), 9) AS mean_rate,
  round(stddev_samp(rate), 9) AS sd_rate, max(rate) - min(rate) AS range_rate
FROM s GROUP BY 1, 2 HAVING count(rate) >= 2""")
def spread_across_runs(t: Tables) -> DataFrame:
    runs = V.records(t).groupBy(*CELL, "run").agg(R.strict_rate().alias("rate"))
    return O.run_spread(runs, CELL, "rate", complete=2)


@query("A13 M17", WITH + """
, y AS (SELECT model, condition, year, row_number() OVER (PARTITION BY model, condition ORDER BY year) AS rn,
    count(*) OVER (PARTITION BY model, condition) AS n FROM records WHERE kind='citation' AND verdict='exists')
SELECT model, condition, n, year AS median_year FROM y WHERE rn = n // 2 + 1""")
def upper_median_year(t: Tables) -> DataFrame:
    cited = V.records(t).filter("kind = 'citation' AND verdict = 'exists'")
    return O.upper_median(cited, CELL, "year", "median_year")


@query("A14", WITH + """
SELECT model, median(year) AS median_year, quantile_cont(year, 0.25) AS q1, quantile_cont(year, 0.75) AS q3
FROM records WHERE kind='citation' AND verdict='exists' GROUP BY 1""")
def interpolated_quartiles(t: Tables) -> DataFrame:
    cited = V.records(t).filter("kind = 'citation' AND verdict = 'exists'")
    return O.quantiles(cited, ["model"], "year", {"q1": 0.25, "median_year": 0.5, "q3": 0.75})


@query("A15 T6", WITH + """
SELECT volume, reporter, page, count(*) AS n, min(rid) AS first_pos FROM records WHERE kind='citation'
GROUP BY 1, 2, 3 ORDER BY n DESC, first_pos LIMIT 50""")
def canonical_authorities(t: Tables) -> DataFrame:
    return O.most_common(V.records(t).filter("kind = 'citation'"), ["volume", "reporter", "page"], "rid", 50)


@query("A15 M17", WITH + """
, top AS (SELECT volume, reporter, page FROM (SELECT volume, reporter, page, count(*) AS n, min(rid) AS f
    FROM records WHERE kind='citation' GROUP BY 1, 2, 3 ORDER BY n DESC, f LIMIT 50))
SELECT r.model, r.condition, count(*) AS n_cites, count(top.page) AS canonical,
  CAST(count(top.page) AS DOUBLE) / count(*) AS canonical_share
FROM records r LEFT JOIN top ON r.volume = top.volume AND r.reporter = top.reporter AND r.page = top.page
WHERE r.kind='citation' GROUP BY 1, 2""")
def canonical_share_by_cell(t: Tables) -> DataFrame:
    cited = V.records(t).filter("kind = 'citation'")
    key = ["volume", "reporter", "page"]
    # fifty rows, so the membership join is a broadcast
    top = O.most_common(cited, key, "rid", 50).select(*key, F.lit(1).alias("hit"))
    joined = cited.join(F.broadcast(top), key, "left")
    return joined.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_cites"), F.count("hit").alias("canonical"),
        R.share(F.count("hit"), F.count(F.lit(1))).alias("canonical_share"),
    )


@query("A16", WITH + f"""
, n AS (SELECT {_FAMILY} AS family, concat(reporter, ' ', CAST(volume AS VARCHAR)) AS series, count(*) AS n
  FROM records WHERE kind='citation' GROUP BY 1, 2)
SELECT family, series, n, rk FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, series) AS rk FROM n)
WHERE rk <= 12""")
def top_series_per_family(t: Tables) -> DataFrame:
    cited = V.records(t).filter("kind = 'citation'").select(
        C.reporter_family("reporter").alias("family"),
        F.concat("reporter", F.lit(" "), F.col("volume").cast("string")).alias("series"),
    )
    counted = cited.groupBy("family", "series").agg(F.count(F.lit(1)).alias("n"))
    return O.top_per_group(counted, ["family"], [F.desc("n"), F.asc("series")], 12, "rk")


@query("A17", WITH + """
, d AS (SELECT DISTINCT model, matter, condition, volume, reporter, page FROM records WHERE kind='citation')
SELECT model, condition, count(*) AS authorities, count(DISTINCT matter) AS matters FROM d GROUP BY 1, 2""")
def distinct_authorities(t: Tables) -> DataFrame:
    cited = V.records(t).filter("kind = 'citation'")
    d = cited.select("model", "matter", "condition", "volume", "reporter", "page").distinct()
    return d.groupBy(*CELL).agg(F.count(F.lit(1)).alias("authorities"), F.countDistinct("matter").alias("matters"))


@query("A18 A19", """
SELECT source, lang, count(*) AS texts, count(DISTINCT trim(text)) AS distinct_texts,
  count(DISTINCT trim(text)) < count(*) AS repeats
FROM documents GROUP BY 1, 2 HAVING count(*) >= 3""")
def identical_texts(t: Tables) -> DataFrame:
    # copies are folded by digest first, so a group of copies never travels as text
    by_text = (
        t.documents.select("source", "lang", F.sha2(F.trim("text"), 256).alias("digest"))
        .groupBy("source", "lang", "digest").agg(F.count(F.lit(1)).alias("n"))
    )
    g = by_text.groupBy("source", "lang").agg(F.sum("n").alias("texts"), F.count(F.lit(1)).alias("distinct_texts"))
    return g.filter("texts >= 3").withColumn("repeats", F.col("distinct_texts") < F.col("texts"))


@query("A23 A28", WITH + f"""
SELECT model, condition, count(*) AS quotes, CAST(count(*) AS DOUBLE) / 48 AS quotes_per_draft,
  CAST(count(*) FILTER (verdict='accurate') AS DOUBLE) / 48 AS accurate_per_draft,
  CAST(count(*) FILTER (verdict IN ('near_miss','inaccurate')) AS DOUBLE) / 48 AS inaccurate_per_draft,
  CAST(count(*) FILTER (verdict IN {SCORED}) AS DOUBLE) / count(*) AS paired_share
FROM records WHERE kind='quote' GROUP BY 1, 2""")
def counts_per_expected_draft(t: Tables) -> DataFrame:
    return O.per_expected_draft(V.records(t), CELL, expected=48)


@query("A24", """
SELECT lang, quality, count(*) AS n,
  round(avg(len(list_filter(regexp_split_to_array(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+'), lambda w: w <> ''))), 9) AS mean_words
FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def mean_length_by_label(t: Tables) -> DataFrame:
    from plumbline.functions.text import words

    joined = t.documents.join(t.labels, "doc_id")
    return joined.groupBy("lang", "quality").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size(words("text"))), 9).alias("mean_words")
    )


_GROUP3 = """CASE replace(replace(reporter,' ',''),'.','') WHEN 'US' THEN 'us' WHEN 'F3d' THEN 'federal'
  WHEN 'F2d' THEN 'federal' WHEN 'FSupp2d' THEN 'federal' ELSE 'other' END"""


@query("A25 F18", WITH + f"""
, g AS (SELECT model, condition, verdict, {_GROUP3} AS grp FROM records WHERE kind='citation')
SELECT model, count(*) AS citations, CAST(count(*) FILTER (grp='us') AS DOUBLE)/count(*) AS us_share,
  CAST(count(*) FILTER (grp='federal') AS DOUBLE)/count(*) AS federal_share,
  CAST(count(*) FILTER (grp='us' AND condition='baseline') AS DOUBLE)
    / nullif(count(*) FILTER (condition='baseline'), 0) AS us_share_baseline,
  CAST(count(*) FILTER (grp='federal' AND verdict='not_found') AS DOUBLE)
    / nullif(count(*) FILTER (grp='federal' AND verdict IN ('exists','not_found')), 0) AS federal_not_found
FROM g GROUP BY 1""")
def reporter_mix(t: Tables) -> DataFrame:
    g = V.records(t).filter("kind = 'citation'").withColumn("grp", C.reporter_group("reporter"))
    n, base = F.count(F.lit(1)), F.col("condition") == "baseline"
    is_g = lambda name: F.col("grp") == name
    return g.groupBy("model").agg(
        n.alias("citations"),
        R.share(F.count_if(is_g("us")), n).alias("us_share"),
        R.share(F.count_if(is_g("federal")), n).alias("federal_share"),
        R.share(F.count_if(is_g("us") & base), F.count_if(base)).alias("us_share_baseline"),
        R.share(
            F.count_if(is_g("federal") & (F.col("verdict") == "not_found")),
            F.count_if(is_g("federal") & F.col("verdict").isin("exists", "not_found")),
        ).alias("federal_not_found"),
    )


@query("A26 A27 K9", WITH + """
, n AS (SELECT condition, verdict, count(*) AS c FROM records
  WHERE kind='quote' AND verdict IN ('near_miss','inaccurate','unverifiable','unpaired') GROUP BY 1, 2)
SELECT condition, verdict, c, 100.0 * c / CAST(sum(c) OVER (PARTITION BY condition) AS DOUBLE) AS pct FROM n""")
def stacked_shares(t: Tables) -> DataFrame:
    flagged = V.records(t).filter(F.col("verdict").isin("near_miss", "inaccurate", "unverifiable", "unpaired"))
    n = flagged.groupBy("condition", "verdict").agg(F.count(F.lit(1)).alias("c"))
    whole = F.sum("c").over(Window.partitionBy("condition"))
    return n.withColumn("pct", F.lit(100.0) * F.col("c") / whole)


@query("A38 A39", WITH + """
, a AS (SELECT model, condition, CAST(count(*) FILTER (verdict='accurate') AS DOUBLE) / nullif(count(*) FILTER
    (verdict IN ('accurate','near_miss','inaccurate')), 0) AS strict FROM records WHERE template='A' GROUP BY 1, 2)
, b AS (SELECT model, condition, CAST(count(*) FILTER (verdict='accurate') AS DOUBLE) / nullif(count(*) FILTER
    (verdict IN ('accurate','near_miss','inaccurate')), 0) AS strict FROM records WHERE template='B' GROUP BY 1, 2)
, j AS (SELECT a.model, a.condition, a.strict AS sa, b.strict AS sb, a0.strict AS ba, b0.strict AS bb
  FROM a JOIN b ON a.model=b.model AND a.condition=b.condition
  JOIN a a0 ON a0.model=a.model AND a0.condition='baseline' JOIN b b0 ON b0.model=a.model AND b0.condition='baseline')
SELECT model, max(abs(sa-sb)) AS max_abs_diff, round(avg(abs(sa-sb)), 9) AS mean_abs_diff,
  count(*) FILTER (condition<>'baseline' AND sign(sa-ba)=sign(sb-bb)) AS same_sign,
  count(*) FILTER (condition<>'baseline') AS contrasts
FROM j GROUP BY 1""")
def agreement_of_two_scorings(t: Tables) -> DataFrame:
    both = V.records(t).groupBy("template", *CELL).agg(R.strict_rate().alias("strict"))
    return O.compare_scorings(both, "template", "A", "B", "model", "condition", "strict")


@query("A37", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def texts_per_source(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("J17 J18 M7 K5", WITH + """
, models AS (SELECT DISTINCT model FROM records), conds AS (SELECT DISTINCT condition FROM records),
 ka AS (SELECT model, condition, count(*) AS n FROM records WHERE verdict='exists' AND template='A' GROUP BY 1, 2),
 kb AS (SELECT model, condition, count(*) AS n FROM records WHERE verdict='exists' AND template='B' GROUP BY 1, 2),
 kd AS (SELECT model, condition, count(DISTINCT matter) AS n FROM records GROUP BY 1, 2)
SELECT m.model, c.condition, ka.n AS fit_a, kb.n AS fit_b, 48 - coalesce(kd.n, 0) AS missing_drafts
FROM models m CROSS JOIN conds c LEFT JOIN ka ON ka.model=m.model AND ka.condition=c.condition
LEFT JOIN kb ON kb.model=m.model AND kb.condition=c.condition
LEFT JOIN kd ON kd.model=m.model AND kd.condition=c.condition""")
def contrast_matrix(t: Tables) -> DataFrame:
    r = V.records(t)
    fits = (
        r.filter("verdict = 'exists'").groupBy("model", "condition", "template").agg(F.count(F.lit(1)).alias("n"))
    )
    present = r.select("model", "condition", "matter").distinct().groupBy(*CELL).agg(F.count(F.lit(1)).alias("have"))
    return O.matrix(fits, present, {"fit_a": "A", "fit_b": "B"}, expected=48)


@query("U1 M15", WITH + """
SELECT 'A' AS source_tag, condition, count(*) FILTER (verdict='exists') AS ok, count(*) FILTER (verdict='not_found') AS bad
FROM records WHERE kind='citation' AND template='A' AND condition IN ('baseline','combo') GROUP BY 2
UNION ALL
SELECT 'B', condition, count(*) FILTER (verdict='exists'), count(*) FILTER (verdict='not_found')
FROM records WHERE kind='citation' AND template='B' AND condition IN ('baseline','combo') GROUP BY 2""")
def tagged_union_counts(t: Tables) -> DataFrame:
    r = V.records(t).filter("kind = 'citation' AND condition IN ('baseline', 'combo')")
    stacked = union_all([r.filter(F.col("template") == x).withColumn("source_tag", F.lit(x)) for x in ("A", "B")])
    return stacked.groupBy("source_tag", "condition").agg(
        F.count_if(F.col("verdict") == "exists").alias("ok"), F.count_if(F.col("verdict") == "not_found").alias("bad")
    )


@query("U2 U3 U5 I16", WITH + """
, s AS (SELECT template, model, condition, CAST(count(*) FILTER (verdict='exists') AS DOUBLE) / nullif(count(*) FILTER
    (verdict IN ('exists','not_found')), 0) AS rate FROM records GROUP BY 1, 2, 3)
, a AS (SELECT model, condition FROM s WHERE template='A' AND rate < 0.9), b AS (SELECT model, condition FROM s WHERE template='B' AND rate < 0.9)
SELECT 'both' AS side, model, condition FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'a_only', model, condition FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'b_only', model, condition FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def survivor_set_comparison(t: Tables) -> DataFrame:
    s = V.records(t).groupBy("template", *CELL).agg(R.existence_rate().alias("rate")).filter("rate < 0.9")
    a = s.filter("template = 'A'").select(*CELL)
    b = s.filter("template = 'B'").select(*CELL)
    tag = lambda df, name: df.withColumn("side", F.lit(name)).select("side", *CELL)
    return union_all([tag(a.intersect(b), "both"), tag(a.subtract(b), "a_only"), tag(b.subtract(a), "b_only")])


@query("K8", WITH + """
, c AS (SELECT model, condition, count(*) AS n, count(*) FILTER (verdict='exists') AS ok FROM records WHERE kind='citation' GROUP BY 1, 2)
SELECT concat('n', upper(model), upper(left(condition,1)), substr(condition,2)) AS name, CAST(n AS VARCHAR) AS value FROM c
UNION ALL SELECT concat('pct', upper(model), upper(left(condition,1)), substr(condition,2)),
  CAST((100 * ok) // n AS VARCHAR) || '%' FROM c""")
def report_macros(t: Tables) -> DataFrame:
    c = V.records(t).filter("kind = 'citation'").groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "exists").alias("ok")
    )
    return O.macros(
        c, CELL, {"n": F.col("n").cast("string"), "pct": F.concat(F.expr("(100 * ok) div n").cast("string"), F.lit("%"))}
    )


@query("M3 M4", WITH + """
, d AS (SELECT model, matter, bool_and(verdict='exists') AS all_ok, bool_or(verdict='exists') AS any_ok,
   count(*) AS cites, count(*) FILTER (verdict='exists') AS ok, count(*) FILTER (verdict='not_found') AS bad
  FROM records WHERE kind='citation' GROUP BY 1, 2)
SELECT model, CAST(sum(cites) AS BIGINT) AS overall, CAST(coalesce(sum(cites) FILTER (all_ok), 0) AS BIGINT) AS all_resolved,
  CAST(coalesce(sum(cites) FILTER (any_ok), 0) AS BIGINT) AS any_resolved, count(*) FILTER (any_ok) AS drafts_any,
  CAST(sum(ok) AS DOUBLE) / nullif(CAST(sum(ok + bad) AS DOUBLE), 0) AS existence_rate
FROM d GROUP BY 1""")
def predicate_subset_totals(t: Tables) -> DataFrame:
    hit = F.col("verdict") == "exists"
    d = V.records(t).filter("kind = 'citation'").groupBy("model", "matter").agg(
        F.bool_and(hit).alias("all_ok"), F.bool_or(hit).alias("any_ok"), F.count(F.lit(1)).alias("cites"),
        F.count_if(hit).alias("ok"), F.count_if(F.col("verdict") == "not_found").alias("bad"),
    )
    only = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("cites"))), F.lit(0))
    return d.groupBy("model").agg(
        F.sum("cites").alias("overall"), only("all_ok").alias("all_resolved"), only("any_ok").alias("any_resolved"),
        F.count_if(F.col("any_ok")).alias("drafts_any"),
        R.share(F.sum("ok"), F.sum(F.col("ok") + F.col("bad"))).alias("existence_rate"),
    )


@query("M5", WITH + f"""
SELECT model, condition, count(*) FILTER (verdict='accurate') AS accurate_n, count(*) FILTER (verdict IN {SCORED}) AS scored_n
FROM records WHERE matter IN (SELECT DISTINCT doc_id % 48 FROM labels WHERE toxic = 1) GROUP BY 1, 2""")
def subset_cells(t: Tables) -> DataFrame:
    chosen = t.labels.filter("toxic = 1").select((F.col("doc_id") % 48).alias("matter")).distinct()
    return V.records(t).join(chosen, "matter", "left_semi").groupBy(*CELL).agg(
        F.count_if(F.col("verdict") == "accurate").alias("accurate_n"),
        F.count_if(F.col("verdict").isin(*R.SCORED_QUOTES)).alias("scored_n"),
    )


@query("S9", WITH + """
SELECT model, count(DISTINCT matter * 10 + run) AS drafts FROM records GROUP BY 1 HAVING count(DISTINCT matter * 10 + run) >= 40""")
def complete_models(t: Tables) -> DataFrame:
    drafts = V.records(t).select("model", "matter", "run").distinct()
    return drafts.groupBy("model").agg(F.count(F.lit(1)).alias("drafts")).filter("drafts >= 40")
