"""Lookup, coverage, metadata checks, page ranges, tiers, membership and upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import citations as C
from plumbline.functions import names as N
from plumbline.functions import rates as R
from plumbline.operators import cells as O
from plumbline.operators import resolve as P
from plumbline.operators import sampling as S
from plumbline.operators.skew import salted_join
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.session import Tables, shared_dir, stage
from plumbline.sources import readers

RES = f"WITH {V.RESOLUTION} "
CUTOFF = "1971-01-01"


def _resolved(t: Tables) -> DataFrame:
    return P.resolve(V.claims(t), V.index(t), V.clusters(t), V.ROW_ID)


@query("J1 J2 J3 F16", RES + """
SELECT draft, ord, part, supp, rep_key, verdict, cluster_id, case_name, date_filed,
  volume IS NOT NULL AND page IS NOT NULL AND reporter = 'WL' AS vendor_cite,
  volume IS NOT NULL AND page IS NOT NULL AND reporter <> 'WL' AND NOT covered AS coverage_gap FROM resolved""")
def citation_resolution(t: Tables) -> DataFrame:
    return _resolved(t).select(
        *V.ROW_ID, "rep_key", "verdict", "cluster_id", "case_name", "date_filed", "vendor_cite", "coverage_gap"
    )


_TOKS = (
    "list_filter(list_transform(regexp_extract_all(lower({0}), '[A-Za-z][A-Za-z.''-]+'), lambda x: trim(x, '.,''')), "
    "lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in N.SHORT_STOP) + "))"
)
_CHECKED = f""", checked AS (SELECT *, CASE WHEN verdict='exists' AND coalesce(claimed,'')<>'' AND coalesce(case_name,'')<>''
    THEN list_has_any({_TOKS.format('claimed')}, {_TOKS.format('case_name')}) END AS name_match,
  CASE WHEN verdict='exists' AND date_filed IS NOT NULL AND paren_year IS NOT NULL THEN CAST(paren_year AS VARCHAR) = left(date_filed, 4) END AS year_match,
  CASE WHEN verdict='exists' AND date_filed IS NOT NULL THEN date_filed < '{CUTOFF}' END AS anachronism_ok FROM resolved)"""


def _checked(t: Tables) -> DataFrame:
    return P.with_metadata_checks(_resolved(t), F.lit(CUTOFF))


@query("A2 J7 V16", RES + _CHECKED + """
SELECT condition, count(*) AS n_citations,
  CAST(count(*) FILTER (verdict='exists') AS DOUBLE) / nullif(count(*) FILTER (verdict IN ('exists','not_found')), 0) AS existence_rate,
  CAST(count(*) FILTER (verdict='unresolvable') AS DOUBLE) / nullif(count(*), 0) AS unresolvable_rate,
  CAST(count(*) FILTER (name_match) AS DOUBLE) / nullif(count(name_match), 0) AS name_match_rate,
  CAST(count(*) FILTER (year_match) AS DOUBLE) / nullif(count(year_match), 0) AS year_match_rate,
  CAST(count(*) FILTER (anachronism_ok) AS DOUBLE) / nullif(count(anachronism_ok), 0) AS no_future_rate
FROM checked GROUP BY 1""")
def checker_rates(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    v = lambda *x: F.count_if(F.col("verdict").isin(*x))
    flag = lambda c: R.share(F.count_if(F.col(c)), F.count(c))
    return _checked(t).groupBy("condition").agg(
        n.alias("n_citations"), R.share(v("exists"), v("exists", "not_found")).alias("existence_rate"),
        R.share(v("unresolvable"), n).alias("unresolvable_rate"), flag("name_match").alias("name_match_rate"),
        flag("year_match").alias("year_match_rate"), flag("anachronism_ok").alias("no_future_rate"),
    )


@query("J7 A9", RES + _CHECKED + """
SELECT coalesce(condition, '_all') AS condition, coalesce(rep_key, '_all') AS rep_key, count(*) AS exists_n,
  count(name_match) AS name_checked, count(*) FILTER (name_match IS NULL) AS name_unchecked, count(*) FILTER (NOT name_match) AS mismatch
FROM checked WHERE verdict='exists' GROUP BY GROUPING SETS ((condition, rep_key), (condition), ())""")
def name_mismatches(t: Tables) -> DataFrame:
    hit = _checked(t).filter("verdict = 'exists'")
    return O.with_totals(
        hit, ["condition", "rep_key"],
        {"exists_n": F.count(F.lit(1)), "name_checked": F.count("name_match"),
         "name_unchecked": F.count_if(F.col("name_match").isNull()), "mismatch": F.count_if(~F.col("name_match"))},
    )


@query("W8", RES + _CHECKED + """
, k AS (SELECT condition, rep_key, volume, count(*) AS n FROM checked WHERE NOT name_match GROUP BY 1, 2, 3)
, o AS (SELECT condition, rep_key, volume, draft, ord, part, supp, row_number() OVER (PARTITION BY condition, rep_key, volume ORDER BY draft, ord, part, supp) AS i
   FROM checked WHERE verdict='exists')
SELECT o.condition, o.rep_key, o.volume, o.draft, o.ord, o.part, o.supp, coalesce(o.i <= k.n, false) AS relabelled
FROM o LEFT JOIN k ON k.condition=o.condition AND k.rep_key=o.rep_key AND k.volume=o.volume""")
def relabelled_occurrences(t: Tables) -> DataFrame:
    key = ["condition", "rep_key", "volume"]
    checked = _checked(t).filter("verdict = 'exists'").select(*key, *V.ROW_ID, "name_match")
    return P.relabel_first(checked, key, V.ROW_ID, ~F.col("name_match")).select(*key, *V.ROW_ID, "relabelled")


@query("J10 V7 W3 J9", f"WITH {V.CASES}, {V.INDEX}, {V.CLAIMS}" + """
, starts AS (SELECT volume, rep_key, start, lead(start) OVER (PARTITION BY volume, rep_key ORDER BY start) AS nxt FROM
   (SELECT DISTINCT volume, replace(replace(reporter,' ',''),'.','') AS rep_key, CAST(page AS BIGINT) AS start FROM idx))
SELECT c.draft, c.ord, c.part, c.supp, s.nxt AS next_start, CASE WHEN pin_page IS NULL THEN 'no_pin' WHEN c.page IS NULL THEN 'unparsable'
  WHEN s.start IS NULL THEN 'case_unknown' WHEN pin_page < s.start THEN 'out_of_range' WHEN nxt IS NOT NULL AND pin_page < nxt THEN 'in_range'
  WHEN nxt IS NOT NULL THEN 'out_of_range' WHEN pin_page - s.start < 400 THEN 'in_range_unbounded' ELSE 'out_of_range' END AS pin_verdict
FROM claims c LEFT JOIN starts s ON s.volume = c.volume AND s.rep_key = replace(replace(c.reporter,' ',''),'.','') AND s.start = CAST(c.page AS BIGINT)""")
def pin_range_verdicts(t: Tables) -> DataFrame:
    return P.check_pins(V.claims(t), V.index(t), V.ROW_ID).select(*V.ROW_ID, "next_start", "pin_verdict")


@query("V17 V18", RES + """
, y AS (SELECT condition, draft, coalesce(CAST(left(date_filed, 4) AS BIGINT), paren_year) AS yr FROM resolved)
SELECT condition, count(yr) AS checked, count(*) FILTER (yr >= 1970) AS violated, count(DISTINCT draft) FILTER (yr >= 1970) AS drafts_violating,
  CAST(count(*) FILTER (yr >= 1970) AS DOUBLE) / nullif(count(yr), 0) AS violation_share FROM y GROUP BY 1""")
def temporal_violations(t: Tables) -> DataFrame:
    y = _resolved(t).select("condition", "draft", P.decision_year().alias("yr"))
    late = F.col("yr") >= 1970
    return y.groupBy("condition").agg(
        F.count("yr").alias("checked"), F.count_if(late).alias("violated"),
        F.countDistinct(F.when(late, F.col("draft"))).alias("drafts_violating"),
        R.share(F.count_if(late), F.count("yr")).alias("violation_share"),
    )


@query("J14 J15 V18", RES + """
, b AS (SELECT DISTINCT volume, rep_key, page FROM resolved WHERE condition='baseline' AND page IS NOT NULL)
, e AS (SELECT r.condition, r.verdict, CASE WHEN date_filed IS NULL THEN NULL WHEN CAST(left(date_filed, 4) AS BIGINT) < 1970 THEN 'pre1970' ELSE 'post1970' END AS era,
   b.page IS NOT NULL AS in_baseline FROM resolved r LEFT JOIN b ON b.volume=r.volume AND b.rep_key=r.rep_key AND b.page=r.page)
SELECT condition, verdict, coalesce(era, 'undated') AS era, in_baseline, count(*) AS n FROM e GROUP BY ALL""")
def era_and_baseline_membership(t: Tables) -> DataFrame:
    r = _resolved(t)
    key = ["volume", "rep_key", "page"]
    base = r.filter("condition = 'baseline' AND page IS NOT NULL").select(*key).distinct().withColumn("_in", F.lit(True))
    e = r.withColumn("era", F.coalesce(C.era(C.year_of("date_filed")), F.lit("undated")))
    e = salted_join(e, base, key, V.ROW_ID)
    return e.groupBy("condition", "verdict", "era", F.col("_in").isNotNull().alias("in_baseline")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("J5 J4", f"WITH {V.CASES}, {V.INDEX}" + """
, wide AS (SELECT volume, reporter, page, cluster_id FROM idx UNION ALL
   SELECT CAST(CAST(volume AS BIGINT) + 7 AS VARCHAR), 'S. Ct.', page, cluster_id FROM idx WHERE reporter = 'U.S.')
SELECT a.cluster_id, concat(a.volume, ' ', a.reporter, ' ', a.page) AS official, concat(b.volume, ' ', b.reporter, ' ', b.page) AS parallel, k.case_name
FROM wide a JOIN wide b ON a.cluster_id = b.cluster_id AND a.reporter = 'U.S.' AND b.reporter = 'S. Ct.' JOIN clusters k ON k.cluster_id = a.cluster_id""")
def parallel_citation_pairs(t: Tables) -> DataFrame:
    idx = V.index(t)
    also = idx.filter("reporter = 'U.S.'").select(
        (F.col("volume").cast("long") + 7).cast("string").alias("volume"), F.lit("S. Ct.").alias("reporter"), "page", "cluster_id"
    )
    wide = idx.unionByName(also)
    cite = F.concat_ws(" ", "volume", "reporter", "page")
    # one official and one parallel citation per cluster, never all pairs of a group
    a = wide.filter("reporter = 'U.S.'").select("cluster_id", cite.alias("official"))
    b = wide.filter("reporter = 'S. Ct.'").select("cluster_id", cite.alias("parallel"))
    return a.join(b, "cluster_id").join(V.clusters(t).select("cluster_id", "case_name"), "cluster_id")


@query("J6", """
WITH tiers AS (
  SELECT d.doc_id, 0 AS rank, 'cache' AS src FROM documents d JOIN labels l ON l.doc_id=d.doc_id AND l.quality=1 WHERE length(text) > 0
  UNION ALL SELECT doc_id, 1, 'import' FROM documents WHERE lang='en' AND length(text) > 0
  UNION ALL SELECT doc_id, 2, 'archive' FROM documents WHERE source <> 'src0' AND length(text) > 0)
, best AS (SELECT doc_id, min(rank) AS rank FROM tiers GROUP BY 1)
SELECT d.doc_id, CASE rank WHEN 0 THEN 'cache' WHEN 1 THEN 'import' ELSE 'archive' END AS src, md5(d.text) AS text_md5
FROM best JOIN documents d ON d.doc_id = best.doc_id""")
def tiered_text_lookup(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", "lang", "source")
    good = t.labels.filter("quality = 1").select("doc_id").distinct()
    tiers = [
        ("cache", d.join(good, "doc_id", "left_semi")), ("import", d.filter("lang = 'en'")),
        ("archive", d.filter("source <> 'src0'")),
    ]
    got = P.first_tier(d.select("doc_id"), ["doc_id"], tiers)
    return got.select("doc_id", "src", F.md5("text").alias("text_md5"))


@query("K2 W5 Z5", """
SELECT user_id, event_type, event_id, value, props FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def last_writer_wins(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value", "props")
    return P.last_writer(rows, ["user_id", "event_type"], ["event_id"])


@query("K3 J23", """
SELECT user_id, event_type, event_id, value, props FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1""")
def first_writer_wins(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value", "props")
    return P.first_writer(rows, ["user_id", "event_type"], ["event_id"])


@query("J23", f"WITH {V.CASES}, {V.CLAIMS}" + """
SELECT draft, reporter, arg_min(claimed, ord * 1000000000000 + part * 1000000 + supp) AS first_claimed,
  arg_max(claimed, ord * 1000000000000 + part * 1000000 + supp) AS last_claimed FROM claims GROUP BY 1, 2""")
def first_and_last_record(t: Tables) -> DataFrame:
    at = F.struct("ord", "part", "supp")
    return V.claims(t).groupBy("draft", "reporter").agg(
        F.min_by("claimed", at).alias("first_claimed"), F.max_by("claimed", at).alias("last_claimed")
    )


@query("J24 R3", RES + """
, listed AS (SELECT volume, page, reporter AS lrep FROM (SELECT volume, page, reporter, row_number() OVER (PARTITION BY volume ORDER BY date_filed, cluster_id) AS i
   FROM cases WHERE status <> 'P') WHERE i <= 10)
, l AS (SELECT DISTINCT volume, replace(replace(lrep,' ',''),'.','') AS rep_key, page FROM listed)
SELECT r.condition, count(*) AS cites, count(l.page) AS among_ten, CAST(count(l.page) AS DOUBLE) / count(*) AS share
FROM resolved r LEFT JOIN l ON l.volume=r.volume AND l.rep_key=r.rep_key AND l.page=r.page GROUP BY 1""")
def share_among_retrieved(t: Tables) -> DataFrame:
    c = V.cases(t).filter("status <> 'P'").select("volume", "reporter", "page", "date_filed", "cluster_id")
    ten = O.top_per_group(c, ["volume"], [F.col("date_filed"), F.col("cluster_id")], 10, "i")
    listed = ten.select("volume", C.reporter_key("reporter").alias("rep_key"), "page").distinct().withColumn("_l", F.lit(1))
    claimed = V.claims(t).withColumn("rep_key", C.reporter_key("reporter"))
    j = salted_join(claimed, listed, ["volume", "rep_key", "page"], V.ROW_ID)
    return j.groupBy("condition").agg(
        F.count(F.lit(1)).alias("cites"), F.count("_l").alias("among_ten"),
        R.share(F.count("_l"), F.count(F.lit(1))).alias("share"),
    )


@query("M16", RES + _CHECKED + f"""
, src AS (SELECT DISTINCT draft, ord, part, supp, unnest({_TOKS.format('case_name')}) AS tok FROM checked WHERE NOT name_match)
, named AS (SELECT DISTINCT draft, unnest({_TOKS.format('claimed')}) AS tok FROM claims)
, hit AS (SELECT DISTINCT s.draft, s.ord, s.part, s.supp FROM src s JOIN named n ON n.draft=s.draft AND n.tok=s.tok)
SELECT m.condition, count(*) AS mismatched, count(h.draft) AS cited_elsewhere FROM
  (SELECT DISTINCT condition, draft, ord, part, supp FROM checked WHERE NOT name_match) m
LEFT JOIN hit h ON h.draft=m.draft AND h.ord=m.ord AND h.part=m.part AND h.supp=m.supp GROUP BY 1""")
def source_cited_elsewhere(t: Tables) -> DataFrame:
    # both branches read it
    miss = stage(_checked(t).filter(~F.col("name_match")).select("condition", *V.ROW_ID, "case_name").distinct())
    # tokens meet tokens inside a draft: no pairing of all claims of a draft
    tokens = miss.select(*V.ROW_ID, F.explode(N.short_tokens("case_name")).alias("tok")).distinct()
    named = V.claims(t).select("draft", F.explode(N.short_tokens("claimed")).alias("tok")).distinct()
    hit = tokens.join(named, ["draft", "tok"], "left_semi").select(*V.ROW_ID).distinct().withColumn("_h", F.lit(1))
    return miss.join(hit, V.ROW_ID, "left").groupBy("condition").agg(
        F.count(F.lit(1)).alias("mismatched"), F.count("_h").alias("cited_elsewhere")
    )


@query("J16 I12", f"WITH {V.RECORDS}" + """
, r AS (SELECT model, matter, condition, CAST(count(*) FILTER (verdict='accurate') AS DOUBLE) / nullif(count(*) FILTER
   (verdict IN ('accurate','near_miss','inaccurate')), 0) AS rate FROM records GROUP BY 1, 2, 3)
SELECT c.model, c.condition, count(*) AS pairs, round(avg(c.rate - b.rate), 9) AS mean_diff, count(*) FILTER (c.rate > b.rate) AS up
FROM r c JOIN r b ON b.model=c.model AND b.matter=c.matter AND b.condition='baseline' AND c.condition<>'baseline'
WHERE c.rate IS NOT NULL AND b.rate IS NOT NULL GROUP BY 1, 2""")
def paired_differences(t: Tables) -> DataFrame:
    r = V.records(t).groupBy("model", "matter", "condition").agg(R.strict_rate().alias("rate")).filter("rate IS NOT NULL")
    base = r.filter("condition = 'baseline'").select("model", "matter", F.col("rate").alias("b"))
    other = r.filter("condition <> 'baseline'")
    return other.join(base, ["model", "matter"]).groupBy("model", "condition").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("rate") - F.col("b")), 9).alias("mean_diff"),
        F.count_if(F.col("rate") > F.col("b")).alias("up"),
    )


@query("M9", f"WITH {V.CASES}, {V.INDEX}, {V.CLAIMS}" + """
, stems AS (SELECT DISTINCT concat(volume, '_', replace(replace(reporter,' ',''),'.',''), '_', page) AS stem FROM idx)
SELECT condition, count(*) AS known FROM claims WHERE page IS NOT NULL AND
  concat(volume, '_', replace(replace(reporter,' ',''),'.',''), '_', page) IN (SELECT stem FROM stems) GROUP BY 1""")
def known_stems(t: Tables) -> DataFrame:
    stem = F.concat_ws("_", "volume", F.translate("reporter", " .", ""), "page").alias("stem")
    stems = V.index(t).select(stem).distinct()
    c = V.claims(t).filter("page IS NOT NULL").select("condition", stem, *V.ROW_ID)
    return salted_join(c, stems, ["stem"], V.ROW_ID, "left_semi").groupBy("condition").agg(F.count(F.lit(1)).alias("known"))


@query("S15", "SELECT doc_id, lang, length(text) AS n FROM documents WHERE length(text) BETWEEN 1500 AND 6000")
def texts_of_usable_length(t: Tables) -> DataFrame:
    d = t.documents.filter("length(text) BETWEEN 1500 AND 6000")
    return d.select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query("S18 T5", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE (i - 1) % greatest(1, n // 48) = 0 ORDER BY i LIMIT 48""")
def strided_sample(t: Tables) -> DataFrame:
    return S.strided(t.documents.select("doc_id"), ["doc_id"], 48)


@query("S16 X1 X4 U6", """
WITH a AS (SELECT doc_id FROM documents ORDER BY md5(concat_ws('-', '20260831', CAST(doc_id AS VARCHAR))), doc_id LIMIT 40)
, b AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY md5(concat_ws('-', '20260904', CAST(doc_id AS VARCHAR))), doc_id LIMIT 120)
SELECT 'first' AS draw, doc_id FROM a UNION ALL SELECT 'second', doc_id FROM b""")
def disjoint_random_samples(t: Tables) -> DataFrame:
    pool = t.documents.select("doc_id")
    first = S.sample(pool, 20260831, ["doc_id"], 40)
    rest = pool.join(F.broadcast(first), "doc_id", "left_anti")  # forty rows
    second = S.sample(rest, 20260904, ["doc_id"], 120)
    return first.select(F.lit("first").alias("draw"), "doc_id").unionByName(second.select(F.lit("second").alias("draw"), "doc_id"))


@query("T7 T8", """
SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality
  ORDER BY md5(concat_ws('-', '7', CAST(doc_id AS VARCHAR))), doc_id) AS rk FROM labels) WHERE rk <= 30""")
def random_head_per_class(t: Tables) -> DataFrame:
    return S.head_per_class(t.labels.select("quality", "doc_id"), 7, ["doc_id"], "quality", 30)


@query("X3 X2", f"WITH {V.RECORDS}" + """
, u AS (SELECT *, CAST(concat('0x', substr(md5(concat_ws('-', '5', CAST(rid AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS x FROM records WHERE verdict IN ('inaccurate','near_miss'))
SELECT condition, count(*) AS lines, count(*) FILTER (x < 0.25) AS quarter, count(*) FILTER (x < 0.5) AS half, count(*) FILTER (x < 0.75) AS threequarter FROM u GROUP BY 1""")
def bernoulli_mixes(t: Tables) -> DataFrame:
    u = V.records(t).filter("verdict IN ('inaccurate', 'near_miss')").withColumn("x", S.uniform(5, "rid"))
    under = lambda p: F.count_if(F.col("x") < p)
    return u.groupBy("condition").agg(
        F.count(F.lit(1)).alias("lines"), under(0.25).alias("quarter"), under(0.5).alias("half"),
        under(0.75).alias("threequarter"),
    )


@query("S14", r"""
WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk FROM documents)
SELECT doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, min(left(trim(left(chunk, 80)), 90)) AS first_caption FROM c WHERE length(chunk) >= 200 GROUP BY 1""")
def delimited_chunks(t: Tables) -> DataFrame:
    chunk = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("chunk")).filter(F.length("chunk") >= 200)
    caption = F.left(F.trim(F.left("chunk", F.lit(80))), F.lit(90))
    return chunk.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.min(caption).alias("first_caption")
    )


@query("S13", f"WITH {V.RECORDS}" + r"""
SELECT verdict AS cls, model, CAST(matter AS VARCHAR) AS matter, condition, concat(CAST(volume AS VARCHAR), ' ', reporter, ' ', CAST(page AS VARCHAR)) AS citation, count(*) AS n
FROM records WHERE kind='citation' GROUP BY ALL""")
def parsed_report_lines(t: Tables) -> DataFrame:
    line = F.expr(
        "concat('- **', verdict, '** | ', model, ' ', cast(matter as string), '_', condition, ' | cited ', "
        "cast(volume as string), ' ', reporter, ' ', cast(page as string), ' (Doe v. Roe) | true source: —')"
    )
    lines = V.records(t).filter("kind = 'citation'").select(line.alias("value"))
    parsed = readers.parse_report_lines(lines)
    return parsed.groupBy("cls", "model", "matter", "condition", "citation").agg(F.count(F.lit(1)).alias("n"))


@query("S2", f"WITH {V.CASES}" + """
SELECT cluster_id AS id, case_name, left(date_filed, 10) AS date_filed, concat('s', CAST(cluster_id AS VARCHAR)) AS scdb_id, CAST(volume AS BIGINT) AS docket_id FROM cases
WHERE status <> 'P'""")
def resynchronised_rows(t: Tables) -> DataFrame:
    """Rows torn over two lines, with every third of the statuses unreadable, written as text and put together again."""
    pad = lambda n: ", ".join(["'\"x\"'"] * n)
    row = F.expr(
        "concat_ws(',', concat('\"', cluster_id, '\"'), concat('\"', date_filed, ' 00:00:00\"'), '\"x\"', '\"x\"', "
        f"concat('\"', date_filed, '\"'), {pad(3)}, concat('\"', case_name, '\"'), '\"x\"', concat('\"s', cluster_id, '\"'), "
        f"{pad(22)}, CASE WHEN status = 'P' THEN '\"cut' ELSE concat('\"', volume, '\"') END)"
    )
    # the line break falls between two fields, as it may inside one
    torn = V.cases(t).select(F.regexp_replace(row, ',"x","x",', ',"x",\n"x",').alias("value"))
    folder = f"{shared_dir(t.spark)}/torn-{uuid.uuid4().hex}"
    torn.write.text(folder)
    return readers.torn_csv(t.spark, folder)
