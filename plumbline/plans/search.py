"""Containment, provenance and retrieval over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import rates as R
from plumbline.functions import text as X
from plumbline.operators import containment as J
from plumbline.operators import provenance as S
from plumbline.operators import ranking as G
from plumbline.operators import retrieval as Q
from plumbline.operators import verdicts as D
from plumbline.operators.skew import attach, salted_join
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.session import Tables, spread, stage

NORM = V.nz("text")


def corpus(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", X.normalize("text").alias("norm"))


@query("J8", f"""
WITH d AS (SELECT doc_id, {NORM} AS n FROM documents), f AS (SELECT item_id, {NORM} AS f FROM benchmark)
SELECT item_id, doc_id, strpos(n, f) AS first_pos FROM f JOIN d ON contains(n, f)""")
def passages_in_corpus(t: Tables) -> DataFrame:
    f = t.benchmark.select("item_id", X.normalize("text").alias("frag"))
    return J.contained(
        f, corpus(t), frag_id="item_id", frag="frag", doc_id="doc_id", text="norm",
        extra={"first_pos": F.position(F.col("frag"), F.col("norm")).cast("long")},
    )


@query("J8 J21", f"""
WITH {V.DOC_QUOTES}, d AS (SELECT doc_id, {NORM} AS n FROM documents)
, f AS (SELECT doc_id AS quote_doc, unnest({V.frags('quote')}) AS frag FROM doc_quotes)
SELECT quote_doc, count(*) AS holders, count(DISTINCT frag) AS fragments, min(d.doc_id) AS first_doc FROM f JOIN d ON contains(d.n, f.frag) GROUP BY 1""")
def quote_fragments_in_corpus(t: Tables) -> DataFrame:
    f = V.doc_quotes(t, whole=False).select(F.col("doc_id").alias("quote_doc"), F.explode(X.fragments("quote", "literal")).alias("frag"))
    f = stage(f)
    unique = S.numbered(f, "frag", "fid")
    pairs = J.contained(unique, corpus(t), frag_id="fid", frag="frag", doc_id="doc_id", text="norm")
    # one row a fragment before it is joined back: k copies of a text do not meet k holders each
    held = pairs.groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).join(unique, "fid").drop("fid")
    return f.join(held, "frag").groupBy("quote_doc").agg(
        F.sum("n").alias("holders"), F.countDistinct("frag").alias("fragments"), F.min("first").alias("first_doc")
    )


@query("V3 F3 F2", f"""
WITH {V.QUOTES}, d AS (SELECT {NORM} AS n FROM documents)
, f AS (SELECT item_id, form, unnest({V.frags('quote')}) AS frag FROM quotes)
, u AS (SELECT DISTINCT frag FROM f), hit AS (SELECT frag, bool_or({V.either('frag', 'n')}) AS found FROM u CROSS JOIN d GROUP BY 1)
SELECT item_id, form, count(*) AS fragments, bool_and(found) AS exists_anywhere FROM f JOIN hit ON hit.frag = f.frag GROUP BY 1, 2""")
def language_exists_anywhere(t: Tables) -> DataFrame:
    f = V.quotes(t).select("item_id", "form", F.explode(X.fragments("quote", "literal")).alias("frag"))
    f = stage(f)
    unique = f.select("frag").distinct().withColumn("fid", F.col("frag"))
    docs = corpus(t)
    plain = J.contained(unique, docs, frag_id="fid", frag="frag", doc_id="doc_id", text="norm").select("fid").distinct()
    # only what the plain search misses is looked for without spaces
    plain = stage(plain)
    missed = unique.join(plain, "fid", "left_anti")
    gapless = J.contained_gapless(missed, docs, frag_id="fid", frag="frag", doc_id="doc_id", text="norm")
    found = plain.unionByName(gapless.select("fid").distinct()).select(F.col("fid").alias("frag"), F.lit(True).alias("hit"))
    return f.join(found, "frag", "left").groupBy("item_id", "form").agg(
        F.count(F.lit(1)).alias("fragments"), F.bool_and(F.col("hit").isNotNull()).alias("exists_anywhere")
    )


# the quotation of an even document is attributed to it, of an odd one to the next document
_ATTRIBUTED = "CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END"
_CASE_TOKENS = (
    "list_distinct(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z''-]{{3,}}'), lambda x: lower(x)), "
    "lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in N.CASE_STOP) + ")))"
)
def _hits_sql(mode: str) -> str:
    return f"""WITH {V.DOC_QUOTES}, d AS (SELECT doc_id, {NORM} AS n, left(trim(left(text, 80)), 90) AS caption FROM documents)
, fr AS (SELECT doc_id, {_ATTRIBUTED} AS att, {V.frags('quote', mode)} AS l, {V.nz('quote')} AS nq FROM doc_quotes)
, fm AS (SELECT doc_id, att, CASE WHEN len(l) = 0 THEN nq ELSE list_filter(l, lambda x: length(x) = list_max(list_transform(l, lambda y: length(y))))[1] END AS frag FROM fr)
, whole AS (SELECT DISTINCT fm.frag, d.doc_id, frag AS probe FROM fm JOIN d ON contains(d.n, frag))
, missed AS (SELECT DISTINCT frag, string_split(frag, ' ') AS w FROM fm WHERE frag NOT IN (SELECT frag FROM whole) AND len(string_split(frag, ' ')) >= 10)
, mid AS (SELECT frag, array_to_string(w[greatest(1, len(w)//2 - 4): greatest(1, len(w)//2 - 4) + 9], ' ') AS probe FROM missed)
, hits AS (SELECT * FROM whole UNION ALL SELECT mid.frag, d.doc_id, probe FROM mid JOIN d ON contains(d.n, probe))
, occ AS (SELECT h.frag, h.doc_id, h.probe, d.caption, len(list_filter(range(1, length(d.n) - length(h.probe) + 2), lambda i: substr(d.n, i, length(h.probe)) = h.probe)) AS n
    FROM hits h JOIN d ON d.doc_id = h.doc_id)
, per AS (SELECT fm.doc_id AS q, fm.att, o.* FROM fm JOIN occ o ON o.frag = fm.frag)"""


def _probes(t: Tables, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quotations (q, att, frag), their fragments numbered (frag, fid), and what documents hold of them (fid, doc_id, probe, n)."""
    quotes = V.doc_quotes(t, whole=False)
    att = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1)
    made = stage(quotes.select(F.col("doc_id").alias("q"), att.alias("att"), X.longest_fragment("quote", mode).alias("frag")))
    frags = S.numbered(made, "frag", "fid")
    return made, frags, S.numbered_hits(frags, corpus(t), "fid", "frag", "doc_id", "norm")


def _caption_names(t: Tables) -> DataFrame:
    caption = F.left(F.trim(F.left("text", F.lit(80))), F.lit(90))
    return t.documents.select("doc_id", N.case_tokens(caption).alias("tokens"))


@query("V4 J9", _hits_sql("literal") + f"""
, j AS (SELECT fm.doc_id AS q, coalesce(CAST(sum(per.n) AS BIGINT), 0) AS hits, coalesce(bool_or(list_has_any({_CASE_TOKENS.format('per.caption')}, {_CASE_TOKENS.format("coalesce(a.caption, '')")})), false) AS own,
    coalesce(bool_or(len(string_split(probe, ' ')) >= 6), false) AS distinctive
  FROM fm LEFT JOIN per ON per.q = fm.doc_id LEFT JOIN d a ON a.doc_id = fm.att GROUP BY 1)
SELECT q, hits, CASE WHEN hits = 0 THEN 'not_in_corpus' WHEN own THEN 'found_in_attributed' WHEN distinctive THEN 'misattributed' ELSE 'generic_phrase_match' END AS cls FROM j""")
def provenance_classes(t: Tables) -> DataFrame:
    """Classes over all holders of a quotation's longest fragment."""
    made, frags, hits = _probes(t, "literal")
    probes, hits = stage(salted_join(made, frags, ["frag"], ["q"], "inner").select("q", "att", "fid")), stage(hits)
    own = S.held_by_attributed(probes, hits, _caption_names(t), "q", "fid", "doc_id", "att").withColumn("own", F.lit(True))
    j = salted_join(probes.select("q", "fid"), S.holders(hits, "fid", "doc_id"), ["fid"], ["q"]).join(own, "q", "left")
    hit = F.coalesce("occurrences", F.lit(0))
    return j.select("q", hit.alias("hits"), D.provenance_class(hit, F.coalesce("own", F.lit(False)), F.coalesce("distinctive", F.lit(False))).alias("cls"))


@query("V5", _hits_sql("strict") + """
, g AS (SELECT q, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT doc_id) AS sources, bool_or(len(string_split(probe, ' ')) >= 6) AS distinctive FROM per GROUP BY 1)
SELECT q, occurrences, sources, distinctive, CASE WHEN sources = 1 THEN 'one' WHEN sources <= 6 THEN 'few' ELSE 'many' END AS spread FROM g""")
def accurate_provenance(t: Tables) -> DataFrame:
    made, frags, hits = _probes(t, "strict")
    held = S.holders(hits, "fid", "doc_id").join(frags, "fid").drop("fid")
    g = salted_join(made.select("q", "frag"), held, ["frag"], ["q"], "inner").drop("frag")
    return g.withColumn("spread", S.spread_class(F.col("sources")))


@query("T3 T4", _hits_sql("literal") + """
, o AS (SELECT frag, doc_id, n, coalesce(sum(n) OVER (PARTITION BY frag ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY frag) AS total FROM occ)
SELECT md5(frag) AS frag_md5, doc_id, CAST(least(n, 3 - before) AS BIGINT) AS shown, CAST(least(total, 25) AS BIGINT) AS counted FROM o WHERE before < 3""")
def first_three_hits(t: Tables) -> DataFrame:
    """The first three occurrences of a fragment, as a report shows them, beside its count up to 25."""
    _, frags, hits = _probes(t, "literal")
    hits = stage(hits.select("fid", "doc_id", "n"))
    shown = S.first_hits(hits, "fid", "doc_id", S.FIRST_HITS)
    counted = hits.groupBy("fid").agg(F.least(F.sum("n"), F.lit(S.COUNT_CAP)).alias("counted"))
    return shown.join(counted, "fid").join(frags, "fid").select(F.md5("frag").alias("frag_md5"), "doc_id", F.col("taken").cast("long").alias("shown"), F.col("counted").cast("long").alias("counted"))


_TWELVE = "CASE WHEN len(w) <= 12 THEN f ELSE array_to_string(w[len(w)//2 - 5: len(w)//2 + 6], ' ') END"


@query("V13 V14 F48", f"""
WITH d AS (SELECT doc_id, {NORM} AS n FROM documents), b AS (SELECT item_id, {NORM} AS f, string_split({NORM}, ' ') AS w FROM benchmark)
, p AS (SELECT item_id, {_TWELVE} AS probe FROM b)
, h AS (SELECT p.item_id, count(d.doc_id) AS hits, min(d.doc_id) AS first_doc, length(any_value(p.probe)) AS len FROM p LEFT JOIN d ON contains(d.n, p.probe) GROUP BY 1)
SELECT item_id, hits, first_doc, hits = 1 AS sole_source, CASE WHEN len < 20 THEN 'indeterminate' WHEN hits > 0 THEN 'verified' ELSE 'record_misattribution' END AS leak FROM h""")
def leak_screen(t: Tables) -> DataFrame:
    p = t.benchmark.select("item_id", X.middle_words(X.normalize("text"), 12).alias("probe"))
    hits = J.contained(p, corpus(t), frag_id="item_id", frag="probe", doc_id="doc_id", text="norm")
    h = p.join(hits, "item_id", "left").groupBy("item_id").agg(
        F.count("doc_id").alias("hits"), F.min("doc_id").alias("first_doc"), F.first("probe").alias("probe")
    )
    return h.select(
        "item_id", "hits", "first_doc", (F.col("hits") == 1).alias("sole_source"),
        D.leak_class(F.col("probe"), F.col("hits") > 0).alias("leak"),
    )


_STOP = ", ".join(f"'{w}'" for w in sorted(set(Q.QUERY_STOP)))


@query("R1 R2 T1", f"""
WITH docs AS (SELECT doc_id, source, 1950 + doc_id % 50 AS yr, text FROM documents)
, dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM docs) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2)
, qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2)
, n AS (SELECT count(*) AS n FROM docs), v AS (SELECT term, ln((1 + n) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM dt CROSS JOIN n GROUP BY term, n HAVING count(*) >= 3 AND count(*) <= n * 0.5)
, dr AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS r FROM dt JOIN v USING (term)), dn AS (SELECT doc_id, sqrt(sum(r*r)) AS nn FROM dr GROUP BY 1)
, qr AS (SELECT item_id, term, (1 + ln(tf)) * idf AS r FROM qt JOIN v USING (term)), qn AS (SELECT item_id, sqrt(sum(r*r)) AS nn FROM qr GROUP BY 1)
, s AS (SELECT item_id, doc_id, round(sum(dr.r / dn.nn * qr.r / qn.nn), 9) AS sim FROM dr JOIN dn USING (doc_id) JOIN qr USING (term) JOIN qn USING (item_id) GROUP BY 1, 2)
, m AS (SELECT item_id, s.doc_id, sim, yr FROM s JOIN docs ON docs.doc_id = s.doc_id WHERE NOT contains(lower(source), concat('src', CAST(item_id % 20 AS VARCHAR))))
, a AS (SELECT 'all' AS list, item_id, doc_id, sim, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS rank FROM m
  UNION ALL SELECT 'pre1970', item_id, doc_id, sim, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) FROM m WHERE yr < 1970)
SELECT list, item_id, doc_id, rank, round(sim, 6) AS score FROM a WHERE rank <= 10""")
def tfidf_top_ten(t: Tables) -> DataFrame:
    lists = F.when(F.col("doc_id") % 50 < 20, F.array(F.lit("all"), F.lit("pre1970"))).otherwise(F.array(F.lit("all")))  # decided in 1950 + doc_id % 50
    docs = spread(t.documents).select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("name"), lists.alias("lists"))
    asked = t.benchmark.select(F.col("item_id").alias("query"), "text", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("party"))
    top = G.top_by_cosine(docs, asked)
    return top.select("list", F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", F.round("sim", 6).alias("score"))


@query("R4", """
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations)
, tm AS (SELECT conv_id, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i+1])))) AS term FROM w)
, h AS (SELECT conv_id, turn, md5(term) AS h FROM tm)
, b AS (SELECT conv_id, turn, CAST(concat('0x', substr(h, 14, 3)) AS INT) % 512 AS bucket, CASE WHEN (CAST(concat('0x', substr(h, 1, 1)) AS INT) & 4) > 0 THEN 1 ELSE -1 END AS s FROM h)
SELECT conv_id, turn, bucket, CAST(sum(s) AS BIGINT) AS weight FROM b GROUP BY 1, 2, 3 HAVING sum(s) <> 0""")
def hashed_bow_vectors(t: Tables) -> DataFrame:
    return Q.hashed_vectors(t.conversations, ["conv_id", "turn"], "text")


@query("R5 T2", """
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations)
, tm AS (SELECT conv_id, turn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i+1])))) AS term FROM w)
, h AS (SELECT conv_id, turn, md5(term) AS h FROM tm)
, v AS (SELECT conv_id, turn, CAST(concat('0x', substr(h, 14, 3)) AS INT) % 512 AS bucket, CAST(sum(CASE WHEN (CAST(concat('0x', substr(h, 1, 1)) AS INT) & 4) > 0 THEN 1 ELSE -1 END) AS BIGINT) AS wt FROM h GROUP BY 1, 2, 3)
, nn AS (SELECT conv_id, turn, CAST(sum(wt * wt) AS BIGINT) AS sq FROM v GROUP BY 1, 2)
, l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
, dot AS (SELECT a.conv_id, b.turn, CAST(sum(a.wt * b.wt) AS BIGINT) AS dp FROM v a JOIN l ON l.conv_id = a.conv_id AND a.turn = l.last JOIN v b ON b.conv_id = a.conv_id AND b.bucket = a.bucket AND b.turn < l.last GROUP BY 1, 2)
, s AS (SELECT dot.conv_id, dot.turn, dp / (sqrt(CAST(q.sq AS DOUBLE)) * sqrt(CAST(p.sq AS DOUBLE))) AS sim FROM dot JOIN l ON l.conv_id = dot.conv_id JOIN nn q ON q.conv_id = dot.conv_id AND q.turn = l.last JOIN nn p ON p.conv_id = dot.conv_id AND p.turn = dot.turn)
, f AS (SELECT conv_id, turn, round(sim, 9) AS sim FROM s WHERE round(sim, 9) >= 0.1)
SELECT conv_id, turn, rank, sim FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sim DESC, turn DESC) AS rank FROM f) WHERE rank <= 5""")
def notebook_top_five(t: Tables) -> DataFrame:
    # the last turn asks; earlier turns of the same conversation are the allowed notes
    v = Q.hashed_vectors(t.conversations, ["conv_id", "turn"], "text")
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    norms = v.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight")).cast("double")).alias("len"))
    asked = v.join(last, "conv_id").filter("turn = last").select("conv_id", "bucket", F.col("weight").alias("qw"))
    ql = norms.join(last, "conv_id").filter("turn = last").select("conv_id", F.col("len").alias("qlen"))
    notes = v.join(last, "conv_id").filter("turn < last").select("conv_id", "turn", "bucket", "weight")
    dot = notes.join(asked, ["conv_id", "bucket"]).groupBy("conv_id", "turn").agg(F.sum(F.col("weight") * F.col("qw")).alias("dp"))
    sim = F.round(F.col("dp") / (F.col("qlen") * F.col("len")), 9)
    s = dot.join(norms, ["conv_id", "turn"]).join(ql, "conv_id").select("conv_id", "turn", sim.alias("sim")).filter("sim >= 0.1")
    order = Window.partitionBy("conv_id").orderBy(F.desc("sim"), F.desc("turn"))
    top = s.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    return top.select("conv_id", "turn", F.col("rank").cast("long").alias("rank"), "sim")


@query("R5 T2", """
WITH e AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, embedding FROM embeddings)
, x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM e)
, c AS (SELECT label, i, avg(x) AS c FROM x GROUP BY 1, 2)
, s AS (SELECT x.label, vec_id, round(sum(x * c) / sqrt(sum(x * x)) / sqrt(sum(c * c)), 6) AS sim FROM x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY 1, 2)
SELECT label, vec_id, rank, sim FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id DESC) AS rank FROM s) WHERE rank <= 5""")
def nearest_to_label_mean(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = (
        e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))  # one entry per dimension
        .select("label", F.transform("l", lambda s: s["x"]).alias("c"))
    )
    length = lambda c: F.sqrt(Q.cosine(c, c))
    sim = F.round(Q.cosine("v", "c") / length("v") / length("c"), 6)
    s = attach(e, means, ["label"], ["vec_id"], "inner").select("label", "vec_id", sim.alias("sim"))
    order = Window.partitionBy("label").orderBy(F.desc("sim"), F.desc("vec_id"))
    top = s.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    return top.select("label", "vec_id", F.col("rank").cast("long").alias("rank"), "sim")


_BARE = "regexp_replace(lower({0}), '^[.,;:()\"''“”]+|[.,;:()\"''“”]+$', '', 'g')"


@query("W7", f"""
WITH {V.DOC_QUOTES}, q AS (SELECT doc_id, quote, {V._W} AS w FROM doc_quotes)
, f AS (SELECT doc_id, w, list_transform(w, lambda x: CAST(list_contains(list_distinct(list_transform(list_filter(string_split(quote, ' '), lambda y: length(y) >= 5), lambda y: {_BARE.format('y')})), {_BARE.format('x')}) AS INT)) AS fl FROM q)
, s AS (SELECT doc_id, w, unnest(list_transform(range(0, greatest(0, len(w) - 45) + 1, 10), lambda i: {{'at': i, 'score': CAST(list_sum(fl[i+1:i+45]) AS BIGINT)}})) AS x FROM f)
SELECT doc_id, x.at AS at, x.score AS score, md5(array_to_string(w[x.at + 1: x.at + 45], ' ')) AS passage_md5 FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x.score DESC, x.at) AS rn FROM s) WHERE rn = 1""")
def closest_passages(t: Tables) -> DataFrame:
    q = V.doc_quotes(t).select("doc_id", "w", Q.quote_terms("quote").alias("terms"))
    b = q.withColumn("b", Q.best_window("w", "terms", Q.PASSAGE, Q.PASSAGE_STEP, Q.QUOTE_EDGE_MARKS))
    return b.select(
        "doc_id", F.col("b.at").cast("long").alias("at"), F.col("b.score").cast("long").alias("score"),
        F.md5(Q.window_text("w", F.col("b.at"), Q.PASSAGE)).alias("passage_md5"),
    )


@query("W7 R3", f"""
WITH {V.DOC_QUOTES}, q AS (SELECT doc_id, {V._W} AS w, list_distinct(list_filter(regexp_extract_all(lower(quote), '[a-z][a-z'']+'), lambda x: length(x) > 3 AND x NOT IN ({_STOP}))) AS terms FROM doc_quotes)
, f AS (SELECT doc_id, w, list_transform(w, lambda x: CAST(list_contains(terms, regexp_replace(lower(x), '^[.,;:()]+|[.,;:()]+$', '', 'g')) AS INT)) AS fl FROM q)
, s AS (SELECT doc_id, unnest(list_transform(range(0, greatest(0, len(w) - 250) + 1, 50), lambda i: {{'at': i, 'score': CAST(list_sum(fl[i+1:i+250]) AS BIGINT)}})) AS x FROM f)
SELECT doc_id, x.at AS at, x.score AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x.score DESC, x.at) AS rn FROM s) WHERE rn = 1""")
def best_excerpt_windows(t: Tables) -> DataFrame:
    terms = F.array_distinct(
        F.filter(
            F.regexp_extract_all(F.lower("quote"), F.lit("[a-z][a-z']+"), F.lit(0)),
            lambda x: (F.length(x) > 3) & ~x.isin(Q.QUERY_STOP),
        )
    )
    q = V.doc_quotes(t).select("doc_id", "w", terms.alias("terms"))
    b = q.select("doc_id", Q.best_window("w", "terms", Q.WINDOW, Q.STEP).alias("b"))
    return b.select("doc_id", F.col("b.at").cast("long").alias("at"), F.col("b.score").cast("long").alias("score"))


@query("R8", f"""
WITH {V.DOC_QUOTES}, p AS (SELECT doc_id, text, {NORM} AS n, strpos({NORM}, {V.nz('quote')}) - 1 AS i FROM doc_quotes)
, j AS (SELECT *, CAST(floor(CAST(i AS DOUBLE) / greatest(1, length(n)) * length(text)) AS INT) AS j FROM p)
SELECT doc_id, md5(CASE WHEN i >= 0 THEN substr(text, greatest(0, j - 300) + 1, j + 300 - greatest(0, j - 300)) END) AS window_md5 FROM j""")
def opinion_windows(t: Tables) -> DataFrame:
    q = V.doc_quotes(t).select("doc_id", "text", "quote", X.normalize("text").alias("n"))
    return q.select("doc_id", F.md5(Q.proportional_window("text", "n", "quote", 600)).alias("window_md5"))


@query("")
def closest_regions_of_failed_quotes(t: Tables) -> DataFrame:
    # as a generated column the two are made once; the filter stays above it
    both = F.struct(X.longest_fragment("quote", "literal").alias("f"), X.normalize("text").alias("n"))
    q = V.doc_quotes(t).select("doc_id", "form", F.explode(F.array(both)).alias("x")).select("doc_id", "form", "x.f", "x.n")
    failed = q.filter(~F.contains(F.col("n"), F.col("f")))
    r = failed.withColumn("r", Q.closest_region("f", "n"))
    return r.select("doc_id", "form", F.col("r.ratio").alias("ratio"), F.col("r.window").alias("window"))


@query("T6 M6", f"WITH {V.DOC_QUOTES}" + f""", f AS (SELECT doc_id, source, form, {V.frags('quote', 'strict')} AS fr, {NORM} AS n FROM doc_quotes)
, v AS (SELECT doc_id, source, form, CASE WHEN len(fr) = 0 THEN 'no_fragment' WHEN len(list_filter(fr, lambda x: NOT {V.either('x', 'n')})) = 0 THEN 'accurate'
   WHEN list_min(list_transform(fr, lambda x: {V.coverage('x', 'n')})) >= 0.85 THEN 'near_miss' ELSE 'inaccurate' END AS verdict FROM f)
SELECT source, count(*) FILTER (form = 'plain') AS named, count(*) FILTER (verdict = 'inaccurate') AS residue, min(CASE WHEN verdict = 'inaccurate' THEN concat('doc ', CAST(doc_id AS VARCHAR), ' (', form, ')') END) AS example FROM v GROUP BY 1""")
def residue_listing(t: Tables) -> DataFrame:
    d = V.doc_quotes(t).select("doc_id", "source", "form", X.fragments("quote", "strict").alias("fr"), X.normalize("text").alias("n"))
    d = d.withColumn("ns", X.nospace("n"))
    v = d.select("doc_id", "source", "form", D.quote_verdict("fr", "n", "ns", paired=F.lit(True), has_text=F.lit(True), allow_omission=False).alias("verdict"))
    bad = F.col("verdict") == "inaccurate"
    line = F.format_string("doc %d (%s)", F.col("doc_id"), F.col("form"))
    return v.groupBy("source").agg(
        F.count_if(F.col("form") == "plain").alias("named"), F.count_if(bad).alias("residue"),
        F.min(F.when(bad, line)).alias("example"),
    )
