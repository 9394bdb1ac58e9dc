"""Revision episodes on the conversations: a conversation is an episode, its assistant turns are the drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rates as R
from plumbline.functions import text as X
from plumbline.operators import episodes as O
from plumbline.operators import resolve as P
from plumbline.operators import verdicts as D
from plumbline.operators.skew import salted_join
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.session import Tables, stage

_ARM = "CASE conv_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'scrambled' WHEN 2 THEN 'none' WHEN 3 THEN 'half' WHEN 4 THEN 'quarter' ELSE 'threequarter' END"
# long words stand for citations; those with an odd number of letters do not resolve
_WORDS = (
    f"rounds AS (SELECT conv_id, {_ARM} AS arm, turn, text FROM conversations WHERE role = 'assistant')"
    ", lastr AS (SELECT conv_id, arm, min(turn) AS t0, max(turn) AS t1 FROM rounds GROUP BY 1, 2)"
    ", items AS (SELECT DISTINCT conv_id, arm, turn, w, CASE WHEN length(w) % 2 = 1 THEN 'not_found' ELSE 'exists' END AS verdict FROM "
    "(SELECT conv_id, arm, turn, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM rounds))"
)


def rounds(t: Tables) -> DataFrame:
    return t.conversations.filter("role = 'assistant'").selectExpr("conv_id", f"{_ARM} AS arm", "turn", "text")


def items(t: Tables) -> DataFrame:
    w = rounds(t).select("conv_id", "arm", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("w"))
    return w.distinct().withColumn("verdict", F.when(F.length("w") % 2 == 1, "not_found").otherwise("exists"))


def ends(t: Tables) -> DataFrame:
    return rounds(t).groupBy("conv_id", "arm").agg(F.min("turn").alias("t0"), F.max("turn").alias("t1"))


@query("S8 W4", f"WITH {_WORDS} SELECT r.conv_id, l.t1 AS last_round, md5(r.text) AS final_md5 FROM lastr l JOIN rounds r ON r.conv_id=l.conv_id AND r.turn=l.t1")
def final_revisions(t: Tables) -> DataFrame:
    return O.last_revision(rounds(t), ["conv_id"], "turn", "text").select("conv_id", "last_round", F.md5("final").alias("final_md5"))


@query("J19 E5", f"WITH {_WORDS}" + """
, a AS (SELECT i.conv_id, i.arm, w, verdict FROM items i JOIN lastr l ON l.conv_id=i.conv_id AND i.turn=l.t0), b AS (SELECT i.conv_id, i.arm, w, verdict FROM items i JOIN lastr l ON l.conv_id=i.conv_id AND i.turn=l.t1)
, j AS (SELECT coalesce(a.arm, b.arm) AS arm, a.verdict AS v0, b.verdict AS v1 FROM a FULL JOIN b ON a.conv_id=b.conv_id AND a.w=b.w)
SELECT arm, count(*) FILTER (v0='not_found') AS nf_r0, count(*) FILTER (v0='not_found' AND v1 IS NULL) AS nf_removed, count(*) FILTER (v0='not_found' AND v1 IS NOT NULL) AS nf_kept,
  count(*) FILTER (v0 IS NULL) AS new_n, count(*) FILTER (v0 IS NULL AND v1='exists') AS new_exists, count(*) FILTER (v0 IS NULL AND v1<>'exists') AS new_other FROM j GROUP BY 1""")
def existence_trace(t: Tables) -> DataFrame:
    i = salted_join(items(t), ends(t), ["conv_id", "arm"], ["turn", "w"], "inner")
    per = O.trace(i.filter("turn = t0"), i.filter("turn = t1"), ["conv_id", "arm"], "w", "verdict")
    names = ["nf_r0", "nf_removed", "nf_kept", "new_n", "new_exists", "new_other"]
    return per.groupBy("arm").agg(*[F.sum(n).alias(n) for n in names])


@query("E3", f"WITH {_WORDS}" + """
SELECT conv_id, arm, turn, count(*) AS n_citations, CAST(count(*) FILTER (verdict='exists') AS DOUBLE) / count(*) AS existence_rate, count(*) FILTER (verdict='not_found') AS true_left FROM items GROUP BY 1, 2, 3""")
def round_summaries(t: Tables) -> DataFrame:
    return items(t).groupBy("conv_id", "arm", "turn").agg(
        F.count(F.lit(1)).alias("n_citations"), R.share(F.count_if(F.col("verdict") == "exists"), F.count(F.lit(1))).alias("existence_rate"),
        F.count_if(F.col("verdict") == "not_found").alias("true_left"),
    )


_LEFT = """, s AS (SELECT r.conv_id, r.arm, r.turn, count(i.w) FILTER (i.verdict='not_found' AND length(i.w) > 11) AS true_left FROM rounds r LEFT JOIN items i ON i.conv_id=r.conv_id AND i.turn=r.turn GROUP BY 1, 2, 3)
, e AS (SELECT conv_id, arm, count(*) AS n, arg_max(true_left, turn) AS left_last, arg_min(true_left, turn) AS left_first FROM s GROUP BY 1, 2)"""


def _episodes(t: Tables) -> DataFrame:
    bad = items(t).filter("verdict = 'not_found' AND length(w) > 11").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("k"))
    s = rounds(t).select("conv_id", "arm", "turn").join(bad, ["conv_id", "turn"], "left").withColumn("true_left", F.coalesce("k", F.lit(0)))
    return s.groupBy("conv_id", "arm").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("true_left", "turn").alias("left_last"), F.min_by("true_left", "turn").alias("left_first")
    )


@query("E2 A21 A35", f"WITH {_WORDS}{_LEFT}" + """
SELECT arm, count(*) AS episodes, count(*) FILTER (left_last = 0) AS converged, count(*) FILTER (left_last > 0 AND n > 3) AS cap_exhausted,
  CAST(sum(left_first) AS BIGINT) AS r0_problems, CAST(sum(left_last) AS BIGINT) AS final_problems, count(*) FILTER (left_first > 0 AND left_last = 0) AS cleaned FROM e GROUP BY 1""")
def episode_outcomes(t: Tables) -> DataFrame:
    e = _episodes(t).withColumn("o", O.outcome(F.col("left_last"), F.col("n")))
    return e.groupBy("arm").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("o.converged")).alias("converged"),
        F.count_if(F.col("o.cap_exhausted")).alias("cap_exhausted"), F.sum("left_first").alias("r0_problems"),
        F.sum("left_last").alias("final_problems"), F.count_if((F.col("left_first") > 0) & (F.col("left_last") == 0)).alias("cleaned"),
    )


# quotations of a draft: its sentences of five words or more; the first word stands for the citation
_SENT = (
    f"qs AS (SELECT conv_id, arm, turn, list_filter(list_transform(regexp_split_to_array(text, '[.]\\s+'), lambda s: {V.nz('s')}), lambda s: len(string_split(s, ' ')) >= 5) AS q, {V.nz('text')} AS n FROM rounds)"
)


def sentence_quotes(t: Tables) -> DataFrame:
    norms = F.filter(F.transform(F.split("text", r"[.]\s+"), X.normalize), lambda s: F.size(F.split(s, " ")) >= 5)
    as_quote = lambda s: F.struct(
        s.alias("norm"), F.array_distinct(F.split(s, " ")).alias("toks"), F.split(s, " ")[0].alias("citation"),
        (F.length(s) % 3 != 0).alias("ok"),
    )
    return rounds(t).select("conv_id", "arm", "turn", F.transform(norms, as_quote).alias("q"), X.normalize("text").alias("n"))


@query("V10 U4 A27")
def quotation_fates(t: Tables) -> DataFrame:
    q = sentence_quotes(t)
    pair = q.groupBy("conv_id", "arm").agg(
        F.min_by("q", "turn").alias("q0"), F.max_by("q", "turn").alias("q1"), F.max_by("n", "turn").alias("n1")
    )
    f = pair.withColumn("f", O.fates("q0", "q1", "n1"))
    rows = f.select("conv_id", "arm", F.posexplode("f.fates").alias("ord", "x"), "q0", "q1")
    was = F.when(F.get("q0", F.col("ord"))["ok"], "accurate").otherwise("flagged")
    now = F.get("q1", F.col("x.at"))["ok"]
    return rows.select("conv_id", "arm", "ord", was.alias("was"), F.col("x.fate").alias("fate"), F.when(now, "accurate").when(~now, "flagged").alias("now"))


@query("V10 F48", f"WITH {_WORDS}, {_SENT}" + """
, a AS (SELECT q.conv_id, q.arm, unnest(q.q) AS s FROM qs q JOIN lastr l ON l.conv_id=q.conv_id AND q.turn=l.t0), z AS (SELECT q.conv_id, q.q, q.n FROM qs q JOIN lastr l ON l.conv_id=q.conv_id AND q.turn=l.t1)
, d AS (SELECT DISTINCT conv_id, arm, s FROM a), j AS (SELECT d.arm, list_contains(z.q, d.s) AS kept, string_split(d.s, ' ') AS w, d.s, z.n FROM d JOIN z ON z.conv_id=d.conv_id)
SELECT arm, count(*) AS quotations, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept AND contains(n, CASE WHEN len(w) <= 8 THEN s ELSE array_to_string(w[len(w)//2-3:len(w)//2+4], ' ') END)) AS words_survive FROM j GROUP BY 1""")
def kept_and_surviving_words(t: Tables) -> DataFrame:
    q = sentence_quotes(t).join(ends(t), ["conv_id", "arm"])
    a = q.filter("turn = t0").select("conv_id", "arm", F.explode("q.norm").alias("s")).distinct()
    z = q.filter("turn = t1").select("conv_id", F.col("q.norm").alias("q"), "n")
    j = a.join(z, "conv_id").withColumn("kept", F.array_contains("q", F.col("s")))
    return j.groupBy("arm").agg(
        F.count(F.lit(1)).alias("quotations"), F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept") & F.contains("n", X.middle_words("s", 8))).alias("words_survive"),
    )


@query("E4 A26 W14 I15", f"WITH {_WORDS}" + """
, a AS (SELECT i.conv_id, i.arm, i.w FROM items i JOIN lastr l ON l.conv_id=i.conv_id AND i.turn=l.t0 WHERE verdict='exists'), z AS (SELECT i.conv_id, i.w FROM items i JOIN lastr l ON l.conv_id=i.conv_id AND i.turn=l.t1)
, n AS (SELECT conv_id, arm, count(*) AS rounds FROM rounds GROUP BY 1, 2), r AS (SELECT arm, count(*) AS episodes, CAST(sum(rounds) AS BIGINT) AS rounds FROM n GROUP BY 1)
, c AS (SELECT a.arm, count(*) AS acc_r0, count(*) FILTER (z.w IS NULL) AS removed FROM a LEFT JOIN z ON z.conv_id=a.conv_id AND z.w=a.w GROUP BY 1)
SELECT c.arm, episodes, CAST(rounds AS DOUBLE) / episodes AS mean_rounds, acc_r0, removed, CAST(removed AS DOUBLE) / rounds AS removed_per_round, CAST(removed AS DOUBLE) / acc_r0 AS removed_share FROM c JOIN r ON r.arm=c.arm""")
def removal_rates(t: Tables) -> DataFrame:
    return _removal(t)


def _removal(t: Tables) -> DataFrame:
    i = salted_join(items(t), ends(t), ["conv_id", "arm"], ["turn", "w"], "inner")
    a = i.filter("turn = t0 AND verdict = 'exists'").select("conv_id", "arm", "w")
    z = i.filter("turn = t1").select("conv_id", "w", F.lit(1).alias("still"))
    c = a.join(z, ["conv_id", "w"], "left").groupBy("arm").agg(F.count(F.lit(1)).alias("acc_r0"), F.count_if(F.col("still").isNull()).alias("removed"))
    r = rounds(t).groupBy("conv_id", "arm").agg(F.count(F.lit(1)).alias("k")).groupBy("arm").agg(F.count(F.lit(1)).alias("episodes"), F.sum("k").alias("rounds"))
    return c.join(r, "arm").select(
        "arm", "episodes", R.share(F.col("rounds"), F.col("episodes")).alias("mean_rounds"), "acc_r0", "removed",
        R.share(F.col("removed"), F.col("rounds")).alias("removed_per_round"), R.share(F.col("removed"), F.col("acc_r0")).alias("removed_share"),
    )


@query("W11", f"WITH {V.RECORDS}" + """
, a AS (SELECT model, condition, CASE condition WHEN 'baseline' THEN 1.0 WHEN 'quota' THEN 0.75 WHEN 'temporal' THEN 0.5 ELSE 0.25 END::DOUBLE AS x,
   CAST(count(*) FILTER (verdict='inaccurate') AS DOUBLE) / nullif(count(*) FILTER (kind='quote'), 0) AS y FROM records WHERE condition <> 'combo' GROUP BY 1, 2)
, g AS (SELECT model, CAST(count(*) FILTER (verdict='inaccurate') AS DOUBLE) / nullif(count(*) FILTER (kind='quote'), 0) AS target FROM records WHERE condition = 'combo' GROUP BY 1)
, n AS (SELECT a.model, x, y, target, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM a JOIN g ON g.model=a.model WINDOW w AS (PARTITION BY a.model ORDER BY x DESC))
SELECT model, round(arg_max(x + (target - y) * (x2 - x) / (y2 - y), x), 9) AS crossing FROM n WHERE (y - target) * (y2 - target) <= 0 AND y <> y2 GROUP BY 1""")
def interpolated_crossing(t: Tables) -> DataFrame:
    wrong = R.share(F.count_if(F.col("verdict") == "inaccurate"), F.count_if(F.col("kind") == "quote"))
    g = V.records(t).groupBy("model", "condition").agg(wrong.alias("y"))
    target = g.filter("condition = 'combo'").select("model", F.col("y").alias("target"))
    nominal = F.create_map(*[F.lit(v) for pair in {"baseline": 1.0, "quota": 0.75, "temporal": 0.5, "stakes": 0.25}.items() for v in pair])
    points = g.filter("condition <> 'combo'").withColumn("x", nominal[F.col("condition")]).join(target, "model")
    return O.crossing(points, ["model"], "x", "y", "target").select("model", F.round("crossing", 9).alias("crossing"))


@query("E1", f"WITH {V.RESOLUTION}" + """
, l AS (SELECT draft, ord, part, supp, concat(volume, ' ', reporter, ' ', page) AS c, verdict FROM resolved)
SELECT draft, ord, part, supp, md5(concat('The citation ', c, ' does not correspond to any real case: it does not resolve in the court reporter database. Remove it or replace it with real authority.')) AS line_md5 FROM l WHERE verdict = 'not_found'""")
def citation_feedback(t: Tables) -> DataFrame:
    r = P.resolve(V.claims(t), V.index(t), V.clusters(t), V.ROW_ID).filter("verdict = 'not_found'")
    return r.select(*V.ROW_ID, F.md5(O.citation_line(F.concat_ws(" ", "volume", "reporter", "page"))).alias("line_md5"))


@query("E1 W7 X2 X3")
def feedback_arms(t: Tables) -> DataFrame:
    """Lines of every arm for the quotations that fail in their own document."""
    from plumbline.operators import retrieval as Q
    from plumbline.operators import sampling as S

    q = V.doc_quotes(t).select("doc_id", "source", "quote", "w", X.fragments("quote", "strict").alias("fr"), X.normalize("text").alias("n"))
    verdict = D.quote_verdict("fr", "n", X.nospace("n"), paired=F.lit(True), has_text=F.lit(True), allow_omission=False)
    v = q.select("doc_id", "source", "quote", "w", F.explode(F.array(verdict)).alias("verdict"))
    failed = F.col("verdict").isin("inaccurate", "near_miss")
    passage = X.let(
        Q.best_window(F.col("w"), Q.quote_terms("quote"), Q.PASSAGE, Q.PASSAGE_STEP, Q.QUOTE_EDGE_MARKS), lambda b: Q.window_text("w", b["at"], Q.PASSAGE)
    )
    # both branches read the quotations with their verdicts and passages, not the texts
    v = stage(v.select("doc_id", "source", "quote", "verdict", F.when(failed, passage).alias("passage")).filter(failed | (F.col("verdict") == "accurate")))
    ok = v.filter("verdict = 'accurate'").groupBy("source").agg(F.min_by("quote", S.draw_key(3, "doc_id")).alias("ok_quote"))
    best = v.filter(failed)
    lines = best.join(ok, "source", "left").select(
        "doc_id", O.quote_line("quote", "source").alias("true_line"),
        O.quote_line("quote", "source", F.col("passage")).alias("passage_line"),
        F.when(F.col("ok_quote").isNotNull(), O.quote_line("ok_quote", "source")).alias("scrambled_line"), S.uniform(4, "doc_id").alias("u"),
    )
    mixed = lambda p: F.when(F.col("u") < p, F.col("true_line")).otherwise(F.coalesce("scrambled_line", "true_line"))
    return lines.select(
        "doc_id", "true_line", "passage_line", "scrambled_line", mixed(0.25).alias("quarter_line"), mixed(0.5).alias("half_line"),
        mixed(0.75).alias("threequarter_line"),
    )


@query("E6 A28", f"WITH {_WORDS}" + """
, f AS (SELECT l.arm, l.conv_id, count(i.w) AS scored, count(i.w) FILTER (i.verdict='exists') AS ok FROM lastr l LEFT JOIN items i ON i.conv_id=l.conv_id AND i.turn=l.t1 AND length(i.w) > 11 GROUP BY 1, 2)
SELECT arm, count(*) FILTER (scored = 0) AS empty_final, count(*) FILTER (scored > 0) AS scored_final, round(avg(CAST(ok AS DOUBLE) / nullif(scored, 0)), 9) AS mean_strict FROM f GROUP BY 1""")
def empty_final_drafts(t: Tables) -> DataFrame:
    z = items(t).filter("length(w) > 11").withColumnRenamed("turn", "t1")
    g = z.groupBy("conv_id", "t1").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("verdict") == "exists").alias("ok"))
    f = ends(t).join(g, ["conv_id", "t1"], "left")
    return f.groupBy("arm").agg(
        F.count_if(F.col("scored").isNull()).alias("empty_final"), F.count("scored").alias("scored_final"),
        F.round(F.avg(R.share(F.col("ok"), F.col("scored"))), 9).alias("mean_strict"),
    )


@query("E7 V15 I15", f"WITH {V.RECORDS}" + """
, f AS (SELECT model, verdict, value, event_id FROM records JOIN events ON rid = event_id WHERE kind='quote')
, v AS (SELECT model, CASE WHEN verdict NOT IN ('inaccurate','near_miss') THEN 'unflagged' WHEN event_id % 11 = 0 THEN 'unverifiable' WHEN value < 20 AND event_id % 5 = 0 THEN 'true_misattributed' WHEN value < 20 THEN 'true' ELSE 'false' END AS truth FROM f)
SELECT model, count(*) FILTER (truth <> 'unflagged') AS lines, count(*) FILTER (truth = 'true') AS true_n, count(*) FILTER (truth = 'true_misattributed') AS misattributed_n, count(*) FILTER (truth = 'unverifiable') AS unverifiable_n,
  CAST(count(*) FILTER (truth IN ('true','true_misattributed')) AS DOUBLE) / nullif(count(*) FILTER (truth <> 'unflagged'), 0) AS realised_precision FROM v GROUP BY 1""")
def realised_precision(t: Tables) -> DataFrame:
    """Lines written under the first rule, judged again under a stricter one."""
    e = t.events.select(F.col("event_id").alias("rid"), "value")
    f = V.records(t).filter("kind = 'quote'").join(e, "rid")
    flagged = F.col("verdict").isin("inaccurate", "near_miss")
    truth = D.feedback_truth(flagged, F.col("rid") % 11 == 0, F.col("value") < 20, F.col("rid") % 5 == 0)
    v = f.select("model", flagged.alias("flagged"), truth.alias("truth"))
    n = lambda *x: F.count_if(F.col("flagged") & F.col("truth").isin(*x))
    return v.groupBy("model").agg(
        F.count_if("flagged").alias("lines"), n("true").alias("true_n"), n("true_misattributed").alias("misattributed_n"),
        n("unverifiable").alias("unverifiable_n"), R.share(n("true", "true_misattributed"), F.count_if("flagged")).alias("realised_precision"),
    )


_EXAM = """, x AS (SELECT model, run, template, CAST(count(*) FILTER (verdict='exists') AS DOUBLE) / nullif(count(*) FILTER (verdict IN ('exists','not_found')), 0) AS exist,
   CAST(count(*) FILTER (verdict='accurate') AS DOUBLE) / nullif(count(*) FILTER (verdict IN ('accurate','near_miss','inaccurate')), 0) AS strict,
   CAST(count(*) FILTER (verdict='unresolvable') AS DOUBLE) / nullif(count(*) FILTER (kind='citation'), 0) AS unres, count(*) FILTER (kind='citation') AS n, count(*) FILTER (verdict='accurate') AS wins FROM records GROUP BY 1, 2, 3)
, best AS (SELECT model, run, max(exist) OVER (PARTITION BY model ORDER BY run) AS anchor FROM x WHERE template='B')"""


def _exams(t: Tables) -> DataFrame:
    cited = F.count_if(F.col("kind") == "citation")
    return V.records(t).groupBy("model", "run", "template").agg(
        R.existence_rate().alias("exist"), R.strict_rate().alias("strict"),
        R.share(F.count_if(F.col("verdict") == "unresolvable"), cited).alias("unres"), cited.alias("n"),
        F.count_if(F.col("verdict") == "accurate").alias("wins"),
    )


@query("A32 E9", f"WITH {V.RECORDS}{_EXAM}" + " SELECT b.model, b.run, x.exist, x.strict, x.n, b.anchor FROM best b JOIN x ON x.model=b.model AND x.run=b.run AND x.template='B'")
def exam_anchors(t: Tables) -> DataFrame:
    return O.best_so_far(_exams(t).filter("template = 'B'"), ["model"], "run", "exist", "anchor").select("model", "run", "exist", "strict", "n", "anchor")


@query("V19 M10 E8", f"WITH {V.RECORDS}{_EXAM}" + """
, g AS (SELECT w.model, w.run, w.wins > o.wins AS usefulness, (w.exist IS NULL OR o.exist IS NULL OR w.exist >= o.exist) AND (w.strict IS NULL OR o.strict IS NULL OR w.strict >= o.strict) AS not_worse,
   w.exist IS NULL OR b.anchor IS NULL OR w.exist >= b.anchor - 0.1::DOUBLE AS no_drift, coalesce(w.unres, 0) <= 0.1::DOUBLE AS resolvable, w.n >= 10 AS enough
  FROM x w JOIN x o ON o.model=w.model AND o.run=w.run AND o.template='B' JOIN best b ON b.model=w.model AND b.run=w.run WHERE w.template='A')
SELECT *, usefulness AND not_worse AND no_drift AND resolvable AND enough AS admit FROM g""")
def gate_decisions(t: Tables) -> DataFrame:
    x = _exams(t)
    best = O.best_so_far(x.filter("template = 'B'"), ["model"], "run", "exist", "anchor").select("model", "run", "anchor")
    o = x.filter("template = 'B'").select("model", "run", F.col("exist").alias("e0"), F.col("strict").alias("s0"), F.col("wins").alias("w0"))
    j = x.filter("template = 'A'").join(o, ["model", "run"]).join(best, ["model", "run"])
    c = F.col
    checks = {
        "usefulness": c("wins") > c("w0"),
        "not_worse": D.not_worse(c("exist"), c("e0")) & D.not_worse(c("strict"), c("s0")),
        "no_drift": D.near_anchor(c("exist"), c("anchor"), O.DRIFT),
        "resolvable": F.coalesce("unres", F.lit(0.0)) <= O.UNRESOLVABLE_CEILING,
        "enough": c("n") >= O.MIN_CITATIONS,
    }
    return j.select("model", "run", *O.gate(checks))


@query("V20 A33", f"WITH {V.DOC_QUOTES}, f AS (SELECT source, {V.frags('quote')} AS fr, {V.nz('text')} AS n FROM doc_quotes)" + f"""
, b AS (SELECT source, len(list_filter(fr, lambda x: NOT {V.either('x', 'n')})) AS offending FROM f)
SELECT source, count(*) AS notes, count(*) FILTER (offending = 0) AS grounded, CAST(count(*) FILTER (offending > 0) AS DOUBLE) / count(*) AS contamination FROM b GROUP BY 1""")
def grounded_notes(t: Tables) -> DataFrame:
    f = V.doc_quotes(t).select("source", X.fragments("quote", "literal").alias("fr"), X.normalize("text").alias("n")).withColumn("ns", X.nospace("n"))
    b = f.select("source", F.size(F.filter("fr", lambda x: ~X.contains_either(x, "n", "ns"))).alias("offending"))
    return b.groupBy("source").agg(
        F.count(F.lit(1)).alias("notes"), F.count_if(F.col("offending") == 0).alias("grounded"),
        R.share(F.count_if(F.col("offending") > 0), F.count(F.lit(1))).alias("contamination"),
    )


@query("M11", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS side_md5, count(*) AS turns FROM conversations WHERE role = 'assistant' GROUP BY 1")
def side_texts(t: Tables) -> DataFrame:
    # a side speaks once per turn: the list is as long as the conversation has turns
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    g = rounds(t).groupBy("conv_id").agg(said.alias("l"), F.count(F.lit(1)).alias("turns"))
    return g.select("conv_id", F.md5(F.array_join(F.transform("l", lambda x: x["text"]), "\n")).alias("side_md5"), "turns")


@query("W10", """
WITH u AS (SELECT conv_id, turn, role FROM conversations)
SELECT conv_id, turn, coalesce(lead(turn, 1) OVER w, lag(turn, 1) OVER w) AS first_probe, coalesce(lead(turn, 2) OVER w, lag(turn, 2) OVER w) AS second_probe FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def probe_turns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = lambda k: F.coalesce(F.lead("turn", k).over(w), F.lag("turn", k).over(w))
    return t.conversations.select("conv_id", "turn", near(1).alias("first_probe"), near(2).alias("second_probe"))
