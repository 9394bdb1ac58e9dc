"""Scalar text operators and the labels built from them, over all documents, pages and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import citations as C
from plumbline.functions import names as N
from plumbline.functions import text as X
from plumbline.operators import verdicts as D
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.session import Tables, spread

DQ = f"WITH {V.DOC_QUOTES} "
NORM = V.nz("text")


@query("F1 F2", f"""
SELECT doc_id, md5({NORM}) AS norm_md5, length({NORM}) AS norm_len, length(replace({NORM}, ' ', '')) AS nospace_len
FROM documents""")
def normalize_text(t: Tables) -> DataFrame:
    d = spread(t.documents).select("doc_id", X.normalize("text").alias("n"))
    return d.select(
        "doc_id", F.md5("n").alias("norm_md5"), F.length("n").alias("norm_len"),
        F.length(X.nospace("n")).alias("nospace_len"),
    )


@query("F4 F3", DQ + f"""
SELECT doc_id, form, {V.either(V.nz('quote'), NORM)} AS contained, {V.coverage(V.nz('quote'), NORM)} AS coverage
FROM doc_quotes""")
def token_coverage_of_quotes(t: Tables) -> DataFrame:
    d = V.doc_quotes(t).select(
        "doc_id", "form", X.normalize("quote").alias("q"), X.normalize("text").alias("n")
    ).withColumn("ns", X.nospace("n"))
    return d.select(
        "doc_id", "form", X.contains_either("q", "n", "ns").alias("contained"),
        X.token_coverage("q", "n").alias("coverage"),
    )


@query("F5 F6 F53", DQ + f""", f AS (SELECT doc_id, form, {V.frags('quote')} AS lit, {V.frags('quote', 'strict')} AS str FROM doc_quotes)
SELECT doc_id, form, len(lit) AS n_literal, array_to_string(lit, '|') AS literal,
  len(str) AS n_strict, array_to_string(str, '|') AS strict,
  list_filter(lit, lambda x: length(x) = list_max(list_transform(lit, lambda y: length(y))))[1] AS longest FROM f""")
def quote_fragments(t: Tables) -> DataFrame:
    f = V.doc_quotes(t).select(
        "doc_id", "form", X.fragments("quote", "literal").alias("lit"), X.fragments("quote", "strict").alias("str")
    )
    return f.select(
        "doc_id", "form", F.size("lit").alias("n_literal"), F.array_join("lit", "|").alias("literal"),
        F.size("str").alias("n_strict"), F.array_join("str", "|").alias("strict"), X.longest("lit").alias("longest"),
    )


_STRAIGHT = '"([^"\\n]{20,600})"'
_SMART = "“([^“”]{20,600})”"


def _spans_sql(pattern: str) -> str:
    """SQL list of (start, quote) structs by summed gap and match lengths."""
    hits, gaps = f"regexp_extract_all(text, '{pattern}')", f"regexp_split_to_array(text, '{pattern}')"
    before = (
        f"CAST(coalesce(list_sum(list_transform({gaps}[1:i], lambda g: length(g))), 0) + "
        f"coalesce(list_sum(list_transform({hits}[1:i-1], lambda h: length(h))), 0) AS BIGINT)"
    )
    return (
        f"list_transform(range(1, len({hits}) + 1), lambda i: "
        f"{{'start': {before} + 1, 'quote': substr({hits}[i], 2, length({hits}[i]) - 2)}})"
    )


_QUOTE_ROWS = (
    f"raw AS (SELECT id, unnest({_spans_sql(_SMART)}) AS q FROM txt UNION ALL "
    f"SELECT id, unnest({_spans_sql(_STRAIGHT)}) FROM txt), "
    "spans AS (SELECT DISTINCT id, q.start AS start, q.quote AS quote FROM raw WHERE "
    r"NOT regexp_matches(q.quote, '\n\s*\n|(^|\n)\s*#|\*\*|__') AND NOT regexp_matches(q.quote, '^(\s*[—–)\].,;:]|\s)'))"
)


@query("F7 F8 F9 F10", f"WITH txt AS (SELECT doc_id AS id, text FROM documents), {_QUOTE_ROWS} SELECT id AS doc_id, start, quote FROM spans")
def quotes_in_documents(t: Tables) -> DataFrame:
    q = spread(t.documents).select("doc_id", F.explode(X.quote_spans("text")).alias("q"))
    return q.select("doc_id", F.col("q.start").cast("long").alias("start"), "q.quote")


@query("F7 F10", f"WITH {V.DRAFTS}, txt AS (SELECT draft AS id, text FROM drafts), {_QUOTE_ROWS} SELECT id AS draft, start, quote FROM spans")
def quotes_in_drafts(t: Tables) -> DataFrame:
    q = V.drafts(t).select("draft", F.explode(X.quote_spans("text")).alias("q"))
    return q.select("draft", F.col("q.start").cast("long").alias("start"), "q.quote")


@query("F11", """
SELECT doc_id, len(regexp_extract_all(text, '["“]([^"“”]{20,600})["”]')) AS n,
  array_to_string(regexp_extract_all(text, '["“]([^"“”]{20,600})["”]', 1), '|') AS quotes FROM documents""")
def first_edition_quotes(t: Tables) -> DataFrame:
    hits = F.regexp_extract_all("text", F.lit(X.FIRST_EDITION_QUOTE), F.lit(1))
    return spread(t.documents).select("doc_id", F.size(hits).alias("n"), F.array_join(hits, "|").alias("quotes"))


@query("V1 V20", DQ + f""", f AS (SELECT doc_id, form, lang, {V.frags('quote', 'strict')} AS fr, {NORM} AS n FROM doc_quotes)
SELECT doc_id, form, CASE WHEN lang = 'de' THEN 'unverifiable' WHEN len(fr) = 0 THEN 'no_fragment'
  WHEN len(list_filter(fr, lambda x: NOT {V.either('x', 'n')})) = 0 THEN 'accurate'
  WHEN list_min(list_transform(fr, lambda x: {V.coverage('x', 'n')})) >= 0.85 THEN 'near_miss' ELSE 'inaccurate' END AS verdict
FROM f""")
def quote_verdicts(t: Tables) -> DataFrame:
    d = V.doc_quotes(t).select(
        "doc_id", "form", "lang", X.fragments("quote", "strict").alias("fr"), X.normalize("text").alias("n")
    ).withColumn("ns", X.nospace("n"))
    verdict = D.quote_verdict(
        "fr", "n", "ns", paired=F.lit(True), has_text=F.col("lang") != "de", allow_omission=False
    )
    return d.select("doc_id", "form", verdict.alias("verdict"))


@query("F31 V1")
def quote_verdicts_with_omissions(t: Tables) -> DataFrame:
    # the opinion carries a citation inside the words the quotation drops
    d = V.doc_quotes(t).select(
        "doc_id", "form", X.fragments("quote", "strict").alias("fr"),
        X.normalize(F.regexp_replace("text", r"^((?:\S+\s+){14})", "$1 id at 12 ")).alias("n"),
    ).withColumn("ns", X.nospace("n"))
    verdict = D.quote_verdict("fr", "n", "ns", paired=F.lit(True), has_text=F.lit(True))
    return d.select("doc_id", "form", verdict.alias("verdict"))


@query("V2", f"WITH {V.DOC_QUOTES}" + f""", a AS (SELECT doc_id, form, {V.frags('quote')} AS fr, {NORM} AS n, lang, source FROM doc_quotes)
, nb AS (SELECT doc_id + 5 AS doc_id, {NORM} AS n2 FROM documents)
SELECT a.doc_id, form, CASE WHEN len(fr) = 0 THEN 'not_scored'
  WHEN len(list_filter(fr, lambda x: NOT {V.either('x', 'n')})) = 0 OR (n2 IS NOT NULL AND len(list_filter(fr, lambda x: NOT {V.either('x', 'n2')})) = 0) THEN 'accurate'
  WHEN greatest(list_min(list_transform(fr, lambda x: {V.coverage('x', 'n')})),
       coalesce(list_min(list_transform(fr, lambda x: {V.coverage('x', 'n2')})), 0)) >= 0.85 THEN 'near_miss' ELSE 'inaccurate' END AS verdict
FROM a LEFT JOIN nb ON nb.doc_id = a.doc_id""")
def two_candidate_verdicts(t: Tables) -> DataFrame:
    # two candidate opinions per quotation: its own document and the fifth before it
    near = spread(t.documents).select((F.col("doc_id") + 5).alias("doc_id"), X.normalize("text").alias("n2"))
    d = V.doc_quotes(t).select(
        "doc_id", "form", X.fragments("quote", "literal").alias("fr"), X.normalize("text").alias("n")
    ).join(near, "doc_id", "left").withColumn("ns", X.nospace("n")).withColumn("n2s", X.nospace("n2"))
    whole = lambda n, ns: F.forall("fr", lambda f: X.contains_either(f, n, ns))
    cover = F.greatest(D.lowest_coverage("fr", "n"), F.coalesce(D.lowest_coverage("fr", "n2"), F.lit(0.0)))
    return d.select(
        "doc_id", "form",
        F.when(F.size("fr") == 0, "not_scored").when(whole("n", "ns") | F.coalesce(whole("n2", "n2s"), F.lit(False)), "accurate")
        .when(cover >= X.NEAR_MISS_AT, "near_miss").otherwise("inaccurate").alias("verdict"),
    )


@query("V6 F15", DQ + f""", f AS (SELECT doc_id, lang, source, quote AS q, {NORM} AS n FROM doc_quotes)
, g AS (SELECT *, CASE WHEN len({V.frags('q')}) > 0 THEN {V.frags('q')} ELSE [{V.nz('q')}] END AS fr FROM f)
SELECT doc_id, CASE WHEN lang = 'fr' THEN 'out_of_scope_non_us' WHEN source = 'src0' THEN 'no_text'
  WHEN list_max(list_transform(fr, lambda x: {V.coverage('x', 'n')})) >= 0.5 THEN 'paraphrase_in_quotes'
  ELSE 'fabricated_language' END AS cls FROM g""")
def failure_decomposition(t: Tables) -> DataFrame:
    d = V.doc_quotes(t).select("doc_id", "lang", "source", F.col("quote").alias("q"), X.normalize("text").alias("n"))
    fr = X.fragments("q", "literal")
    d = d.withColumn("fr", F.when(F.size(fr) > 0, fr).otherwise(F.array(X.normalize("q"))))
    return d.select(
        "doc_id",
        D.decomposition(F.col("lang") != "fr", F.col("source") != "src0", D.highest_coverage("fr", "n")).alias("cls"),
    )


@query("V12 F49", DQ + f""", f AS (SELECT form, quote, {V.frags('quote')} AS fr, {NORM} AS n FROM doc_quotes)
, v AS (SELECT quote, CASE WHEN len(list_filter(fr, lambda x: NOT {V.either('x', 'n')})) = 0 THEN 'accurate'
    WHEN list_min(list_transform(fr, lambda x: {V.coverage('x', 'n')})) >= 0.85 THEN 'near_miss' ELSE 'inaccurate' END AS verdict FROM f WHERE len(fr) > 0)
SELECT concat(CASE WHEN regexp_matches(quote, '\\[[^\\]]*\\]|\\.\\s?\\.\\s?\\.|…') THEN 'altered_' ELSE 'unaltered_' END, verdict) AS cause, count(*) AS n
FROM v WHERE verdict <> 'accurate' GROUP BY 1""")
def failure_causes(t: Tables) -> DataFrame:
    d = V.doc_quotes(t).select("quote", X.fragments("quote", "literal").alias("fr"), X.normalize("text").alias("n"))
    d = d.filter(F.size("fr") > 0).withColumn("ns", X.nospace("n"))
    v = d.select(
        "quote",
        D.quote_verdict("fr", "n", "ns", paired=F.lit(True), has_text=F.lit(True), allow_omission=False).alias("verdict"),
    ).filter("verdict <> 'accurate'")
    return v.groupBy(D.failure_cause("quote", "verdict").alias("cause")).agg(F.count(F.lit(1)).alias("n"))


_MIDDLE = """CASE WHEN len(w) < 10 THEN n ELSE array_to_string(w[greatest(1, len(w)//2 - 4): greatest(1, len(w)//2 - 4) + 9], ' ') END"""


@query("F47 F48", f"""
WITH d AS (SELECT doc_id, {NORM} AS n, string_split({NORM}, ' ') AS w FROM documents)
SELECT doc_id, md5({_MIDDLE}) AS ten, md5(CASE WHEN len(w) <= 8 THEN n ELSE array_to_string(w[len(w)//2 - 3: len(w)//2 + 4], ' ') END) AS eight,
  md5(CASE WHEN len(w) <= 12 THEN n ELSE array_to_string(w[len(w)//2 - 5: len(w)//2 + 6], ' ') END) AS twelve FROM d""")
def middle_windows(t: Tables) -> DataFrame:
    d = spread(t.documents).select("doc_id", X.normalize("text").alias("n"))
    return d.select(
        "doc_id", F.md5(X.middle_words("n", 10, only_from=10)).alias("ten"),
        F.md5(X.middle_words("n", 8)).alias("eight"), F.md5(X.middle_words("n", 12)).alias("twelve"),
    )


@query("F33", """
WITH d AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)
SELECT doc_id, md5(CASE WHEN length(s) <= 1000 THEN s ELSE concat(regexp_replace(left(s, 750), '\\s+$', ''), ' [...] ',
  regexp_replace(right(s, 250), '^\\s+', '')) END) AS excerpt_md5 FROM d""")
def head_tail_excerpts(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", F.md5(X.head_tail("text", 1000, " [...] ")).alias("excerpt_md5"))


@query("F38 F39", """
SELECT lang, count(*) AS drafts,
  count(*) FILTER (regexp_matches(text, '(?i)\\b(I cannot|I can''t|I am unable|I''m unable|I must decline)\\b')) AS refusals,
  count(*) FILTER (len(list_filter(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w: w <> '')) < 100) AS short
FROM documents GROUP BY 1""")
def refusals_and_short_texts(t: Tables) -> DataFrame:
    return spread(t.documents).groupBy("lang").agg(
        F.count(F.lit(1)).alias("drafts"), F.count_if(F.col("text").rlike(X.REFUSAL)).alias("refusals"),
        F.count_if(F.size(X.words("text")) < 100).alias("short"),
    )


@query("F20 F21", f"WITH {V.DRAFTS}" + r""", u AS (SELECT draft, concat(text, CASE WHEN draft % 3 = 0 THEN ' [2015] UKSC 11, ECLI:EU:C' WHEN draft % 3 = 1 THEN ' C-123/45' ELSE '' END) AS text FROM drafts)
, h AS (SELECT draft, list_concat(list_concat(regexp_extract_all(text, '\[\d{4}\]\s+(UKSC|UKHL|EWCA|EWHC|UKPC)\b'), regexp_extract_all(text, '\bECLI:[A-Z]{2}:')), regexp_extract_all(text, '\bC-\d+/\d{2}\b')) AS hits FROM u)
SELECT draft, len(hits) AS n, array_to_string(hits, ';') AS hits, len(hits) > 0 AS is_foreign FROM h""")
def foreign_citations(t: Tables) -> DataFrame:
    tail = F.when(F.col("draft") % 3 == 0, " [2015] UKSC 11, ECLI:EU:C").when(F.col("draft") % 3 == 1, " C-123/45").otherwise("")
    u = V.drafts(t).select("draft", F.concat("text", tail).alias("text"))
    h = u.select("draft", C.foreign_hits("text").alias("h"), C.is_foreign("text").alias("is_foreign"))
    return h.select("draft", F.size("h").alias("n"), F.array_join("h", ";").alias("hits"), "is_foreign")


_SHORT = ", ".join(f"'{w}'" for w in N.SHORT_STOP)
_CASE = ", ".join(f"'{w}'" for w in N.CASE_STOP)


@query("F22 F23", f"WITH {V.CASES}" + f"""
SELECT cluster_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(case_name), '[A-Za-z][A-Za-z.''-]+'),
   lambda x: trim(x, '.,''')), lambda x: x NOT IN ({_SHORT})))), ' ') AS short_tokens,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(case_name, '[A-Za-z][A-Za-z''-]{{3,}}'), lambda x: lower(x)),
   lambda x: x NOT IN ({_CASE})))), ' ') AS case_tokens FROM cases""")
def party_name_tokens(t: Tables) -> DataFrame:
    return V.cases(t).select(
        "cluster_id", F.array_join(F.array_sort(N.short_tokens("case_name")), " ").alias("short_tokens"),
        F.array_join(F.array_sort(N.case_tokens("case_name")), " ").alias("case_tokens"),
    )


@query("F14 F15 F16 F17", f"WITH {V.CASES}, {V.CLAIMS}" + """
SELECT reporter, replace(replace(reporter,' ',''),'.','') AS rep_key, upper(replace(replace(reporter,' ',''),'.','')) AS text_key,
  upper(replace(replace(reporter,' ',''),'.','')) = 'WL' AS vendor,
  CASE WHEN replace(reporter,' ','') IN ('U.S.','S.Ct.','L.Ed.','L.Ed.2d') THEN 'scotus' WHEN starts_with(replace(reporter,' ',''),'F.Supp') THEN 'federal-district'
    WHEN starts_with(replace(reporter,' ',''),'F.') THEN 'federal-appellate' ELSE 'state-or-other' END AS tier, count(*) AS n
FROM claims GROUP BY ALL""")
def reporter_spellings(t: Tables) -> DataFrame:
    # counted by spelling first; the expressions then run once per spelling
    n = V.claims(t).groupBy("reporter").agg(F.count(F.lit(1)).alias("n"))
    return n.select(
        "reporter", C.reporter_key("reporter").alias("rep_key"), C.text_key("reporter").alias("text_key"),
        C.is_vendor("reporter").alias("vendor"), C.court_tier("reporter").alias("tier"), "n",
    )


@query("F32", f"WITH {V.CASES}, {V.CLAIMS}" + r""", p AS (SELECT draft, ord, part, supp, CASE WHEN pin_page IS NULL THEN NULL WHEN ord % 3 = 0 THEN concat(CAST(pin_page AS VARCHAR), '-', right(CAST(pin_page + 3 AS VARCHAR), 2))
   WHEN ord % 3 = 1 THEN concat(CAST(pin_page AS VARCHAR), ', ', CAST(pin_page + 6 AS VARCHAR)) ELSE concat('at ', CAST(pin_page AS VARCHAR), ' to ', CAST(pin_page + 2 AS VARCHAR)) END AS pin, pin_page FROM claims)
, r AS (SELECT *, regexp_extract_all(pin, '(\d+)\s*(?:-|–|to)\s*(\d+)', 1)[1] AS a, regexp_extract_all(pin, '(\d+)\s*(?:-|–|to)\s*(\d+)', 2)[1] AS b FROM p)
, e AS (SELECT *, CASE WHEN CAST(b AS BIGINT) < CAST(a AS BIGINT) THEN CAST(concat(left(a, length(a) - length(CAST(CAST(b AS BIGINT) AS VARCHAR))), CAST(CAST(b AS BIGINT) AS VARCHAR)) AS BIGINT) ELSE CAST(b AS BIGINT) END AS hi FROM r)
SELECT draft, ord, part, supp, CAST(nullif(regexp_extract(pin, '\d+'), '') AS BIGINT) AS first_pin,
  array_to_string(CASE WHEN a IS NOT NULL AND hi >= CAST(a AS BIGINT) AND hi - CAST(a AS BIGINT) <= 40 THEN range(CAST(a AS BIGINT), hi + 1)
    ELSE list_transform(regexp_extract_all(pin, '\d+'), lambda d: CAST(d AS BIGINT)) END, ',') AS pages FROM e""")
def pin_pages(t: Tables) -> DataFrame:
    # ranges with the leading digits dropped, lists, and "to" ranges
    p, s = F.col("pin_page"), lambda c: c.cast("string")
    pin = (
        F.when(F.col("ord") % 3 == 0, F.concat(s(p), F.lit("-"), F.right(s(p + 3), F.lit(2))))
        .when(F.col("ord") % 3 == 1, F.concat(s(p), F.lit(", "), s(p + 6)))
        .otherwise(F.concat(F.lit("at "), s(p), F.lit(" to "), s(p + 2)))
    )
    d = V.claims(t).select("draft", "ord", "part", "supp", pin.alias("pin"))
    pages = F.array_join(F.transform(C.pin_pages("pin"), lambda x: x.cast("string")), ",")
    return d.select("draft", "ord", "part", "supp", C.first_pin("pin").alias("first_pin"), pages.alias("pages"))


@query("F35 F34", f"WITH {V.DRAFTS}" + """, v AS (SELECT draft, text, case_name, string_split(case_name, ' v. ')[1] AS p, string_split(case_name, ' v. ')[2] AS r FROM drafts)
SELECT draft, md5(regexp_replace(CASE WHEN p = 'UNITED STATES' THEN text ELSE
   list_reduce(list_concat([text], list_sort(list_distinct(list_concat([p], list_filter(regexp_extract_all(p, '[A-Za-z][A-Za-z''-]{3,}'), lambda x: lower(x) NOT IN ('united','states')))), 'DESC')),
   lambda acc, x: regexp_replace(acc, concat('(?i)', x), 'Petitioner', 'g')) END, concat('(?i)', r), 'Respondent', 'g')) AS masked_md5 FROM v""")
def masked_drafts(t: Tables) -> DataFrame:
    sides = F.split("case_name", r" v\. ")
    v = V.drafts(t).select("draft", "text", sides[0].alias("p"), sides[1].alias("r"))
    once = N.mask("text", N.mask_terms("p"), "Petitioner")
    return v.select("draft", F.md5(N.mask(once, N.mask_terms("r"), "Respondent")).alias("masked_md5"))


@query("F36 A30 A31 I11", """
WITH votes AS (SELECT d.doc_id, quality, concat('first {"stronger": "', CASE WHEN n_chars % 2 = 0 THEN 'petitioner' ELSE 'respondent' END, '"} then {"stronger": "',
   CASE WHEN n_chars > 1500 THEN 'petitioner' ELSE 'respondent' END, '"}') AS a,
   concat('{"stronger": "', CASE WHEN n_chars % 3 = 0 THEN 'petitioner' WHEN n_chars % 3 = 1 THEN 'respondent' ELSE 'unsure' END, '"}') AS b FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
, p AS (SELECT doc_id, quality, list_extract(regexp_extract_all(a, '"stronger"\\s*:\\s*"(petitioner|respondent)"', 1), -1) AS va,
    list_extract(regexp_extract_all(b, '"stronger"\\s*:\\s*"(petitioner|respondent)"', 1), -1) AS vb FROM votes)
, m AS (SELECT *, CASE WHEN va = vb OR vb IS NULL THEN va ELSE NULL END AS winner FROM p)
SELECT quality, count(*) AS items, count(winner) AS decided, count(*) FILTER (va = vb) AS agree, count(vb) AS both_voted,
  CAST(count(*) FILTER ((winner = 'petitioner') = (quality = 1) AND winner IS NOT NULL) AS DOUBLE) / nullif(count(winner), 0) AS accuracy
FROM m GROUP BY 1""")
def panel_votes(t: Tables) -> DataFrame:
    from plumbline.operators import votes as O

    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    say = lambda c: F.concat(F.lit('{"stronger": "'), c, F.lit('"}'))
    two = F.when(F.col("n_chars") % 2 == 0, "petitioner").otherwise("respondent")
    size = F.when(F.col("n_chars") > 1500, "petitioner").otherwise("respondent")
    three = F.when(F.col("n_chars") % 3 == 0, "petitioner").when(F.col("n_chars") % 3 == 1, "respondent").otherwise("unsure")
    raw = d.select("quality", F.concat(F.lit("first "), say(two), F.lit(" then "), say(size)).alias("a"), say(three).alias("b"))
    p = raw.select("quality", O.last_verdict("a").alias("va"), O.last_verdict("b").alias("vb"))
    m = p.withColumn("winner", O.majority(["va", "vb"], "petitioner", "respondent"))
    right = (F.col("winner") == "petitioner") == (F.col("quality") == 1)
    return m.groupBy("quality").agg(
        F.count(F.lit(1)).alias("items"), F.count("winner").alias("decided"),
        F.count_if(F.col("va") == F.col("vb")).alias("agree"), F.count("vb").alias("both_voted"),
        O.calibration(right, F.col("winner")).alias("accuracy"),
    )


@query("F37", """
SELECT conv_id, turn, CASE WHEN trim(text) = '' OR contains(upper(left(text, 40)), 'NO LESSON') OR regexp_matches(text, '(?i)\\[insert') THEN false
  ELSE CAST(regexp_matches(text, '(?i)situations? like x\\b') AS INT) + CAST(regexp_matches(text, '(?i)tactic y\\b') AS INT) + CAST(regexp_matches(text, '(?i)because z\\b') AS INT) < 2 END AS accepted
FROM conversations""")
def accepted_lessons(t: Tables) -> DataFrame:
    from plumbline.operators import votes as O

    return t.conversations.select("conv_id", "turn", O.accept_lesson("text").alias("accepted"))


@query("M2", r"""
SELECT doc_id, md5(CASE WHEN regexp_matches(text, 'tion|ung') THEN substr(text, length(regexp_split_to_array(text, 'tion|ung')[1]) + 1) ELSE text END) AS body_md5 FROM documents""")
def text_from_marker(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", F.md5(X.from_marker("text", "tion|ung")).alias("body_md5"))


@query("M18", DQ + f"""
SELECT doc_id, substr(sha256(text), 1, 12) AS materials_hash, substr(sha256(quote), 1, 12) AS quote_hash FROM doc_quotes""")
def material_hashes(t: Tables) -> DataFrame:
    h = lambda c: F.left(F.sha2(c, 256), F.lit(12))
    return V.doc_quotes(t).select("doc_id", h(F.col("text")).alias("materials_hash"), h(F.col("quote")).alias("quote_hash"))


@query("M12", r"""
WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\.\s+')) AS s FROM documents)
SELECT doc_id, count(*) AS sentences, count(*) FILTER (length(s) BETWEEN 60 AND 200 AND regexp_matches(s, '^[A-Z][A-Za-z ,]+$')) AS clean,
  count(*) FILTER (contains(s, ',')) AS with_comma FROM s GROUP BY 1""")
def clean_sentences(t: Tables) -> DataFrame:
    s = F.split("text", r"\.\s+")
    clean = F.filter(s, lambda x: F.length(x).between(60, 200) & x.rlike("^[A-Z][A-Za-z ,]+$"))
    comma = F.filter(s, lambda x: F.contains(x, F.lit(",")))
    return spread(t.documents).select(
        "doc_id", F.size(s).cast("long").alias("sentences"), F.size(clean).cast("long").alias("clean"),
        F.size(comma).cast("long").alias("with_comma"),
    )


@query("F54 M1", f"WITH {V.CASES}, {V.INDEX}" + """
, picked AS (SELECT volume, concat(case_name, ', ', volume, ' ', reporter, ' ', page, ' (', left(date_filed, 4), ')') AS item, date_filed,
    row_number() OVER (PARTITION BY volume ORDER BY date_filed, cluster_id) AS i FROM cases WHERE status <> 'P')
SELECT volume, string_agg(concat(CAST(i AS VARCHAR), '. ', item), chr(10) ORDER BY i) AS block FROM picked WHERE i <= 10 GROUP BY 1""")
def numbered_authority_block(t: Tables) -> DataFrame:
    from plumbline.operators.cells import top_per_group

    c = V.cases(t).filter("status <> 'P'").select(
        "volume", "date_filed", "cluster_id",
        F.expr("concat(case_name, ', ', volume, ' ', reporter, ' ', page, ' (', left(date_filed, 4), ')')").alias("item"),
    )
    top = top_per_group(c, ["volume"], [F.col("date_filed"), F.col("cluster_id")], 10, "i")  # ten per block
    lines = F.array_sort(F.collect_list(F.struct("i", F.concat(F.col("i").cast("string"), F.lit(". "), F.col("item")).alias("s"))))
    return top.groupBy("volume").agg(F.array_join(F.transform(lines, lambda x: x["s"]), "\n").alias("block"))


@query("X5", f"""
WITH b AS (SELECT item_id, {V._W} AS w FROM benchmark)
SELECT item_id, array_to_string(w, ' ') AS genuine, concat('not ', array_to_string(w, ' ')) AS negated,
  array_to_string(list_concat(list_concat(w[1:2], ['zyxwv']), w[4:]), ' ') AS swapped,
  array_to_string(list_concat(w[1:2], w[6:]), ' ') AS dropped FROM b""")
def seeded_corruptions(t: Tables) -> DataFrame:
    from plumbline.operators import sampling as S

    return S.corruptions(t.benchmark.select("item_id", X.words("text").alias("w")), "item_id", "w")
