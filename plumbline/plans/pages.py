"""Pages, parts and packets from the page HTML and the document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import html as H
from plumbline.functions import names as N
from plumbline.functions import text as X
from plumbline.operators import packets as K
from plumbline.operators import sampling as S
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.session import Tables, spread

# Every paragraph mark of a page becomes a page label; the numbers 100 + i % 9 repeat on long pages.
_LABELLED = (
    "cases_html AS (SELECT page_id, array_to_string(list_transform(range(1, len(string_split(html, '<p>')) + 1), lambda i: "
    "concat(CASE WHEN i > 1 THEN concat('<a class=\"page-label\">*', CAST(100 + (i - 1) % 9 AS VARCHAR), '</a>') ELSE '' END, string_split(html, '<p>')[i])), '') AS html FROM pages)"
)
_PAGES = (
    f"{_LABELLED}, seg AS (SELECT page_id, unnest(range(0, len(string_split(html, 'page-label\">*')))) AS i, string_split(html, 'page-label\">*') AS s FROM cases_html)"
    ", pg AS (SELECT page_id, i, CASE WHEN i = 0 THEN 99 ELSE CAST(regexp_extract(s[i+1], '^\\d+') AS BIGINT) END AS page, "
    "regexp_replace(concat(CASE WHEN i = 0 THEN s[1] ELSE regexp_replace(s[i+1], '^\\d+', '') END, CASE WHEN i + 1 < len(s) THEN '' ELSE '' END), '<a class=\"$', '<a class=\"') AS raw FROM seg)"
    ", pages_of AS (SELECT page_id, page, regexp_replace(raw, '<[^>]+>', ' ', 'g') AS text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, page ORDER BY i DESC) AS rn FROM pg) WHERE rn = 1)"
)


def labelled(t: Tables) -> DataFrame:
    marked = F.transform(
        F.split("html", "<p>"),
        lambda x, i: F.concat(
            F.when(i > 0, F.concat(F.lit('<a class="page-label">*'), (100 + i % 9).cast("string"), F.lit("</a>"))).otherwise(""), x
        ),
    )
    return spread(t.pages).select("page_id", F.array_join(marked, "").alias("html"))


def pages_of(t: Tables) -> DataFrame:
    p = labelled(t).select("page_id", F.explode(H.pages("html", F.lit(99))).alias("p"))
    return p.select("page_id", "p.page", "p.text")


@query("F43 F45", f"WITH {_PAGES} SELECT page_id, page, md5({V.nz('text')}) AS text_md5 FROM pages_of")
def html_pages(t: Tables) -> DataFrame:
    return pages_of(t).select("page_id", "page", F.md5(X.normalize("text")).alias("text_md5"))


_PIN = f""", target AS (SELECT page_id, page, {V.nz('text')} AS n FROM pages_of)
, q AS (SELECT page_id, page AS src, n, string_split(n, ' ') AS w FROM target WHERE len(string_split(n, ' ')) >= 12)
, pins AS (SELECT page_id, src, array_to_string(w[3:12], ' ') AS frag, CASE (page_id + src) % 4 WHEN 0 THEN src WHEN 1 THEN src + 1 WHEN 2 THEN src + 4 ELSE 500 END AS pin FROM q)
, span AS (SELECT page_id, min(page) AS lo, max(page) AS hi FROM target GROUP BY 1)
, j AS (SELECT p.page_id, p.src, p.pin, s.lo, s.hi, bool_or(contains(t.n, frag) AND t.page = pin) AS at_pin, bool_or(contains(t.n, frag) AND abs(t.page - pin) = 1) AS near_pin,
   bool_or(contains(t.n, frag)) AS anywhere FROM pins p JOIN span s ON s.page_id = p.page_id JOIN target t ON t.page_id = p.page_id GROUP BY ALL)"""


@query("V8 F53", f"WITH {_PAGES}{_PIN}" + """
SELECT page_id, src, pin, CASE WHEN pin < lo OR pin > hi THEN 'pin_out_of_span' WHEN at_pin THEN 'quote_at_pin' WHEN near_pin THEN 'quote_near_pin'
  WHEN anywhere THEN 'quote_not_at_pin' ELSE 'quote_absent' END AS verdict FROM j""")
def pin_locations(t: Tables) -> DataFrame:
    from plumbline.operators import pins as O

    norm = pages_of(t).select("page_id", "page", X.normalize("text").alias("n"))
    w = F.split("n", " ")
    shift = F.pmod(F.col("page_id") + F.col("page"), F.lit(4))
    pin = F.when(shift == 0, F.col("page")).when(shift == 1, F.col("page") + 1).when(shift == 2, F.col("page") + 4).otherwise(F.lit(500))
    pins = norm.filter(F.size(w) >= 12).select(
        "page_id", F.col("page").alias("src"), F.array_join(F.slice(w, 3, 10), " ").alias("frag"), pin.cast("long").alias("pin")
    )
    return O.locate(pins, norm, "page_id", ["src", "pin"]).select("page_id", "src", "pin", "verdict")


# head matter, then a majority with its title, then a dissent from the third paragraph on
_PARTS_HTML = (
    "ph AS (SELECT page_id, string_split(replace(replace(html, '<nav>', '<section class=\"head-matter\">'), '<article>', '<article class=\"opinion\" data-type=\"majority\">'), '<p>') AS s FROM pages)"
    ", ptx AS (SELECT page_id, CASE WHEN len(s) >= 4 THEN concat(array_to_string(s[1:3], '<p>'), '<article class=\"opinion\" data-type=\"dissent\">', array_to_string(s[4:], '<p>')) ELSE array_to_string(s, '<p>') END AS html FROM ph)"
    ", pm AS (SELECT page_id, html, regexp_split_to_array(html, '<section class=\"head-matter\">|<article class=\"opinion\" data-type=\"[a-z]+\"') AS seg, "
    "regexp_extract_all(html, '<section class=\"head-matter\">|<article class=\"opinion\" data-type=\"[a-z]+\"') AS mk FROM ptx)"
    ", pr AS (SELECT page_id, unnest(range(0, len(mk))) AS ord, mk, seg FROM pm)"
    ", parts AS (SELECT page_id, ord, CASE WHEN contains(mk[ord+1], 'head-matter') THEN 'head-matter' ELSE regexp_extract(mk[ord+1], 'data-type=\"([a-z]+)\"', 1) END AS part, "
    + V.nz("regexp_replace(concat(mk[ord+1], seg[ord+2]), '<[^>]+>', ' ', 'g')") + " AS text FROM pr)"
)


def part_rows(t: Tables) -> DataFrame:
    swapped = F.replace(
        F.replace("html", F.lit("<nav>"), F.lit('<section class="head-matter">')), F.lit("<article>"),
        F.lit('<article class="opinion" data-type="majority">'),
    )
    s = F.split(swapped, "<p>")
    text = F.when(
        F.size(s) >= 4,
        F.concat(F.array_join(F.slice(s, 1, 3), "<p>"), F.lit('<article class="opinion" data-type="dissent">'),
                 F.array_join(F.slice(s, F.lit(4), F.size(s) - 3), "<p>")),
    ).otherwise(F.array_join(s, "<p>"))
    p = spread(t.pages).select("page_id", F.explode(H.parts(text)).alias("p"))
    return p.select("page_id", F.col("p.ord").cast("long").alias("ord"), "p.part", "p.text")


@query("F46", f"WITH {_PARTS_HTML} SELECT page_id, ord, part, md5(text) AS text_md5 FROM parts")
def opinion_parts(t: Tables) -> DataFrame:
    return part_rows(t).select("page_id", "ord", "part", F.md5("text").alias("text_md5"))


@query("V9 F52", f"WITH {_PARTS_HTML}" + f""", q AS (SELECT page_id, ord, array_to_string(string_split(text, ' ')[4:11], ' ') AS frag FROM parts WHERE len(string_split(text, ' ')) >= 12)
, w AS (SELECT q.page_id, q.ord, bool_or(p.part = 'majority') AS maj, arg_min(p.part, p.ord) AS first_part FROM q JOIN parts p ON p.page_id = q.page_id AND {V.either('q.frag', 'p.text')} GROUP BY 1, 2)
SELECT page_id, ord, CASE WHEN maj THEN 'majority' ELSE first_part END AS part, regexp_matches(CASE WHEN maj THEN 'the court' ELSE concat('Justice ', first_part, 'ing') END, '(?i)dissent|concurr|separate opinion|plurality') AS flagged FROM w""")
def quote_part(t: Tables) -> DataFrame:
    from plumbline.operators import pins as O

    p = part_rows(t)
    w = F.split("text", " ")
    q = p.filter(F.size(w) >= 12).select("page_id", "ord", F.array_join(F.slice(w, 4, 8), " ").alias("frag"))
    located = O.part_of(q, p, "page_id", ["ord"])
    context = F.when(F.col("part") == "majority", "the court").otherwise(F.concat(F.lit("Justice "), F.col("part"), F.lit("ing")))
    return located.select("page_id", "ord", "part", context.rlike(X.SIGNAL_WORDS).alias("flagged"))


@query("F44", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?s)class="ad"[^>]*>(.*?)</', 1), ''), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')) AS head,
  md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS stripped_md5 FROM pages""")
def html_heads(t: Tables) -> DataFrame:
    return spread(t.pages).select("page_id", H.head("html", "ad").alias("head"), F.md5(X.strip_tags("html")).alias("stripped_md5"))


_LINE = (
    "CASE WHEN orderkey % 3 = 0 THEN concat(p, ', Plaintiff, Defendant-Appellant,  v.  ', r, ', Plaintiffs-Appellees.') "
    "WHEN orderkey % 3 = 1 THEN concat(p, ', Petitioner-Appellee, v. ', r, ', Respondents-Appellants') ELSE concat(p, ', Cross-Appellant, v. ', r, ', Appellee.') END"
)


@query("F40", f"WITH {V.CASES}" + f""", s AS (SELECT cluster_id, orderkey, string_split(case_name, ' v. ')[1] AS p, string_split(case_name, ' v. ')[2] AS r FROM cases)
, l AS (SELECT cluster_id, regexp_replace({_LINE}, '\\s+', ' ', 'g') AS line, p, r, orderkey FROM s)
SELECT cluster_id, CASE orderkey % 3 WHEN 0 THEN p WHEN 1 THEN r END AS appellant, CASE orderkey % 3 WHEN 0 THEN r WHEN 1 THEN p END AS appellee FROM l""")
def appeal_parties(t: Tables) -> DataFrame:
    sides = F.split("case_name", r" v\. ")
    s = V.cases(t).select("cluster_id", "orderkey", sides[0].alias("p"), sides[1].alias("r"))
    x = s.select("cluster_id", N.appeal_parties(F.expr(_LINE)).alias("x"))
    return x.select("cluster_id", "x.appellant", "x.appellee")


def _opinions(t: Tables) -> DataFrame:
    """Documents with an analysis heading past their middle and an outcome sentence in each third paragraph."""
    lines = F.split("text", "\n")
    n = F.size(lines)
    told = F.transform(
        lines,
        lambda p, i: F.when(i == F.floor(n / 2), F.concat(F.lit("DISCUSSION "), p))
        .when(i % 3 == 0, F.concat(p, F.lit(" We affirm. "), F.lit("Then more."))).otherwise(p),
    )
    return spread(t.documents).select("doc_id", F.array_join(told, "\n").alias("text"))


@query("F41 F42 W13 M18")
def packets(t: Tables) -> DataFrame:
    # as a generated column the packet is made once; the filter stays above it
    p = _opinions(t).select("doc_id", F.explode(F.array(K.packet("text", 60, 400))).alias("packet")).filter("packet IS NOT NULL")
    return p.select(
        "doc_id", "packet", F.size(X.words("packet")).alias("words"), F.left(F.sha2("packet", 256), F.lit(12)).alias("materials_hash")
    )


@query("", r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: array_to_string(list_filter(string_split(p, '. '),
   lambda x: NOT regexp_matches(x, '(^|[ ,])(ouen|ones|thre|enenst)')), '. ')), lambda p: p <> '') AS kept FROM documents)
SELECT doc_id, len(kept) AS paragraphs, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM s""")
def scrubbed_paragraphs(t: Tables) -> DataFrame:
    clean = lambda p: F.array_join(F.filter(F.split(p, r"\. "), lambda x: ~x.rlike(r"(^|[ ,])(ouen|ones|thre|enenst)")), ". ")
    kept = F.filter(F.transform(F.split("text", "\n"), clean), lambda p: p != "")
    return spread(t.documents).select("doc_id", F.size(kept).cast("long").alias("paragraphs"), F.md5(F.array_join(kept, "\n")).alias("kept_md5"))


@query("")
def quota_selection(t: Tables) -> DataFrame:
    c = V.cases(t).select("cluster_id", "reporter", F.split("case_name", " v")[0].isin("UNITED STATES", "CANADA", "CHINA", "FRANCE").alias("gov"))
    return K.quota_selection(c.withColumn("draw", S.draw_key(20260903, "cluster_id")), "reporter", "gov", "draw", 16)


@query("M13", f"WITH {_PAGES}" + """, s AS (SELECT page_id, page, unnest(string_split(text, '. ')) AS s FROM pages_of), c AS (SELECT DISTINCT page_id, page, s FROM s WHERE length(s) BETWEEN 40 AND 200)
, u AS (SELECT page_id, s, min(page) AS page FROM c GROUP BY 1, 2 HAVING count(*) = 1)
, pn AS (SELECT DISTINCT page_id, page FROM pages_of), far AS (SELECT u.page_id, u.s, u.page, min(p.page) AS far_page FROM u JOIN pn p ON p.page_id = u.page_id AND abs(p.page - u.page) >= 3 GROUP BY 1, 2, 3)
SELECT page_id, md5(s) AS sentence_md5, page, far_page FROM far""")
def unique_page_plants(t: Tables) -> DataFrame:
    p = pages_of(t)
    c = p.select("page_id", "page", F.explode(F.split("text", r"\. ")).alias("s"))
    c = c.filter(F.length("s").between(40, 200)).select("page_id", "page", F.md5("s").alias("sentence_md5")).distinct()
    u = c.groupBy("page_id", "sentence_md5").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("k")).filter("k = 1").drop("k")
    # the lowest page three away is the lowest page of all, or the first one three after
    from plumbline.operators import pins as O

    return O.far_page(u, p.select("page_id", "page").distinct(), "page_id", 3)
