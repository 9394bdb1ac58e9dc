"""Views that present the given tables in the shape of claims, verdict records, indexes and drafts.

Each view is one select list in SQL that Spark and the oracle both read, so
that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import dealt
from plumbline.session import Tables

CONDITIONS = ["baseline", "quota", "temporal", "stakes", "combo"]

# --- verdict records from events --------------------------------------------
_RECORDS = [
    "event_id AS rid",
    "concat('m', CAST(event_id % 7 AS STRING)) AS model",
    "user_id % 48 AS matter",
    "CASE event_type WHEN 'view' THEN 'baseline' WHEN 'click' THEN 'quota' WHEN 'signup' THEN 'temporal' "
    "WHEN 'error' THEN 'stakes' ELSE 'combo' END AS condition",
    "CASE WHEN event_id % 3 = 0 THEN 'citation' ELSE 'quote' END AS kind",
    "CASE WHEN event_id % 3 = 0 THEN "
    "CASE WHEN value < 5 THEN 'not_found' WHEN value > 150 THEN 'unresolvable' ELSE 'exists' END ELSE "
    "CASE WHEN value < 15 THEN 'inaccurate' WHEN value < 25 THEN 'near_miss' WHEN value < 100 THEN 'accurate' "
    "WHEN value < 140 THEN 'unverifiable' ELSE 'unpaired' END END AS verdict",
    "CASE event_id % 8 WHEN 0 THEN 'U.S.' WHEN 1 THEN 'F.3d' WHEN 2 THEN 'F. Supp. 2d' WHEN 3 THEN 'S. Ct.' "
    "WHEN 4 THEN 'Cal. App. 4th' WHEN 5 THEN 'L. Ed. 2d' WHEN 6 THEN 'N.L.R.B.' ELSE 'F.2d' END AS reporter",
    "user_id % 19 AS volume",
    "event_id % 23 AS page",
    "1940 + (user_id + event_id) % 70 AS year",
    "CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS template",
    "event_id % 3 AS run",
]
RECORDS = f"records AS (SELECT {', '.join(_RECORDS)} FROM events)"


def records(t: Tables) -> DataFrame:
    return t.events.selectExpr(*_RECORDS)


# --- citation index, cluster metadata and claimed citations -----------------
_CASES = [
    "o_orderkey AS cluster_id",
    "CAST(o_custkey % 100 AS STRING) AS volume",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'U.S.' WHEN '2-HIGH' THEN 'F.2d' WHEN '3-MEDIUM' THEN 'F. Supp.' "
    "WHEN '4-NOT SPECIFIED' THEN 'L. Ed. 2d' ELSE 'N.L.R.B.' END AS reporter",
    "CAST(1 + o_orderkey % 997 AS STRING) AS page",
    "concat(n_name, ' v. ', c_mktsegment) AS case_name",
    "CAST(CAST(o_orderdate - INTERVAL '29' YEAR AS DATE) AS STRING) AS date_filed",
    "o_orderstatus AS status",
    "o_orderkey AS orderkey",
]
CASES = (
    f"cases AS (SELECT {', '.join(_CASES)} FROM orders LEFT JOIN customer ON o_custkey = c_custkey "
    "LEFT JOIN nation ON c_nationkey = n_nationkey)"
)
# the index holds what is decided; the labour board's reporter is not carried
INDEX = (
    "idx AS (SELECT volume, reporter, page, cluster_id FROM cases WHERE status <> 'P' AND reporter <> 'N.L.R.B.'), "
    "clusters AS (SELECT cluster_id, case_name, date_filed FROM cases)"
)
_CLAIMS = [
    "l_orderkey AS draft",
    "l_linenumber AS ord",
    "l_partkey AS part",
    "l_suppkey AS supp",
    "volume",
    "CASE WHEN l_discount = 0 THEN 'WL' WHEN l_linenumber % 2 = 1 THEN replace(replace(reporter, ' ', ''), '.', '') "
    "ELSE reporter END AS reporter",
    "CASE WHEN l_quantity = 1 THEN NULL ELSE page END AS page",
    "CASE WHEN l_returnflag = 'R' THEN concat('Doe v. ', l_linestatus, 'livia Holdings') ELSE case_name END AS claimed",
    "CAST(year(l_shipdate) - 29 AS BIGINT) AS paren_year",
    "CASE WHEN l_tax = 0 THEN NULL ELSE CAST(page AS BIGINT) + l_linenumber END AS pin_page",
    "CASE WHEN l_linestatus = 'O' THEN 'temporal' ELSE 'baseline' END AS condition",
]
CLAIMS = f"claims AS (SELECT {', '.join(_CLAIMS)} FROM lineitem JOIN cases ON l_orderkey = orderkey)"
KEY_SQL = "replace(replace(reporter, ' ', ''), '.', '')"
RESOLVED = (
    f"keyed AS (SELECT volume, {KEY_SQL} AS rep_key, page, min(cluster_id) AS cluster_id FROM idx GROUP BY 1, 2, 3), "
    f"covered AS (SELECT DISTINCT {KEY_SQL} AS rep_key FROM idx), "
    "resolved AS (SELECT c.*, k.cluster_id, x.case_name, x.date_filed, "
    "v.rep_key IS NOT NULL AS covered, "
    "CASE WHEN c.volume IS NULL OR c.page IS NULL OR c.reporter = 'WL' OR v.rep_key IS NULL THEN 'unresolvable' "
    "WHEN k.cluster_id IS NULL THEN 'not_found' ELSE 'exists' END AS verdict "
    f"FROM (SELECT *, {KEY_SQL} AS rep_key FROM claims) c "
    "LEFT JOIN keyed k ON k.volume = c.volume AND k.rep_key = c.rep_key AND k.page = c.page "
    "LEFT JOIN clusters x ON x.cluster_id = k.cluster_id LEFT JOIN covered v ON v.rep_key = c.rep_key)"
)
RESOLUTION = f"{CASES}, {INDEX}, {CLAIMS}, {RESOLVED}"
ROW_ID = ["draft", "ord", "part", "supp"]


def cases(t: Tables) -> DataFrame:
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .selectExpr(*_CASES)
    )


def index(t: Tables) -> DataFrame:
    return (
        cases(t).filter("status <> 'P' AND reporter <> 'N.L.R.B.'").select("volume", "reporter", "page", "cluster_id")
    )


def clusters(t: Tables) -> DataFrame:
    return cases(t).select("cluster_id", "case_name", "date_filed")


def claims(t: Tables) -> DataFrame:
    return dealt(t.lineitem, ["l_orderkey"]).join(cases(t), F.col("l_orderkey") == F.col("orderkey")).selectExpr(*_CLAIMS)


# --- SQL renderings of the text functions, for the oracles ------------------
def nz(x: str) -> str:
    """SQL of the normaliser, written out step by step."""
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(" + x + r"), '\[([^\]]*)\]', '\1', 'g'), "
        "'[‘’'']', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


def frags(x: str, mode: str = "literal") -> str:
    """SQL of the fragment list."""
    split = r"\.\s?\.\s?\.|…"
    if mode == "strict":
        x = (
            f"regexp_replace({x}, '\\((emphasis (added|in original|omitted)|citations? omitted|"
            "internal quotation marks (and citations? )?omitted|cleaned up|footnote omitted|"
            "alterations? (in original|omitted))\\)', ' ', 'gi')"
        )
        split += r"|\[[^\]]*\]"
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{split}'), lambda p: {nz('p')}), lambda p: length(p) >= 15)"


def coverage(f: str, t: str) -> str:
    """SQL of token coverage."""
    long_words = f"list_filter(string_split({f}, ' '), lambda w: length(w) >= 5)"
    return (
        f"(CASE WHEN len({long_words}) = 0 THEN 0.0 ELSE "
        f"CAST(len(list_filter({long_words}, lambda w: contains({t}, w))) AS DOUBLE) / len({long_words}) END)"
    )


def either(f: str, t: str) -> str:
    return f"(contains({t}, {f}) OR contains(replace({t}, ' ', ''), replace({f}, ' ', '')))"


# --- quotations and corpus --------------------------------------------------
# Every benchmark passage is checked against the documents; an ellipsis, an
# alteration and a corrupted copy are derived from each one.
QUOTES = (
    "quotes AS (SELECT item_id, 'plain' AS form, text AS quote FROM benchmark UNION ALL "
    "SELECT item_id, 'ellipsis', regexp_replace(text, '^(\\S+\\s+\\S+\\s+\\S+\\s+\\S+)\\s+', '\\1 ... ') FROM benchmark UNION ALL "
    "SELECT item_id, 'altered', regexp_replace(text, '^(\\S+)\\s+\\S+\\s+(\\S+)', '\\1 [word] \\2') FROM benchmark UNION ALL "
    "SELECT item_id, 'dropped', regexp_replace(text, '^(\\S+\\s+\\S+)\\s+\\S+\\s+\\S+', '\\1') FROM benchmark)"
)


def quotes(t: Tables) -> DataFrame:
    b = t.benchmark
    sub = lambda pattern, into: F.regexp_replace("text", pattern, into)
    forms = {
        "plain": F.col("text"),
        "ellipsis": sub(r"^(\S+\s+\S+\s+\S+\s+\S+)\s+", "$1 ... "),
        "altered": sub(r"^(\S+)\s+\S+\s+(\S+)", "$1 [word] $2"),
        "dropped": sub(r"^(\S+\s+\S+)\s+\S+\s+\S+", "$1"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("quote")) for k, v in forms.items()]))
    return b.select("item_id", each.alias("q")).select("item_id", "q.form", "q.quote")


# --- quotations taken from the documents themselves -------------------------
# Words 6 to 25 of every document with at least 25 words, quoted verbatim, with
# an ellipsis, with an alteration, with words dropped, or with the halves
# swapped, by the document's number.
_W = r"regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')"
DOC_QUOTES = (
    f"dw AS (SELECT doc_id, lang, source, text, {_W} AS w FROM documents), "
    "doc_quotes AS (SELECT doc_id, lang, source, text, "
    "CASE doc_id % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'ellipsis' WHEN 2 THEN 'altered' WHEN 3 THEN 'dropped' ELSE 'swapped' END AS form, "
    "CASE doc_id % 5 WHEN 0 THEN array_to_string(w[6:25], ' ') "
    "WHEN 1 THEN concat(array_to_string(w[6:13], ' '), ' ... ', array_to_string(w[18:25], ' ')) "
    "WHEN 2 THEN concat(array_to_string(w[6:12], ' '), ' [the Court] ', array_to_string(w[15:25], ' ')) "
    "WHEN 3 THEN concat(array_to_string(w[6:12], ' '), ' ', array_to_string(w[15:25], ' ')) "
    "ELSE concat(array_to_string(w[16:25], ' '), ' ', array_to_string(w[6:15], ' ')) END AS quote "
    "FROM dw WHERE len(w) >= 25)"
)


def doc_quotes(t: Tables, whole: bool = True) -> DataFrame:
    """Without ``whole`` the text is not taken apart beyond the words that are quoted: ``w`` ends with all that follows them."""
    from plumbline.functions.text import words
    from plumbline.session import spread

    # as a generated column the words are made once; the filter stays above it
    w = spread(t.documents).withColumn("w", F.explode(F.array(words("text", None if whole else 25)))).filter(F.size("w") >= 25)
    part = lambda a, b: F.array_join(F.slice("w", a, b - a + 1), " ")
    form = F.array(*[F.lit(x) for x in ("plain", "ellipsis", "altered", "dropped", "swapped")])
    kind = F.get(form, F.col("doc_id") % 5)
    quote = (
        F.when(kind == "plain", part(6, 25))
        .when(kind == "ellipsis", F.concat(part(6, 13), F.lit(" ... "), part(18, 25)))
        .when(kind == "altered", F.concat(part(6, 12), F.lit(" [the Court] "), part(15, 25)))
        .when(kind == "dropped", F.concat_ws(" ", part(6, 12), part(15, 25)))
        .otherwise(F.concat_ws(" ", part(16, 25), part(6, 15)))
    )
    return w.select("doc_id", "lang", "source", "text", kind.alias("form"), quote.alias("quote"), "w")


# --- drafts: one per order, written from its case and a document ------------
_CITE = "concat(volume, ' ', reporter, ' ', page)"
_DRAFT = [
    "orderkey AS draft",
    "concat(CASE status "
    f"WHEN 'F' THEN concat('In ', case_name, ', ', {_CITE}, ', ', page, ' (', left(date_filed, 4), '), the Court held that “', q1, '.”') "
    f"WHEN 'O' THEN concat('One court explained that “', q1, '.” ', case_name, ', ', {_CITE}, ' (', left(date_filed, 4), ').') "
    f"ELSE concat('See ', case_name, ', ', {_CITE}, ' (holding that “', q1, '”).') END, "
    "chr(10), chr(10), CASE orderkey % 4 "
    "WHEN 0 THEN concat('Section 7 of the Act provides that “', q2, '.”') "
    "WHEN 1 THEN concat('The opinion adds that “', q2, '.” Id. at ', page, '.') "
    "WHEN 2 THEN concat('Nothing is cited here, but “', q2, '” is often repeated.') "
    f"ELSE concat(case_name, ', ', {_CITE}, ', 12 S. Ct. ', page, ', 3 L. Ed. 2d ', page, ' (', left(date_filed, 4), '), said “', q2, '.”') END) AS text",
    "doc_id", "opinion", "volume", "reporter", "page", "case_name", "q1", "q2", "status",
]
DRAFTS = (
    f"{CASES}, src AS (SELECT doc_id, text AS opinion, array_to_string(w[6:19], ' ') AS q1, array_to_string(w[20:32], ' ') AS q2 "
    f"FROM (SELECT doc_id, text, {_W} AS w FROM documents)), n AS (SELECT count(*) AS nd FROM documents), "
    f"drafts AS (SELECT {', '.join(_DRAFT)} FROM cases CROSS JOIN n JOIN src ON src.doc_id = orderkey % nd)"
)


def drafts(t: Tables) -> DataFrame:
    from plumbline.functions.text import words
    from plumbline.session import spread

    part = lambda a, b: F.array_join(F.slice("w", a, b - a + 1), " ")
    src = t.documents.withColumn("w", words("text")).select(
        "doc_id", F.col("text").alias("opinion"), part(6, 19).alias("q1"), part(20, 32).alias("q2")
    )
    n = t.documents.agg(F.count(F.lit(1)).alias("nd"))
    numbered = spread(cases(t)).crossJoin(F.broadcast(n)).withColumn("doc_id", F.col("orderkey") % F.col("nd"))
    return numbered.join(src, "doc_id").selectExpr(*_DRAFT)
