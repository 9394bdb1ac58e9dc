"""Own parties among the sources of doubtful quotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.operators.overlap import overlap_pairs
from plumbline.plans.registry import query
from plumbline.session import Tables, spread, union_all

_CASE = ", ".join(f"'{w}'" for w in N.CASE_STOP)


def _tokens(x: str) -> str:
    return (
        f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z''-]{{3,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_CASE})))"
    )


# A matter is a customer, its packet names nation and segment as parties; a hit is a line of the
# customer's orders, its source is named after the supplier's nation and the kind of the part.
PARTIES = "parties AS (SELECT c_custkey AS matter, concat(n_name, ' v. ', c_mktsegment) AS own FROM customer JOIN nation ON n_nationkey = c_nationkey)"
HITS = (
    "hits AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS hit, o_custkey AS matter, concat('m', CAST(l_linenumber AS STRING)) AS model, "
    "CASE WHEN l_linestatus = 'O' THEN 'temporal' ELSE 'baseline' END AS condition, "
    "concat(CAST(CAST(floor(year(o_orderdate) / 10) AS BIGINT) * 10 AS STRING), 's') AS decade, "
    "CASE l_returnflag WHEN 'N' THEN 'found_in_attributed' WHEN 'R' THEN 'misattributed' ELSE 'generic_phrase_match' END AS cls, "
    "concat('In re ', n_name, ' ', p_type, ' Holdings') AS sources "
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey)"
)


def hits(t: Tables) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_name")
    lines = (
        spread(t.lineitem).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    )
    return lines.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS hit", "o_custkey AS matter", "concat('m', CAST(l_linenumber AS STRING)) AS model",
        "CASE WHEN l_linestatus = 'O' THEN 'temporal' ELSE 'baseline' END AS condition",
        "concat(CAST(CAST(floor(year(o_orderdate) / 10) AS BIGINT) * 10 AS STRING), 's') AS decade",
        "CASE l_returnflag WHEN 'N' THEN 'found_in_attributed' WHEN 'R' THEN 'misattributed' ELSE 'generic_phrase_match' END AS cls",
        "concat('In re ', n_name, ' ', p_type, ' Holdings') AS sources",
    )


def parties(t: Tables) -> DataFrame:
    own = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return own.select(F.col("c_custkey").alias("matter"), F.concat("n_name", F.lit(" v. "), "c_mktsegment").alias("own"))


@query("J22", f"WITH {PARTIES}, {HITS}" + f"""
, leaks AS (SELECT hits.* FROM hits JOIN parties USING (matter) WHERE cls IN ('misattributed', 'generic_phrase_match')
    AND list_has_any({_tokens('own')}, {_tokens('sources')}))
SELECT model, unnest([condition, decade, 'TOTAL']) AS grp, count(*) AS leaks FROM leaks GROUP BY 1, 2""")
def party_leaks(t: Tables) -> DataFrame:
    doubtful = hits(t).where(F.col("cls").isin("misattributed", "generic_phrase_match"))
    own = parties(t).select("matter", F.col("matter").alias("packet"), N.case_tokens("own").alias("tokens"))
    sources = doubtful.select("matter", F.struct("hit", "model", "condition", "decade").alias("hit"), N.case_tokens("sources").alias("tokens"))
    found = overlap_pairs(own, sources, "packet", "hit", "tokens", on=["matter"])
    counted = found.groupBy("hit.model", "hit.condition", "hit.decade").agg(F.count(F.lit(1)).alias("n"))  # groups are rolled up from these few
    return union_all([
        counted.groupBy("model", F.col(c).alias("grp")).agg(F.sum("n").alias("leaks")) for c in ("condition", "decade")
    ] + [counted.groupBy("model", F.lit("TOTAL").alias("grp")).agg(F.sum("n").alias("leaks"))])


@query("J22", f"WITH {PARTIES}, b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM benchmark)" + """
SELECT a.item_id AS item_id, b.item_id AS other, CAST(len(list_intersect(a.w, b.w)) AS INT) AS shared FROM b a JOIN b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) >= 3""")
def items_sharing_words(t: Tables) -> DataFrame:
    """Pairs of passages that share three long words or more: only the rarer words of a passage are looked up."""
    w = t.benchmark.select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    pairs = overlap_pairs(w, w.withColumnRenamed("item_id", "other"), "item_id", "other", "w", least=3)
    return pairs.where("item_id < other").select("item_id", "other", F.size("shared").alias("shared"))
