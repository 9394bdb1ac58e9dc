"""Reporters by edition, and names in citation shapes that the table does not explain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import reporters as L
from plumbline.operators import claims as O
from plumbline.plans import claims as C
from plumbline.plans.registry import query
from plumbline.session import Tables, spread

_ROWS = L.table_rows()
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_TABLE = "t(spelling, edition, first_year) AS (VALUES " + ", ".join(f"({_quoted(s)}, {_quoted(e)}, {y})" for s, e, y in _ROWS) + ")"
_NAMES = f"[{', '.join(_quoted(s) for s, _, _ in _ROWS)}]"
# every third line cites a brand or kind of part, which is no reporter; the others go through all spellings
_TEXT = (
    "concat('As was said in Roe v. ', l_linestatus, 'oe, ', CAST(1 + l_suppkey % 900 AS STRING), ' ', {name}, ' ', "
    "CAST(l_partkey AS STRING), ' (', CAST(1790 + l_orderkey % 230 AS STRING), '), and again.')"
)
_OTHER = "CASE WHEN l_linenumber % 2 = 0 THEN concat(p_type, ' R. 2d') ELSE p_type END"


@query("F12", f"WITH {_TABLE}, texts AS (SELECT " + _TEXT.format(name=f"CASE WHEN l_orderkey % 3 = 0 THEN {_OTHER} ELSE {_NAMES}[1 + CAST((l_orderkey * 7 + l_linenumber) % {len(_ROWS)} AS INT)] END").replace("STRING", "VARCHAR") + """ AS text
  FROM lineitem JOIN part ON p_partkey = l_partkey)
, c AS (SELECT regexp_extract(text, '""" + O.CITATION.replace("'", "''") + """', 2) AS reporter, CAST(regexp_extract(text, '\\((\\d{4})\\)', 1) AS BIGINT) AS yr FROM texts)
SELECT edition, count(*) AS citations, count(*) FILTER (yr < first_year) AS before_first_year FROM c JOIN t ON t.spelling = c.reporter GROUP BY 1""")
def editions_in_texts(t: Tables) -> DataFrame:
    """Citations in every spelling of the table, by edition, and those dated before the edition began."""
    found = O.citations(_texts(t), "id", "text")
    named = L.with_edition(found.select("reporter", "paren_year"), t.spark)
    return named.groupBy("edition").agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("paren_year") < F.col("first_year")).alias("before_first_year"))


def _texts(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(s) for s, _, _ in _ROWS])
    at = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(_ROWS)).cast("int")
    lines = spread(t.lineitem).join(t.part.select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    name = F.when(F.col("l_orderkey") % 3 == 0, F.expr(_OTHER)).otherwise(F.get(names, at))
    return lines.withColumn("_name", name).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.expr(_TEXT.format(name="_name")).alias("text"))


@query("F12", f"WITH {_TABLE}, texts AS (SELECT " + _TEXT.format(name=_OTHER).replace("STRING", "VARCHAR") + """ AS text FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 3 = 0)
SELECT regexp_extract(text, '""" + L.SHAPE.replace("'", "''") + """', 2) AS name, count(*) AS places FROM texts GROUP BY 1""")
def unexplained_shapes(t: Tables) -> DataFrame:
    return L.unexplained(_texts(t), t.spark, "text")


@query("F12 F14", f"{C.DR}, {_TABLE}, {C._CITES}" + f"""
SELECT coalesce(edition, 'none') AS edition, count(*) AS citations, count(DISTINCT reporter) AS spellings FROM (SELECT regexp_extract(citation, '{C._PAT}', 2) AS reporter FROM cites) LEFT JOIN t ON t.spelling = reporter GROUP BY 1""")
def editions_in_drafts(t: Tables) -> DataFrame:
    named = L.with_edition(C.citations(t).select("reporter"), t.spark)
    return named.groupBy(F.coalesce("edition", F.lit("none")).alias("edition")).agg(F.count(F.lit(1)).alias("citations"), F.countDistinct("reporter").alias("spellings"))
