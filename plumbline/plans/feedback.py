"""Feedback arms, balanced panels, positions and alternation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rates as R
from plumbline.operators import episodes as E
from plumbline.operators import feedback as O
from plumbline.plans import episodes as P
from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.session import Tables

# a draft is a (model, matter, condition) of the records
_ITEMS = [
    "concat(model, '_', CAST(matter AS STRING), '_', condition) AS draft", "rid", "kind", "verdict",
    "CASE WHEN rid % 29 = 0 THEN NULL ELSE concat(CAST(volume AS STRING), ' ', reporter, ' ', CAST(page AS STRING)) END AS citation",
    "concat('the words numbered ', CAST(rid AS STRING), ' that a drafter put between marks in ', condition) AS quote",
    "CASE WHEN rid % 2 = 0 THEN concat('the words as they stand, numbered ', CAST(rid AS STRING)) END AS passage",
]
_C, _Q = (x.replace("'", "''") for x in (E.LINE_CITATION, E.LINE_QUOTE))
_P = E.LINE_PASSAGE.replace("'", "''")
_TRUE = f"CASE kind WHEN 'citation' THEN replace('{_C}', '%s', coalesce(citation, 'null')) ELSE printf('{_Q}', left(quote, 60), citation) END"
_U = "CAST(concat('0x', substr(md5(concat_ws('-', '{}', arm, {})), 1, 8)) AS BIGINT)"


@query("E1 X2 X3", f"WITH {V.RECORDS}, it AS (SELECT {', '.join(_ITEMS)} FROM records)" + f"""
, failed AS (SELECT *, {_TRUE} AS true_line, row_number() OVER (PARTITION BY draft ORDER BY md5(concat_ws('-', '30', CAST(rid AS VARCHAR))), rid) AS p FROM it
   WHERE (kind = 'citation' AND verdict = 'not_found') OR (kind = 'quote' AND verdict IN ('inaccurate', 'near_miss') AND citation IS NOT NULL))
, ok AS (SELECT draft, kind, {_TRUE} AS line, row_number() OVER (PARTITION BY draft, kind ORDER BY md5(concat_ws('-', '30', CAST(rid AS VARCHAR))), rid) AS place FROM it
   WHERE (kind = 'citation' AND verdict = 'exists') OR (kind = 'quote' AND verdict = 'accurate' AND citation IS NOT NULL))
, n AS (SELECT draft, count(*) FILTER (kind = 'quote') AS nq, count(*) FILTER (kind = 'citation') AS nc FROM ok GROUP BY 1)
, arms AS (SELECT * FROM (VALUES ('scrambled', NULL::DOUBLE), ('quarter', 0.25), ('half', 0.5), ('threequarter', 0.75)) AS v(arm, keep))
, d AS (SELECT f.draft, rid, p, true_line, arm, nq, nc, {_U.format(33, 'f.draft')} AS turn,
   CASE WHEN keep IS NOT NULL AND {_U.format(31, 'CAST(rid AS VARCHAR)')} / 4294967296.0::DOUBLE < keep THEN 'true'
     WHEN nq > 0 AND {_U.format(32, 'CAST(rid AS VARCHAR)')} / 4294967296.0::DOUBLE < 0.5 THEN 'quote' WHEN nc > 0 THEN 'citation' WHEN keep IS NOT NULL THEN 'true' END AS origin
   FROM failed f CROSS JOIN arms LEFT JOIN n ON n.draft = f.draft)
, m AS (SELECT d.draft, rid, arm, origin, coalesce(ok.line, true_line) AS line FROM d LEFT JOIN ok ON ok.draft = d.draft AND ok.kind = d.origin
   AND ok.place = (p - 1 + turn) % nullif(CASE origin WHEN 'quote' THEN nq ELSE nc END, 0) + 1 WHERE origin IS NOT NULL)
, every AS (SELECT draft, rid, 'true' AS arm, 'true' AS origin, true_line AS line FROM failed
  UNION ALL SELECT draft, rid, 'passage', 'true', CASE WHEN kind = 'quote' AND passage IS NOT NULL THEN printf('{_P}', left(quote, 60), citation, passage) ELSE true_line END FROM failed
  UNION ALL SELECT DISTINCT draft, NULL, 'none', 'mark', '__NONE__' FROM failed UNION ALL SELECT * FROM m)
SELECT draft, rid, arm, origin, md5(line) AS line_md5 FROM every""")
def feedback_lines(t: Tables) -> DataFrame:
    lines = O.feedback(V.records(t).selectExpr(*_ITEMS), "draft", "rid")
    return lines.select("draft", "rid", "arm", "origin", F.md5("line").alias("line_md5"))


_MODEL = "concat('m', CAST(conv_id % 7 AS STRING)) AS model"


@query("A34", f"WITH {P._WORDS}" + f"""
, planned AS (SELECT DISTINCT conv_id, {_MODEL}, {P._ARM} AS arm FROM conversations)
, r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS round FROM rounds)
, acc AS (SELECT r.conv_id, round, count(i.w) FILTER (i.verdict = 'exists') AS acc FROM r LEFT JOIN items i ON i.conv_id = r.conv_id AND i.turn = r.turn WHERE round <= 3 GROUP BY 1, 2)
, e AS (SELECT p.*, coalesce((SELECT arg_min(acc, round) FROM acc WHERE acc.conv_id = p.conv_id AND round = 0), 0) AS a0, coalesce((SELECT arg_max(acc, round) FROM acc WHERE acc.conv_id = p.conv_id), 0) AS a1 FROM planned p)
, c AS (SELECT model, arm, count(*) AS episodes, CAST(sum(a0) AS BIGINT) AS s0, CAST(sum(a1) AS BIGINT) AS s1 FROM e GROUP BY 1, 2)
SELECT model, arm, episodes, round(s0 / episodes::DOUBLE, 9) AS itt_start, round(s1 / episodes::DOUBLE, 9) AS itt_final, CAST(count(*) FILTER (s1 > s0) OVER (PARTITION BY arm) AS BIGINT) AS risers FROM c""")
def intent_to_treat(t: Tables) -> DataFrame:
    """Correct citations of a draft in the first and last planned round, over all planned episodes; risers: models of the arm that gain."""
    planned = t.conversations.selectExpr("conv_id", _MODEL, f"{P._ARM} AS arm").distinct()
    ok = P.items(t).where("verdict = 'exists'").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    rounds = O.numbered_from_zero(P.rounds(t).select("conv_id", "turn"), ["turn"], "round", ("conv_id",)).join(ok, ["conv_id", "turn"], "left")
    observed = rounds.select("conv_id", "round", F.coalesce("n", F.lit(0)).alias("acc"))
    panel = O.carried_panel(planned, observed, ["conv_id"], "round", "acc", E.MAX_ROUNDS)
    at = lambda r: F.sum(F.when(F.col("round") == r, F.col("acc")).otherwise(0))
    cells = panel.join(planned, "conv_id").groupBy("model", "arm").agg(F.countDistinct("conv_id").alias("episodes"), at(0).alias("s0"), at(E.MAX_ROUNDS).alias("s1"))
    risers = cells.groupBy("arm").agg(F.count_if(F.col("s1") > F.col("s0")).alias("risers"))  # one row an arm
    mean = lambda s: F.round(R.share(F.col(s), F.col("episodes")), 9)
    return cells.join(risers, "arm").select("model", "arm", "episodes", mean("s0").alias("itt_start"), mean("s1").alias("itt_final"), "risers")


@query("A22", f"WITH {P._WORDS}" + f"""
, e AS (SELECT conv_id, {_MODEL}, arm, count(*) AS k FROM rounds GROUP BY ALL), c AS (SELECT model, arm, count(*) AS episodes, avg(k) AS mean_rounds FROM e GROUP BY 1, 2)
SELECT arm, count(*) AS cells, round(sum(mean_rounds * episodes) / sum(episodes), 9) AS mean_rounds FROM c GROUP BY 1""")
def pooled_rounds(t: Tables) -> DataFrame:
    """Mean rounds of an arm, pooled over the models' means by their episodes."""
    e = P.rounds(t).groupBy("conv_id", F.expr(_MODEL), "arm").agg(F.count(F.lit(1)).alias("k"))
    c = e.groupBy("model", "arm").agg(F.count(F.lit(1)).alias("episodes"), F.avg("k").alias("mean_rounds"))
    return c.groupBy("arm").agg(F.count(F.lit(1)).alias("cells"), F.round(E.weighted_mean(F.col("mean_rounds"), F.col("episodes")), 9).alias("mean_rounds"))


_ZIP = """WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role = 'user')
, a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role = 'assistant')
, z AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.place, a.place) AS place, u.turn AS asked, a.turn AS answered, u.turn IS NULL OR a.turn IS NULL AS alone FROM u FULL JOIN a ON a.conv_id = u.conv_id AND a.place = u.place)
"""


def _zipped(t: Tables) -> DataFrame:
    turns = lambda role, name: t.conversations.where(F.col("role") == role).select("conv_id", F.col("turn").alias(name))
    return O.zip_by_position(turns("user", "asked"), turns("assistant", "answered"), "conv_id", ["asked"], ["answered"])


@query("J20", _ZIP + "SELECT conv_id, place, asked, answered, alone FROM z")
def zipped_turns(t: Tables) -> DataFrame:
    return _zipped(t).select("conv_id", "place", "asked", "answered", "alone")


@query("J20", _ZIP + "SELECT conv_id, count(*) AS longer, count(*) FILTER (NOT alone) AS shorter FROM z GROUP BY 1 HAVING count(*) <> count(*) FILTER (NOT alone)")
def unequal_turns(t: Tables) -> DataFrame:
    return O.unequal_lengths(_zipped(t), "conv_id")


@query("W12", f"WITH {V.CASES}" + """
, m AS (SELECT cluster_id, row_number() OVER (ORDER BY date_filed, cluster_id) - 1 AS mi FROM cases)
SELECT cluster_id, mi, CASE WHEN mi % 2 = 0 THEN 'petitioner' ELSE 'respondent' END AS side, referee, CASE WHEN (referee + mi % 2) % 2 = 0 THEN 'petitioner' ELSE 'respondent' END AS first_shown
FROM m CROSS JOIN (SELECT unnest([0, 1, 2]) AS referee)""")
def assigned_sides(t: Tables) -> DataFrame:
    """A side by turns over the cases in order of filing; referees see the sides by turns, flipped from case to case."""
    m = O.numbered_from_zero(V.cases(t).select("cluster_id", "date_filed"), ["date_filed", "cluster_id"], "mi")
    panel = m.withColumn("referee", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return panel.select("cluster_id", "mi", O.side_by_parity(F.col("mi")).alias("side"), "referee", O.side_by_parity(F.col("referee") + F.col("mi") % 2).alias("first_shown"))
