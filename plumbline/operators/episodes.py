"""Revision episodes: last drafts, feedback, fates of quotations, traces, outcomes and crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import rates as R
from plumbline.functions import text as X

# --- fixed values -----------------------------------------------------------
MAX_ROUNDS = 3
SAME_WORDING = 0.5
NOMINAL = {"true": 1.0, "threequarter": 0.75, "half": 0.5, "quarter": 0.25, "scrambled": 0.0}
LINE_CITATION = (
    "The citation %s does not correspond to any real case: it does not resolve in the court reporter database. "
    "Remove it or replace it with real authority."
)
LINE_QUOTE = (
    "The quoted passage beginning “%s…” does not appear verbatim in the opinion of %s. "
    "Quote the opinion's actual language or remove the quotation marks."
)
LINE_PASSAGE = (
    "The quoted passage beginning “%s…” does not appear verbatim in the opinion of %s. "
    "The closest passage in that opinion reads: “%s”. Quote the opinion's actual language or remove the quotation marks."
)
# Gate limits: drift from the anchor, unresolvable share, fewest citations.
DRIFT, UNRESOLVABLE_CEILING, MIN_CITATIONS = 0.10, 0.10, 10
# ----------------------------------------------------------------------------


def last_revision(drafts: DataFrame, episode: list[str], round_: str, text: str) -> DataFrame:
    """Text of the highest round; rounds are numbers, so 10 comes after 9."""
    return drafts.groupBy(*episode).agg(
        F.max(round_).alias("last_round"), F.max_by(text, round_).alias("final"), F.min_by(text, round_).alias("r0"),
        F.count(F.lit(1)).alias("drafts"),
    )


def citation_line(citation) -> Column:
    return F.format_string(LINE_CITATION, citation)


def quote_line(quote, citation, passage=None) -> Column:
    head = F.left(quote, F.lit(60))
    if passage is None:
        return F.format_string(LINE_QUOTE, head, citation)
    return F.when(passage.isNotNull(), F.format_string(LINE_PASSAGE, head, citation, passage)).otherwise(
        F.format_string(LINE_QUOTE, head, citation)
    )


def outcome(true_left: Column, rounds: Column) -> Column:
    """struct(converged, cap_exhausted) from the problems left in the last round."""
    done = true_left == 0
    return F.struct(done.alias("converged"), (~done & (rounds > MAX_ROUNDS)).alias("cap_exhausted"))


def _same_words(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return (either > 0) & (both / either >= SAME_WORDING)


def fates(first, final, final_norm) -> Column:
    """What became of each first-draft quotation.

    ``first`` and ``final`` are arrays of struct(norm, toks, citation, ok). A
    final quotation is claimed once, in order: the same words (kept), else the
    same citation with half the words in common (edited). What is left is
    dequoted when its middle eight words survive in the text, else deleted; a
    flagged deletion whose citation gained an unclaimed accurate quotation is
    replaced. Returns struct(fates, used).
    """
    first, final = (F.col(c) if isinstance(c, str) else c for c in (first, final))
    final_norm = F.col(final_norm) if isinstance(final_norm, str) else final_norm
    places = F.when(F.size(final) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(final) - 1))).otherwise(
        F.array().cast("array<int>")
    )
    fate_type = "struct<fate:string,at:int>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(f"array<{fate_type}>").alias("out"))

    def free(used: Column, test) -> Column:
        return F.array_min(F.filter(places, lambda i: ~F.array_contains(used, i) & test(F.get(final, i))))

    def step(acc: Column, q: Column) -> Column:
        kept = free(acc["used"], lambda x: x["norm"] == q["norm"])
        edited = free(acc["used"], lambda x: (x["citation"] == q["citation"]) & _same_words(x["toks"], q["toks"]))
        at = F.coalesce(kept, edited)
        survives = (F.size(F.split(q["norm"], " ")) >= 5) & F.contains(final_norm, X.middle_words(q["norm"], 8))
        fate = F.when(kept.isNotNull(), "kept").when(edited.isNotNull(), "edited").when(survives, "dequoted").otherwise("deleted")
        return F.struct(
            F.when(at.isNotNull(), F.concat(acc["used"], F.array(at))).otherwise(acc["used"]).alias("used"),
            F.concat(acc["out"], F.array(F.struct(fate.alias("fate"), at.alias("at")))).alias("out"),
        )

    claimed = F.aggregate(first, start, step)

    def replace(c: Column) -> Column:
        begin = F.struct(c["used"].alias("used"), F.array().cast(f"array<{fate_type}>").alias("out"))

        def second(acc: Column, pair: Column) -> Column:
            q, f = pair["q"], pair["f"]
            at = F.when(
                (f["fate"] == "deleted") & ~q["ok"], free(acc["used"], lambda x: (x["citation"] == q["citation"]) & x["ok"])
            )
            return F.struct(
                F.when(at.isNotNull(), F.concat(acc["used"], F.array(at))).otherwise(acc["used"]).alias("used"),
                F.concat(
                    acc["out"],
                    F.array(F.struct(F.when(at.isNotNull(), "replaced").otherwise(f["fate"]).alias("fate"), f["at"].alias("at"))),
                ).alias("out"),
            )

        pairs = F.zip_with(first, c["out"], lambda q, f: F.struct(q.alias("q"), f.alias("f")))
        return F.aggregate(pairs, begin, second, lambda a: F.struct(a["out"].alias("fates"), a["used"].alias("used")))

    return X.let(claimed, replace)


def trace(r0: DataFrame, final: DataFrame, episode: list[str], item: str, verdict: str) -> DataFrame:
    """Per episode: first-draft items not found, removed or kept; new items that exist or do not."""
    a = r0.select(*episode, item, F.col(verdict).alias("_v0"))
    b = final.select(*episode, item, F.col(verdict).alias("_v1"))
    j = a.join(b, [*episode, item], "full")
    missing = F.col("_v0") == "not_found"
    new = F.col("_v0").isNull()
    return j.groupBy(*episode).agg(
        F.count_if(missing).alias("nf_r0"), F.count_if(missing & F.col("_v1").isNull()).alias("nf_removed"),
        F.count_if(missing & F.col("_v1").isNotNull()).alias("nf_kept"), F.count_if(new).alias("new_n"),
        F.count_if(new & (F.col("_v1") == "exists")).alias("new_exists"),
        F.count_if(new & (F.col("_v1") != "exists")).alias("new_other"),
    )


def crossing(points: DataFrame, group: list[str], x: str, y: str, target: str) -> DataFrame:
    """First place, from high x to low, where y passes the target; linear between neighbours."""
    order = Window.partitionBy(*group).orderBy(F.desc(x))  # one row per arm
    n = points.withColumn("_x2", F.lead(x).over(order)).withColumn("_y2", F.lead(y).over(order))
    inside = (F.col(y) - F.col(target)) * (F.col("_y2") - F.col(target)) <= 0
    hit = n.filter(inside & (F.col(y) != F.col("_y2")))
    at = F.col(x) + (F.col(target) - F.col(y)) * (F.col("_x2") - F.col(x)) / (F.col("_y2") - F.col(y))
    return hit.groupBy(*group).agg(F.max_by(at, F.col(x)).alias("crossing"))


def gate(checks: dict[str, Column]) -> list[Column]:
    """Named boolean checks and their conjunction."""
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    return [*[c.alias(n) for n, c in checks.items()], every.alias("admit")]


def best_so_far(rows: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """Highest value up to each round, nulls passed over."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.max(value).over(w))


def weighted_mean(value: Column, weight: Column) -> Column:
    return R.share(F.sum(value * weight), F.sum(weight))
