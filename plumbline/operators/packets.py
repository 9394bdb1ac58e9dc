"""Packets built from opinions: outcome scrubbing, the cut before the analysis, the word budget, quotas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X

# --- fixed values -----------------------------------------------------------
ANALYSIS = (
    r"(?U)^(II\.|III\.|DISCUSSION|ANALYSIS|Discussion|Analysis|STANDARD OF REVIEW)\b|"
    r"\b(standard of review|[Ww]e review|de novo|[Ww]e turn|[Ww]e begin (?:our|with)|"
    r"[Ww]e first|[Ww]e must decide|[Ww]e consider first)\b"
)
OUTCOME = (
    r"(?U)\b(we|We) (also |further |therefore |accordingly |now |thus )?"
    r"(affirm|reverse|vacate|remand|hold|conclude|agree|disagree|reject|grant|deny|"
    r"instruct|direct|find|decline|dismiss|see no|are not persuaded|are persuaded)\b|"
    r"^We\b|\b(AFFIRMED|REVERSED|VACATED|REMANDED|Affirmed|Reversed|Vacated|Remanded)\b|"
    r"\bis (affirmed|reversed|vacated)\b|\bare (affirmed|reversed|vacated)\b"
)
HEADER = (
    r"(?i)wrote the (majority )?opinion|dissent|concurr|delivered the opinion|"
    r"Circuit Judges?[:.]?$|^OPINION( OF THE COURT)?$|^ORDER$|Before .* Judges"
)
JUDGE_LINE = r"Judge\.?:?$|PER CURIAM"
RESIDUE = r"(?iU)\b(affirm|revers)\w*"
MIN_WORDS, MAX_WORDS = 250, 900
PER_CIRCUIT = 4
# ----------------------------------------------------------------------------


def scrub(paragraph) -> Column:
    """A paragraph without the sentences that give the outcome away."""
    return F.array_join(
        F.filter(F.split(paragraph, r"(?<=[.!?])\s+"), lambda s: ~s.rlike(OUTCOME)), " "
    )


def _n_words(text) -> Column:
    return F.size(X.words(text))


def packet(text, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> Column:
    """The paragraphs ahead of the analysis, scrubbed, within the word budget; null when unusable."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), lambda p: F.trim(p, F.lit(X.WHITESPACE))), lambda p: p != ""
    )
    body = F.filter(lines, lambda p: ~p.rlike(HEADER) & ~p.rlike(JUDGE_LINE))

    def from_body(b: Column) -> Column:
        marks = F.filter(
            F.transform(b, lambda p, i: F.when((i >= 1) & p.rlike(ANALYSIS), i)), lambda i: i.isNotNull()
        )
        cut = F.array_min(marks)
        kept = F.filter(F.transform(F.slice(b, F.lit(1), cut), scrub), lambda p: p != "")
        return F.when((F.size(b) >= 4) & (cut >= 2), kept)

    def within_budget(ps: Column) -> Column:
        # whole paragraphs until the first one that would overflow
        zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            over = acc["full"] | (acc["n"] + _n_words(p) > max_words)
            return F.struct(
                F.when(over, acc["n"]).otherwise(acc["n"] + _n_words(p)).alias("n"), over.alias("full"),
                F.when(over, acc["out"]).otherwise(F.concat(acc["out"], F.array(p))).alias("out"),
            )

        total = F.aggregate(ps, F.lit(0), lambda a, p: a + _n_words(p))
        short = F.aggregate(ps, zero, step)
        use = F.when(total > max_words, F.when(short["n"] >= min_words, short["out"])).when(total >= min_words, ps)
        return F.array_join(use, "\n")

    # the count of raw paragraphs and of body paragraphs both gate the packet
    joined = X.let(X.let(body, from_body), within_budget)
    usable = F.when(F.size(lines) >= 4, joined)
    return X.let(usable, lambda j: F.when(~j.rlike(OUTCOME) & ~j.rlike(RESIDUE), j))


def quota_selection(candidates: DataFrame, group: str, flag: str, order: str, total: int, per_group: int = PER_CIRCUIT) -> DataFrame:
    """Up to ``per_group`` per group and a quarter of the total flagged, in order.

    The two caps interact, so the last step is a fold in order. Only candidates
    that can matter reach it. Of a group the fold takes ``per_group`` rows at
    most and skips flagged rows at most once the flagged cap is met; the first
    ``per_group`` unflagged and the first ``per_group`` flagged rows of each
    group are therefore enough.
    """
    from plumbline.operators.cells import top_per_group

    short = top_per_group(candidates, [group, flag], [F.col(order)], per_group, "_rk").drop("_rk")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        taken, per, flagged = [], {}, 0
        for i, row in enumerate(rows.sort_values(order).to_dict("records")):
            full = per.get(row[group], 0) >= per_group
            if len(taken) == total or full or (row[flag] and flagged >= total // 4):
                continue
            flagged += bool(row[flag])
            per[row[group]] = per.get(row[group], 0) + 1
            taken.append(row)
        return pd.DataFrame(taken, columns=rows.columns)

    return short.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(
        lambda rows: fold(rows.drop(columns="_all")), short.schema
    )
