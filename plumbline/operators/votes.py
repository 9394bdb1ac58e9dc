"""Verdicts parsed from free text, majorities and calibration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import rates as R

# --- fixed values -----------------------------------------------------------
STRONGER = r'"stronger"\s*:\s*"(petitioner|respondent)"'
SUPPORT = r'(?i)"verdict"\s*:\s*"(supports|contradicts|cannot_tell)"'
PLACEHOLDERS = [r"(?i)situations? like x\b", r"(?i)tactic y\b", r"(?i)because z\b"]
PLACEHOLDER_HARD = r"(?i)\[insert"
CALIBRATION_BAR = 0.75
# ----------------------------------------------------------------------------


def last_verdict(raw, pattern: str = STRONGER) -> Column:
    """The last match: a writer may quote both options before the final answer."""
    return F.get(F.reverse(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))), F.lit(0))


def majority(columns: list[str], first: str, second: str) -> Column:
    """Winner of the valid votes; null on a tie or when nobody voted."""
    tally = lambda side: sum((F.when(F.col(c) == side, 1).otherwise(0) for c in columns), F.lit(0))
    return F.when(tally(first) > tally(second), first).when(tally(second) > tally(first), second)


def calibration(right: Column, decided: Column) -> Column:
    """Share of decided items that agree with the label."""
    return R.share(F.count_if(right & decided.isNotNull()), F.count(decided))


def accept_lesson(text) -> Column:
    """Reject declined lessons and echoed templates (two placeholders together, or an insert mark)."""
    text = F.col(text) if isinstance(text, str) else text
    echoed = sum((text.rlike(p).cast("int") for p in PLACEHOLDERS), F.lit(0))
    declined = (F.trim(text) == "") | F.contains(F.upper(F.left(text, F.lit(40))), F.lit("NO LESSON"))
    return ~(declined | text.rlike(PLACEHOLDER_HARD)) & (echoed < 2)
