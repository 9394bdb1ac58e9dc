"""Rates with an empty-denominator rule, and closed-form interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verdict families.
SCORED_CITATIONS = ("exists", "not_found")
SCORED_QUOTES = ("accurate", "near_miss", "inaccurate")


def share(numerator: Column, denominator: Column) -> Column:
    """Null, never 0 or 1, when the denominator is empty."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def _is(kind: str, verdict: str) -> Column:
    return (F.col("kind") == kind) & (F.col("verdict") == verdict)


def counts(kind: str, verdicts) -> dict[str, Column]:
    return {v: F.count_if(_is(kind, v)) for v in verdicts}


def existence_rate() -> Column:
    """exists / (exists + not_found)."""
    ok, bad = F.count_if(_is("citation", "exists")), F.count_if(_is("citation", "not_found"))
    return share(ok, ok + bad)


def strict_rate() -> Column:
    """accurate / (accurate + near miss + inaccurate)."""
    ok = F.count_if(_is("quote", "accurate"))
    return share(ok, F.count_if((F.col("kind") == "quote") & F.col("verdict").isin(*SCORED_QUOTES)))


def lenient_rate() -> Column:
    """(accurate + near miss) / scored."""
    ok = F.count_if((F.col("kind") == "quote") & F.col("verdict").isin("accurate", "near_miss"))
    return share(ok, F.count_if((F.col("kind") == "quote") & F.col("verdict").isin(*SCORED_QUOTES)))


def first_edition_rate() -> Column:
    """accurate / (accurate + inaccurate), the near misses left out."""
    ok, bad = F.count_if(_is("quote", "accurate")), F.count_if(_is("quote", "inaccurate"))
    return share(ok, ok + bad)


def wilson(k: Column, n: Column, side: int, z: float = 1.96) -> Column:
    """Wilson score bound: ``side`` +1 for the upper one, -1 for the lower one."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    return F.try_divide(centre + side * half, 1 + F.try_divide(F.lit(z * z), n))
