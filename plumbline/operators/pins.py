"""Where in a case does a quotation stand: at its pin page, near it, in which part?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators.skew import salted_join


def locate(pins: DataFrame, pages: DataFrame, case: str, row: list[str]) -> DataFrame:
    """pin_out_of_span / quote_at_pin / quote_near_pin / quote_not_at_pin / quote_absent per pin.

    ``pins``: case, row keys, ``pin``, ``frag``; ``pages``: case, ``page``, ``n``.
    The pages of a case travel as one array, so a pin stays one row however
    many pages its case has, and a case many pins name is salted.
    """
    held = pages.groupBy(case).agg(F.collect_list(F.struct("page", "n")).alias("_pages"))  # the text of one case
    j = salted_join(pins, held, [case], row)
    number = lambda p: p["page"]
    with_quote = F.transform(F.filter("_pages", lambda p: F.contains(p["n"], F.col("frag"))), number)
    lo, hi = F.array_min(F.transform("_pages", number)), F.array_max(F.transform("_pages", number))
    verdict = X.let(
        with_quote,
        lambda at: F.when((F.col("pin") < lo) | (F.col("pin") > hi), "pin_out_of_span")
        .when(F.array_contains(at, F.col("pin")), "quote_at_pin")
        .when(F.exists(at, lambda p: F.abs(p - F.col("pin")) == 1), "quote_near_pin")
        .when(F.size(at) > 0, "quote_not_at_pin").otherwise("quote_absent"),
    )
    return j.select(case, *row, verdict.alias("verdict"))


def part_of(quotes: DataFrame, parts: DataFrame, case: str, row: list[str]) -> DataFrame:
    """The part that holds a quotation: the majority if it is among them, else the first in order."""
    body = F.struct(F.col("ord").alias("o"), F.col("part").alias("p"), F.col("text").alias("t"), X.nospace("text").alias("s"))
    held = parts.groupBy(case).agg(F.array_sort(F.collect_list(body)).alias("_parts"))  # the text of one case
    j = salted_join(quotes, held, [case], row)
    inside = F.transform(F.filter("_parts", lambda x: X.contains_either("frag", x["t"], x["s"])), lambda x: x["p"])
    named = X.let(inside, lambda ps: F.when(F.array_contains(ps, "majority"), "majority").otherwise(F.get(ps, F.lit(0))))
    return j.select(case, *row, named.alias("part")).filter("part IS NOT NULL")


def far_page(rows: DataFrame, pages: DataFrame, case: str, distance: int) -> DataFrame:
    """The lowest page of the case at least ``distance`` away from a row's page; rows without one drop out."""
    listed = pages.groupBy(case).agg(F.array_sort(F.collect_set("page")).alias("_pages"))  # page numbers of one case
    far = F.array_min(F.filter("_pages", lambda p: F.abs(p - F.col("page")) >= distance))
    return rows.join(listed, case).withColumn("far_page", far).drop("_pages").filter("far_page IS NOT NULL")
