"""Case HTML: pages by label, parts by marker, heads by class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, normalize, strip_tags

# --- fixed values -----------------------------------------------------------
PAGE_LABEL = r"page-label[^>]*>\s*\*?(\d+)"
PART_MARK = r'(?i)<section class="head-matter">|<article class="opinion" data-type="([a-z]+)"'
# ----------------------------------------------------------------------------


def head(html, cls: str) -> Column:
    """Text of the first element of a class, tags removed; empty when there is none."""
    inner = F.regexp_extract(html, f'(?s)class="{cls}"[^>]*>(.*?)</', 1)
    return F.regexp_replace(F.regexp_replace(inner, "<[^>]+>", ""), r"^\s+|\s+$", "")


def pages(html, first_page) -> Column:
    """``array<struct<page, text>>``: one entry per page number, the last segment of a repeated label.

    Text ahead of the first label belongs to the first page, when one is given.
    """
    html = F.col(html) if isinstance(html, str) else html
    first_page = F.col(first_page) if isinstance(first_page, str) else first_page
    bound = F.struct(
        F.split(html, PAGE_LABEL, -1).alias("seg"),
        F.regexp_extract_all(html, F.lit(PAGE_LABEL), F.lit(1)).alias("label"),
    )

    def cut(b: Column) -> Column:
        ahead = F.get(b["seg"], F.lit(0))
        lead = F.when(
            first_page.isNotNull() & ahead.rlike(r"\S"),
            F.array(F.struct(first_page.cast("long").alias("page"), F.lit(0).alias("at"))),
        ).otherwise(F.array().cast("array<struct<page:bigint,at:int>>"))
        labelled = F.transform(b["label"], lambda x, i: F.struct(x.cast("long").alias("page"), (i + 1).alias("at")))
        every = F.concat(lead, labelled)
        numbers = F.array_distinct(F.transform(every, lambda e: e["page"]))

        def newest(page: Column) -> Column:
            at = F.array_max(F.transform(F.filter(every, lambda e: e["page"] == page), lambda e: e["at"]))
            return F.struct(page.alias("page"), strip_tags(F.get(b["seg"], at)).alias("text"))

        return F.transform(numbers, newest)

    return let(bound, cut)


def parts(html) -> Column:
    """``array<struct<ord, part, text>>``: normalised parts from each marker to the next."""
    html = F.col(html) if isinstance(html, str) else html
    marks = F.transform(
        F.regexp_extract_all(html, F.lit(PART_MARK), F.lit(0)),
        lambda m: F.struct(m.alias("mark"), F.lower(F.regexp_extract(m, PART_MARK, 1)).alias("kind")),
    )
    bound = F.struct(F.split(html, PART_MARK, -1).alias("seg"), marks.alias("marks"))
    return let(
        bound,
        lambda b: F.transform(
            b["marks"],
            lambda m, i: F.struct(
                i.alias("ord"), F.when(m["kind"] == "", "head-matter").otherwise(m["kind"]).alias("part"),
                normalize(strip_tags(F.concat(m["mark"], F.get(b["seg"], i + 1)))).alias("text"),
            ),
        ),
    )
