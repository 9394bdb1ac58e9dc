"""Where do quoted words come from? Hits in corpus order, sole sources and spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators.cells import top_per_group
from plumbline.operators.containment import located, occurrences  # noqa: F401
from plumbline.session import stage

DISTINCTIVE_WORDS = 6
FIRST_HITS = 3
COUNT_CAP = 25
GENERIC_AT = 6


def numbered(frags: DataFrame, frag: str, number: str) -> DataFrame:
    """(frag, number): every fragment once, with a number that stays the same for all who read it."""
    return stage(frags.select(frag).distinct().withColumn(number, F.monotonically_increasing_id()))


def numbered_hits(asked: DataFrame, corpus: DataFrame, number: str, frag: str, doc_id: str, text: str) -> DataFrame:
    """(number, doc_id, probe, n): documents with the fragment, else with its middle ten words; fragments are numbered and distinct.

    Both forms of a fragment are searched in one pass over the corpus; the middle words count only where no document
    holds the whole fragment. A fragment that k documents hold gives k rows, however many quotations ask for it.
    """
    forms = F.array(
        F.struct((F.col(number) * 2).alias("_form"), F.col(frag).alias("_probe")),
        F.when(
            F.size(F.split(frag, " ")) >= 10,
            F.struct((F.col(number) * 2 + 1).alias("_form"), X.middle_words(frag, 10).alias("_probe")),
        ),
    )
    forms = stage(asked.select(F.explode(F.filter(forms, lambda x: x.isNotNull())).alias("f")).select("f._form", "f._probe"))
    found = stage(located(forms, corpus, frag_id="_form", frag="_probe", doc_id=doc_id, text=text))
    of = F.shiftright("_form", 1)
    held = found.select("_form").distinct().withColumn("_of", of)
    # of a fragment's forms the whole one, an even number, comes first
    kept = held.groupBy(F.col("_of").alias(number)).agg(F.min("_form").alias("_form"))
    probes = kept.join(forms, "_form").select("_form", number, F.col("_probe").alias("probe"))
    return found.join(probes, "_form").select(number, doc_id, "probe", "n")


def probe_hits(frags: DataFrame, corpus: DataFrame, frag: str, doc_id: str, text: str) -> DataFrame:
    """(frag, doc_id, probe, n): :func:`numbered_hits` with the fragments themselves, equal ones once."""
    asked = numbered(frags, frag, "_number")
    return numbered_hits(asked, corpus, "_number", frag, doc_id, text).join(asked, "_number").select(frag, doc_id, "probe", "n")


def holders(hits: DataFrame, frag: str, doc_id: str) -> DataFrame:
    """One row a fragment: occurrences, distinct documents, and whether a probe is distinctive."""
    return hits.groupBy(frag).agg(
        F.sum("n").alias("occurrences"), F.countDistinct(doc_id).alias("sources"), F.bool_or(distinctive(F.col("probe"))).alias("distinctive")
    )


def held_by_attributed(asked: DataFrame, hits: DataFrame, tokens: DataFrame, key: str, frag: str, doc_id: str, attributed: str) -> DataFrame:
    """Keys whose fragment some document holds that shares a name with the attributed one.

    ``tokens`` has (doc_id, tokens). The names of a fragment's holders, each once, meet the names of the
    attributed document on (fragment, name): no quotation meets every holder.
    """
    names = hits.select(frag, doc_id).join(tokens, doc_id).select(frag, F.explode("tokens").alias("_name")).distinct()
    own = tokens.select(F.col(doc_id).alias(attributed), "tokens")
    wanted = asked.select(key, frag, attributed).join(own, attributed).select(key, frag, F.explode("tokens").alias("_name"))
    return wanted.join(names, [frag, "_name"]).select(key).distinct()


def first_hits(hits: DataFrame, key: str, doc_id: str, k: int) -> DataFrame:
    """The first k occurrences per key in corpus order, for display; one document may fill several."""
    ranked = top_per_group(hits, [key], [F.col(doc_id)], k, "_r")  # k documents always cover k occurrences
    before = Window.partitionBy(key).orderBy(doc_id).rowsBetween(Window.unboundedPreceding, -1)
    first = ranked.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("_before") < k)
    return first.withColumn("taken", F.least(F.col("n"), F.lit(k) - F.col("_before"))).drop("_r", "_before")


def distinctive(probe: Column) -> Column:
    return F.size(F.split(probe, " ")) >= DISTINCTIVE_WORDS


def spread_class(sources: Column) -> Column:
    return F.when(sources == 1, "one").when(sources <= GENERIC_AT, "few").otherwise("many")
