"""TF-IDF retrieval, hashed bag-of-words vectors, cosine ranking and best windows."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.operators.skew import salted_join

# --- fixed values -----------------------------------------------------------
TOP = 10
WINDOW, STEP = 250, 50
PASSAGE, PASSAGE_STEP = 45, 10
QUERY_STOP = (
    "the of and to in a that is for it as on be by with was this or are "
    "from at an which not have has had his their its he they she we our "
    "were been but were also any all such may would could shall does did "
    "than then there these those where whether under over into upon"
).split()
EDGE_MARKS = ".,;:()"
QUOTE_EDGE_MARKS = ".,;:()\"'“”"
DIMENSIONS = 512
# ----------------------------------------------------------------------------


def term_counts(docs: DataFrame, doc_id: str, text: str, stop: list[str]) -> DataFrame:
    """(doc_id, term, tf) over lower-case words of two letters or more, stop words left out."""
    terms = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    # the texts are dealt by their number before they are taken apart: a word a row weighs many times its text
    dealt = docs.select(doc_id, text).repartition(doc_id)
    rows = dealt.select(doc_id, F.explode(terms).alias("term")).filter(~F.col("term").isin(stop))
    return rows.groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(counts: DataFrame, n_docs: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """Smoothed idf of the terms in at least ``min_df`` texts and at most a share ``max_df`` of them."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = df.crossJoin(F.broadcast(n_docs)).filter((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df))
    return kept.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, idf_table: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, term, w): sublinear tf times idf, each text scaled to length one."""
    raw = salted_join(counts, idf_table, ["term"], [doc_id], "inner").select(
        doc_id, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw")
    )
    norms = raw.groupBy(doc_id).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, doc_id).select(doc_id, "term", (F.col("raw") / F.col("norm")).alias("w"))


def hashed_terms(text) -> Column:
    """Unigrams and bigrams of the lower-case alphanumeric words."""
    return X.let(
        F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)),
        lambda w: F.concat(
            w,
            F.transform(
                F.slice(w, F.lit(1), F.greatest(F.lit(0), F.size(w) - 1)),
                lambda a, i: F.concat(a, F.lit(" "), F.get(w, i + 1)),
            ),
        ),
    )


def hashed_vectors(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, bucket, weight): signed counts in 512 buckets, from the md5 of each term.

    The bucket is the first eight digest bytes modulo 512, that is their last
    nine bits; the sign is the second highest bit.
    """
    term = docs.select(*keys, F.explode(hashed_terms(text)).alias("term")).withColumn("h", F.md5("term"))
    bucket = F.conv(F.substring("h", 14, 3), 16, 10).cast("int") % DIMENSIONS
    plus = F.conv(F.substring("h", 1, 1), 16, 10).cast("int").bitwiseAND(4) > 0
    signed = term.select(*keys, bucket.alias("bucket"), F.when(plus, 1).otherwise(-1).alias("s"))
    return signed.groupBy(*keys, "bucket").agg(F.sum("s").alias("weight")).filter("weight <> 0")


def cosine(a, b) -> Column:
    """Dot product of two arrays of equal length."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def best_window(words, terms, width: int, step: int, marks: str = EDGE_MARKS) -> Column:
    """struct(score, at) of the first best window: most words whose bare form is a wanted term."""
    # a letter a word, so that a window is a substring and its score the number of ones in it; the terms are
    # bound, since the optimizer may put what they are made of in place of the column, for every word again
    bare = lambda w: F.trim(F.lower(w), F.lit(marks))
    flags = X.let(
        terms if isinstance(terms, Column) else F.col(terms),
        lambda ts: F.array_join(F.transform(words, lambda w: F.when(F.array_contains(ts, bare(w)), "1").otherwise("0")), ""),
    )

    def best(f: Column) -> Column:
        def score(start: Column) -> Column:
            inside = F.length(F.replace(f.substr(start + 1, F.lit(width)), F.lit("0"), F.lit("")))
            return F.struct((-inside).alias("k"), start.alias("at"))

        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(f) - width), F.lit(step))
        return F.array_min(F.transform(starts, score))

    return X.let(X.let(flags, best), lambda b: F.struct((-b["k"]).alias("score"), b["at"].alias("at")))


def window_text(words, at, width: int) -> Column:
    return F.array_join(F.slice(words, at + 1, F.lit(width)), " ")


def quote_terms(quote) -> Column:
    """Distinct bare words of five letters or more of a quotation."""
    long_words = F.filter(X.words(quote), lambda w: F.length(w) >= X.LONG_WORD)
    edge = "[.,;:()\"'“”]+"
    return F.array_distinct(F.transform(long_words, lambda w: F.regexp_replace(F.lower(w), f"^{edge}|{edge}$", "")))


def proportional_window(text, text_norm, quote, width: int) -> Column:
    """The part of a text around a quotation, located in the normalised text and mapped by proportion; null where it is not there."""
    text, text_norm = F.col(text), F.col(text_norm)
    at = F.position(X.normalize(quote), text_norm) - 1
    there = F.floor(at / F.greatest(F.lit(1), F.length(text_norm)) * F.length(text)).cast("int")
    lo = F.greatest(F.lit(0), there - width // 2)
    return F.when(at >= 0, text.substr(lo + 1, there + width // 2 - lo))


def longest_common_run(a: str, b: str) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest run of both; the first in a, then the first in b, of equals."""
    at = size = 0
    for i in range(len(a)):
        while i + size < len(a) and a[i : i + size + 1] in b:  # a run that is not there has no longer one
            at, size = i, size + 1
    return at, b.find(a[at : at + size]), size


@F.pandas_udf(T.StructType().add("window", T.StringType()).add("ratio", T.DoubleType()))
def closest_region(fragment: pd.Series, text: pd.Series) -> pd.DataFrame:
    """Window of a text around the longest run it shares with a fragment, and the similarity ratio."""
    out = []
    for frag, body in zip(fragment, text):
        a, b, size = longest_common_run(frag, body)
        if size < 10:
            out.append((None, 0.0))
            continue
        lo = max(0, b - a - 40)
        window = body[lo : lo + len(frag) + 80]
        out.append((window, round(difflib.SequenceMatcher(None, frag, window).ratio(), 3)))
    return pd.DataFrame(out, columns=["window", "ratio"])
