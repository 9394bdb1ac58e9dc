"""Holders of fragments: all of them count, and copies stay linear."""

from pyspark.sql import functions as F

from plumbline.operators import provenance as S

TEXT = "the quick brown fox jumps over the lazy dog near the old stone bridge by the river every day"


def corpus(spark, copies):
    rows = [(i, f"Holder{i} v. State", f"text {i} {TEXT} end") for i in range(copies)] + [(5000, "Attributed v. Holder7", "something else entirely here")]
    return spark.createDataFrame(rows, "doc_id long, caption string, norm string")


def test_copies_stay_linear_and_late_holders_count(spark):
    k = 400
    docs = corpus(spark, k)
    frag = "quick brown fox jumps over the lazy dog near the old stone bridge"
    asked = spark.createDataFrame([(q, frag, 5000) for q in range(k)] + [(-1, "words that no text holds at all anywhere", 5000)], "q long, frag string, att long")
    hits = S.probe_hits(asked, docs, "frag", "doc_id", "norm")
    assert hits.count() == k  # not k * k
    held = S.holders(hits, "frag", "doc_id").collect()
    assert [(r.occurrences, r.sources, r.distinctive) for r in held] == [(k, k, True)]
    tokens = docs.select("doc_id", F.transform(F.regexp_extract_all("caption", F.lit(r"\w+"), F.lit(0)), F.lower).alias("tokens"))
    own = S.held_by_attributed(asked, hits, tokens, "q", "frag", "doc_id", "att")
    assert own.count() == k  # the eighth holder is the attributed one; the first three are not
    first = S.first_hits(hits, "frag", "doc_id", 3).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == [(0, 1), (1, 1), (2, 1)]


def test_middle_words_where_no_text_holds_the_whole(spark):
    docs = corpus(spark, 2)
    w = TEXT.split()
    torn = " ".join(["xx", *w[:12], "yy"])
    got = S.probe_hits(spark.createDataFrame([(torn,)], "frag string"), docs, "frag", "doc_id", "norm").collect()
    assert {r.doc_id for r in got} == {0, 1} and all(len(r.probe.split()) == 10 for r in got)
