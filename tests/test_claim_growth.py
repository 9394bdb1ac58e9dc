"""What the extraction of claims may not do more than once a text."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import text as X
from plumbline.operators import claims as O


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_quotations_are_looked_for_once(spark):
    drafts = spark.createDataFrame([(1, "He said “one two three four five six”.")], "draft int, text string")
    written = drafts.select("draft", F.concat("text", F.lit(" "), "text").alias("text"))
    q = O.quotations(written, "draft", "text")
    assert "size(array_sort" not in plan(q)  # no second evaluation ahead of the explosion
    assert [r.start for r in q.orderBy("start").collect()] == [9, 48]


def test_spans_take_one_pass_and_keep_texts_that_hold_the_mark(spark):
    rows = [(0, "a1b22c"), (1, f"x{X.MARK}1{X.MARK}22"), (2, "none"), (3, ""), (4, None), (5, "1"), (6, "é1😀2")]
    d = spark.createDataFrame(rows, "i int, s string").select("i", X.spans("s", r"\d+").alias("m")).orderBy("i")
    got = [None if r.m is None else [(m.start, m.body) for m in r.m] for r in d.collect()]
    assert got == [[(1, "1"), (3, "22")], [(2, "1"), (4, "22")], [], [], None, [(0, "1")], [(1, "1"), (3, "2")]]
    assert "regexp_extract_all" not in plan(d).split("CASE WHEN")[0]


def test_statute_patterns_say_the_same(spark):
    texts = ["the ohio supreme court said", "the ninth circuit and 42 u.s.c. 3", "an act of congress", "s. rep. and the state argues", "rule 7 is fed. r. civ.",
             "factory code", "contact", "the district court below", "states supreme court", "no court", "the constitution, clause 3"]
    d = spark.createDataFrame([(t,) for t in texts], "s string")
    before, after = F.split("s", O.STATUTE.removeprefix("(?i)"), -1), F.split("s", O.STATUTE_LOWER, -1)
    assert all(r.a == r.b for r in d.select(before.alias("a"), after.alias("b")).collect())
    short = d.where(~F.contains("s", F.lit(" supreme court")) & ~F.contains("s", F.lit(" circuit")))
    assert all(r.a == r.b for r in short.select(before.alias("a"), F.split("s", O.STATUTE_BUT_COURTS, -1).alias("b")).collect())


def test_distance_of_a_token_that_is_part_of_a_longer_word(spark):
    rows = [("roe and roes said", "roe"), ("roes and roe, he", "roe"), ("heroes", "roe"), ("o'neil and co", "o'neil"), ("roe", "roe"), ("", "roe")]
    d = spark.createDataFrame(rows, "s string, t string")
    got = d.select(O._distance(F.col("s"), F.col("t"), True).alias("l"), O._distance(F.col("s"), F.col("t"), False).alias("f")).collect()
    assert [(r.l, r.f) for r in got] == [(14, 0), (4, 9), (None, None), (7, 0), (0, 0), (None, None)]


def test_caption_parts(spark):
    texts = ["See also; Roe v. Wade, 4", "A said. Doe v Poe ", "no caption, ", "Roe v. ", " v. Poe, "]
    d = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in d.select(N.claimed_caption(F.col("s"), F.length("s"))).collect()]
    assert got == ["Roe v. Wade, 4", "Doe v. Poe", None, None, None]
