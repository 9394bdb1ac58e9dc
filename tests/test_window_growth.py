"""Per-text work that is done once: wanted terms, packets, runs shared with a fragment, verdicts of the arms."""

import difflib
import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import text as X
from plumbline.operators import retrieval as Q

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_wanted_terms_are_not_made_for_every_word(spark):
    made = plan(entry.queries()["best_excerpt_windows"](spark, SF))
    assert "array_contains(array_distinct" not in made


def test_best_window_against_a_loop(spark):
    r = random.Random(5)
    rows = [(i, [r.choice(["Law", "“law”", "the", "(Tax),", "tax", "of.", "", "..."]) for _ in range(r.randint(0, 70))]) for i in range(40)]
    d = spark.createDataFrame(rows, "i int, w array<string>").select("i", Q.best_window("w", F.array(F.lit("law"), F.lit("tax")), 12, 5, Q.QUOTE_EDGE_MARKS).alias("b"))
    got = {x.i: (x.b.score, x.b.at) for x in d.collect()}
    for i, w in rows:
        flags = [x.lower().strip(Q.QUOTE_EDGE_MARKS) in ("law", "tax") for x in w]
        scores = [(-sum(flags[a : a + 12]), a) for a in range(0, max(0, len(w) - 12) + 1, 5)]
        assert got[i] == (-min(scores)[0], min(scores)[1])


def test_longest_common_run_against_difflib():
    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 30))) for _ in range(2))
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert Q.longest_common_run(a, b) == (m.a, m.b, m.size)


def test_packets_and_failed_quotes_are_made_once(spark):
    assert plan(entry.queries()["packets"](spark, SF)).count("We affirm.") == 1
    assert plan(entry.queries()["closest_regions_of_failed_quotes"](spark, SF)).count("‘’'") == 3  # text, fragments, quotation


def test_feedback_arms_read_the_texts_once(spark):
    made = plan(entry.queries()["feedback_arms"](spark, SF))
    assert "text#" not in made  # both branches read the staged rows


def test_words_are_cut_at_the_same_places(spark):
    rows = ["", "  ", "a", "\t a  b\n", "\x0b\fa\r", "a b  ", None]
    d = spark.createDataFrame([(t,) for t in rows], "s string").select(X.words("s").alias("w"))
    assert [r.w for r in d.collect()] == [[], [], ["a"], ["a", "b"], ["a"], ["a b", " "], None]
