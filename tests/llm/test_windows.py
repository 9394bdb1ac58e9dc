"""Substring dedup and decontamination against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from plumbline.llm import decontaminate as D
from plumbline.llm import substring_dedup as S
from plumbline.llm import words as W
from plumbline.llm.queries import op1_substring_dedup, op9_decontaminate


def brute_dedup(rows, length=50):
    first, split = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - length + 1) if i is not None else ():
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_hits(docs, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1) if w else ():
            grams.setdefault(tuple(w[k : k + size]), set()).add(i)
    sizes = sorted({len(g) for g in grams})
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    hit.update(range(k, k + size))
                    found |= grams[g]
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def pairs(df, key="doc_id"):
    return [(r[key], r.text) for r in df.select(key, "text").collect()]


def ordered(rows):
    return sorted(map(str, rows))


def test_dedup_of_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = op1_substring_dedup(spark, folder).collect()
    want = brute_dedup(pairs(docs))
    assert ordered(map(tuple, got)) == ordered(want) and sum(r[2] for r in want) > 0


@pytest.mark.parametrize("length", [4, 7])
def test_dedup_of_repeating_words(spark, length):
    rng = random.Random(length)
    rows = [(rng.randrange(60), " ".join(rng.choice("ab") for _ in range(rng.randrange(14)))) for _ in range(90)]
    rows += [(100 + k, "hot passage of words that all of these documents hold " + str(k)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.digest(S.substring_dedup(docs, length)).collect()
    assert ordered(map(tuple, got)) == ordered(brute_dedup(rows, length))


def test_dedup_with_a_full_sketch_loses_nothing(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(30))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    drops = S.repeats(docs, 6, cells_per_anchor=1, max_cells=1 << 8)
    assert drops.count() == sum(1 for r in brute_dedup(rows, 6) if r[2])


def test_dedup_of_odd_rows(spark, odd, empty):
    got = S.digest(S.substring_dedup(odd)).collect()
    assert ordered(map(tuple, got)) == ordered(brute_dedup(pairs(odd)))
    assert S.digest(S.substring_dedup(empty)).collect() == []


def test_bytes_split_at_ascii_white_space_only():
    text = "a\x1cb c\x0bd\x85e f\r\ng"
    raw, at = W.text_bytes(__import__("pyarrow").array([text, None, "x", "y"]))
    starts, ends, doc = W.spans(raw, at, W.NOT_SPACE)
    assert [raw[a : b + 1].tobytes().decode() for a, b in zip(starts, ends)] == re.findall(r"[^\x20\x09-\x0D]+", text) + ["x", "y"]
    assert doc.tolist()[-2:] == [2, 3]
    one, two = W.word_hashes(raw, starts, ends), W.word_hashes(*(lambda r, a: (r, *W.spans(r, a, W.NOT_SPACE)[:2]))(*W.text_bytes(__import__("pyarrow").array(["y x"]))))
    assert one[-2:].tolist() == two[::-1].tolist() and len(np.unique(one)) == len(one)


def test_hits_of_the_table(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = op9_decontaminate(spark, folder).collect()
    want = brute_hits(pairs(docs), pairs(items, "item_id"))
    assert ordered(map(tuple, got)) == ordered(want) and any(r[5] for r in want)


def test_hits_of_short_items_in_blocks(spark):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abC") for _ in range(rng.randrange(9)))) for k in range(20)] + [(20, None), (None, "a a"), (3, "b")]
    rows = [(k, " ".join(rng.choice("aBcde1") for _ in range(rng.randrange(40)))) for k in range(80)] + [(5, "é É"), (5, "é")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 5):
        got = D.digest(D.contamination(docs, bench, 4, block_windows=block)).collect()
        assert ordered(map(tuple, got)) == ordered(brute_hits(rows, [i for i in items if i[0] is not None], 4))


def test_hits_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, "")], "item_id long, text string")
    got = D.digest(D.contamination(odd, bench)).collect()
    assert ordered(map(tuple, got)) == ordered(brute_hits(pairs(odd), [(1, "one")]))
    assert D.contamination(empty, bench).collect() == []
    assert not any(r.contaminated for r in D.contamination(odd, bench.limit(0)).collect())


def test_decontaminate_rejects_or_cuts(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    rows = [(1, "Alpha, beta GAMMA!"), (2, "x " * 70 + "alpha beta gamma, " + "y"), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hits", "2 AS rejected")
    kept = {r.doc_id: r.text for r in D.decontaminate(docs, bench).collect()}
    assert kept == {2: rows[1][1], 3: "clean"}
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, bench, spans=True).collect()}
    assert cut == {2: "x " * 70 + ", y", 3: "clean"}
    assert D.decontaminate(docs, bench).columns == docs.columns
