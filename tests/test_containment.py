"""The containment join against brute force, for every anchor kind and both strategies."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import containment as J

VOCAB = ["the", "of", "court", "jurisdiction", "constitutionality", "a", "held", "interstatecommerce", "tax", "states"]


def corpus(seed, n):
    r = random.Random(seed)
    docs = [" ".join(r.choice(VOCAB) for _ in range(r.randint(1, 60))) for _ in range(n)]
    return docs + [docs[0]] * (n // 2)  # a third of all texts are copies of one


def fragments(docs, seed):
    r = random.Random(seed)
    out = ["absentword of the", "constitutionality", "titutionalitywithmore", "nstitutionality", "interstatecommer", "x"]
    for d in docs:
        if len(d) > 20:
            i = r.randint(0, len(d) - 16)
            out.append(d[i : i + r.randint(3, 60)].strip())  # starts and ends inside words
    return sorted({f for f in out if f})


@pytest.mark.parametrize("limit", [J.BROADCAST_BYTES, 0])
def test_contained(spark, limit):
    docs = corpus(1, 40)
    frags = fragments(docs, 2)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    f = spark.createDataFrame(list(enumerate(frags)), "fid int, frag string")
    kinds = {r[0] for r in J.with_anchor(f, "frag").select("_kind").distinct().collect()}
    assert kinds == {"run", "inner", "affix", "long", "bare"}
    got = J.contained(f, d, frag_id="fid", frag="frag", doc_id="doc_id", text="text", limit=limit)
    rows = [(r.fid, r.doc_id) for r in got.collect()]
    expect = {(i, j) for i, x in enumerate(frags) for j, t in enumerate(docs) if x in t}
    assert len(rows) == len(set(rows)) and set(rows) == expect


@pytest.mark.parametrize("limit", [J.BROADCAST_BYTES, 0])
def test_contained_gapless(spark, limit):
    docs = corpus(3, 30) + ["", "ap plication of the sta tute"]
    frags = fragments(docs, 4) + ["application of the statute"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    f = spark.createDataFrame(list(enumerate(frags)), "fid int, frag string")
    got = J.contained_gapless(f, d, frag_id="fid", frag="frag", doc_id="doc_id", text="text", limit=limit)
    rows = [(r.fid, r.doc_id) for r in got.collect()]
    bare = lambda s: s.replace(" ", "")
    expect = {(i, j) for i, x in enumerate(frags) for j, t in enumerate(docs) if bare(x) in bare(t)}
    assert len(rows) == len(set(rows)) and set(rows) == expect


def test_probe_falls_back_to_the_middle_words(spark):
    from plumbline.operators import provenance as S

    words = [f"word{i}" for i in range(14)]
    docs = [" ".join(words[2:12]) + " tail", "other text here", " ".join(words)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, norm string")
    swapped = " ".join(["zz", *words[1:13], "yy"])
    p = spark.createDataFrame([(1, " ".join(words)), (2, swapped), (3, "nothing like it at all here")], "q int, frag string")
    hits = {(r.q, r.doc_id, r.n) for r in S.probe_hits(p, d, "frag", "doc_id", "norm").join(p, "frag").collect()}
    assert hits == {(1, 2, 1), (2, 0, 1), (2, 2, 1)}


def test_first_hits_counts_repeats_in_order(spark):
    from plumbline.operators import provenance as S

    h = spark.createDataFrame([(1, 5, 2), (1, 9, 4), (1, 11, 1), (2, 3, 7)], "q int, doc_id int, n int")
    got = {(r.q, r.doc_id, r.taken) for r in S.first_hits(h, "q", "doc_id", 3).collect()}
    assert got == {(1, 5, 2), (1, 9, 1), (2, 3, 3)}
    assert spark.sql("select 'aaaa' as t, 'aa' as p").select(S.occurrences(F.col("t"), F.col("p"))).first()[0] == 3


def test_common_runs_are_no_anchors(spark):
    """300 texts share a license line that every fragment quotes: only the rest of a fragment tells them apart."""
    from plumbline.operators import containment as J

    line = "licensed under extraordinarily permissive international conditions"
    word = lambda i: f"w{i * 7919 % 997}x"
    docs = spark.createDataFrame([(i, f"start {line} then {word(i)} {word(i + 1)} {word(i + 2)} end") for i in range(300)], "did long, text string")
    frags = spark.createDataFrame([(i, f"{line} then {word(i)} {word(i + 1)} {word(i + 2)} e") for i in range(300)], "fid long, frag string")
    anchored = J.with_anchor(frags, "frag")
    better = J.rarest_anchor(anchored, J.common_runs(docs, "did", "text"), "fid", "frag")
    assert anchored.select("_anchor").distinct().count() == 1 and better.select("_anchor").distinct().count() > 250
    rows = J.contained(frags, docs, frag_id="fid", frag="frag", doc_id="did", text="text", limit=0).collect()
    assert sorted(map(tuple, rows)) == [(i, i) for i in range(300)]


def test_short_fragments_in_blocks(spark):
    from plumbline.operators import containment as J

    docs = spark.createDataFrame([(i, f"text{i} b{i}") for i in range(20)], "did long, text string")
    frags = spark.createDataFrame([(i, f"b{i}") for i in range(20)], "fid long, frag string")
    parts = J._nested(docs, frags, 20, 4, "text", "frag").select("fid", "did").collect()
    assert len(parts) == len(set(parts)) and {(r.fid, r.did) for r in parts} == {(i, j) for i in range(20) for j in range(20) if f"b{i}" in f"text{j} b{j}"}


def test_texts_send_on_only_keys_that_some_fragment_may_have(spark):
    """Of 200 texts of 50 words one holds the fragment: the keys of the others stay where they are."""
    from plumbline.operators import containment as J

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(200)], "did long, text string")
    frags = spark.createDataFrame([(1, " ".join(f"w7x{k}" for k in range(10, 20)))], "fid long, frag string")
    anchors = J.with_anchor(frags, "frag", stretches=True)
    assert anchors.first()._kind == J.STRETCH and J.with_anchor(frags, "frag").first()._kind == J.RUN
    held = J._holds(J._bit_map(anchors, 1), 1)
    keys = docs.select("did", F.explode(J._text_keys(F.col("text"), {J.STRETCH})).alias("_anchor"))
    assert keys.count() == 200 * 45
    kept = keys.where(held)
    assert kept.count() < 45 and 7 in {r.did for r in kept.collect()}
    assert J._bits_of(1) == 4096 and J._bits_of(10_000) == 1 << 18 and J._bits_of(10**9) == J.MOST_BITS
    pairs = J.contained(frags, docs, frag_id="fid", frag="frag", doc_id="did", text="text", limit=0).collect()
    assert [(r.fid, r.did) for r in pairs] == [(1, 7)]


def test_located_counts_places(spark):
    """Every fragment's places as by brute force: broadcast, joined by anchors, and with the commonest verified where texts are read."""
    r = random.Random(5)
    line = "licensed under extraordinarily permissive international conditions"
    vocab = VOCAB + [f"w{i}" for i in range(40)]
    docs = [" ".join([line] * (i % 4) + [r.choice(vocab) for _ in range(r.randint(1, 50))] + [line] * (i % 3)) for i in range(60)]
    frags = sorted({*fragments(docs, 6), line, line[3:-4], f"{line} {line}", "constitutionality" * 2, "of " * 5 + "of", docs[7], f"{docs[9]} absent"})
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    f = spark.createDataFrame(list(enumerate(frags)), "fid int, frag string")
    places = lambda x, t: sum(t.startswith(x, i) for i in range(len(t)))
    expect = {(i, j, places(x, t)) for i, x in enumerate(frags) for j, t in enumerate(docs) if x in t}
    assert max(n for _, _, n in expect) > 3
    for limit in (J.BROADCAST_BYTES, 4_000, 0):
        got = J.located(f, d, frag_id="fid", frag="frag", doc_id="doc_id", text="text", limit=limit)
        assert sorted(map(tuple, got.collect())) == sorted(expect)


def test_quotations_are_cut_without_taking_whole_texts_apart(spark, folder):
    from plumbline.plans import views as V
    from plumbline.session import Tables

    t = Tables(spark, folder)
    short, full = V.doc_quotes(t, whole=False), V.doc_quotes(t)
    assert short.agg(F.max(F.size("w"))).first()[0] == 26 < full.agg(F.max(F.size("w"))).first()[0]
    assert sorted(short.select("doc_id", "quote").collect()) == sorted(full.select("doc_id", "quote").collect())
