"""Toxicity, near-dedup, line dedup, the transducer and the pipeline against plain Python."""

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import line_dedup as L
from plumbline.llm import near_dedup as N
from plumbline.llm import toxicity as X
from plumbline.llm import transducer as D
from plumbline.llm.queries import op2_toxicity, op3_near_dedup, op7_transducer, op8_line_dedup

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_classes(rows, similar=0.8):
    """Class ids of (doc_id, text) rows by comparing all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) >= similar * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted(((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g), key=str)


def test_classes_of_the_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, op3_near_dedup(spark, folder).collect()), key=str) == brute_classes(rows)


def test_classes_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, N.near_dedup(odd).collect()), key=str) == brute_classes(rows)
    assert N.near_dedup(empty).collect() == [] and N.keep_one(empty).collect() == []
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == round(sum(1 / n for *_, n in brute_classes(rows)))


def test_a_large_group_and_a_chain_are_joined(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(10**6))
    base = [word() for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):  # near the base, further from one another
        w = list(base)
        for at in rng.sample(range(150), 2):
            w[at] = word()
        rows.append((k, " ".join(w)))
    chain = [word() for _ in range(200)]
    for k in range(60, 70):  # each near the one before
        chain = chain[5:] + [word() for _ in range(5)]
        rows.append((k, " ".join(chain)))
    moved = [word() for _ in range(300)]
    rows += [(70, " ".join(moved)), (71, " ".join(moved[150:] + moved[:150]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_dedup(docs).collect()), key=str) == brute_classes(rows)


def baseless_family(n, seed):
    """Copies of an absent text with four words changed in each: most pairs lie just under 0.8, some above."""
    rng = random.Random(seed)
    base = ["w" + str(rng.randrange(10**6)) for _ in range(300)]
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(300), 4):
            w[at] = "e" + str(rng.randrange(10**9))
        yield k, " ".join(w)


def test_links_of_a_large_family_without_its_base(spark):
    rows = list(baseless_family(400, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_dedup(docs, block=16).collect()), key=str) == brute_classes(rows)


def test_maps_never_rule_out_similar_texts():
    rng = random.Random(8)
    for size in (6, 40, 300, 4000):
        a = np.array([rng.randrange(10**9) for _ in range(size)], np.uint64)
        for changed in range(0, size, max(1, size // 20)):
            b = a.copy()
            b[:changed] += np.uint64(10**9)
            maps = [np.packbits(np.isin(np.arange(N.MAP_BITS), N.W.mix(x) % np.uint64(N.MAP_BITS))).view(np.uint64)[None] for x in (a, b)]
            n, both = np.array([size]), size - changed
            if both >= 0.8 * (2 * size - both):
                assert N.may_be_similar(n, maps[0], n, maps[1], 0.8)[0, 0]


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(12))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(old[j] + (x != y), old[j + 1] + 1, row[-1] + 1))
        for band in range(7):
            assert N.banded_distance(np.array(a), np.array(b), band) == min(row[-1], band + 1), (a, b, band)


def test_lines_of_the_table(spark, folder):
    got = sorted(map(tuple, op8_line_dedup(spark, folder).select("doc_id", "n_removed", "kept_sha256").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert got == sorted(con.execute(L.ORACLE).fetchall()) and sum(r[1] for r in got) > 0


@pytest.mark.parametrize("sites", [2, 5, 10])
def test_lines_near_the_threshold(spark, sites):
    rng = random.Random(sites)
    rows = []
    for k in range(400):
        lines = [f"line {rng.randrange(60)} of {max(1, int(60 / (1 + rng.randrange(30))))}" for _ in range(5)]
        rows.append((k, "\n".join(["everywhere ", *lines, "", "  "]), f"s{rng.randrange(40)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    on, first, want = {}, {}, {}
    for d, t, s in rows:
        for p, x in enumerate(t.split("\n")):
            on.setdefault(x.strip(), set()).add(s)
            first.setdefault(x.strip(), (d, p))
    for d, t, s in rows:
        want[d] = "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or len(on[x.strip()]) < sites or first[x.strip()] == (d, p))
    assert {r.doc_id: r.text for r in L.remove_lines(docs, sites).collect()} == want


def test_lines_of_odd_rows(spark, odd, empty):
    got = L.remove_lines(odd, 2)
    assert got.columns == odd.columns and sorted(str(r) for r in got.collect()) == sorted(str(r) for r in odd.collect())
    assert L.remove_lines(empty).collect() == [] and L.line_dedup(empty).collect() == []


def test_estimates(spark):
    for n in (1, 10, 60, 2000):
        df = spark.range(n).select(*(c.alias(f"s{k}") for k, c in enumerate(L.sketch(F.col("id").cast("string"))))).agg(*(F.bit_or(f"s{k}").alias(f"s{k}") for k in range(8)))
        assert abs(df.select(L.estimate([F.col(f"s{k}") for k in range(8)])).first()[0] - n) <= 4 * L.error(n) + 0.1


def test_ids_are_the_models_own():
    tool, own, rng = D.Transducer(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(4)
    atoms = ["a", "b", "the", " ", "  ", "▁", "é", "日本", "😀", "\n", "\t", "1", "aaa", "<s>", "<0x0A>", "://", "==", "\x00", "ing", " " * 20, ".", "́"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", "." * 200, "é" * 3000, " "]
    for t in texts:
        ids = np.frombuffer(tool.encode(t), np.int32)
        assert ids.tolist() == own.encode(t), t
        assert tool.decode(ids) == t.replace("▁", " "), t


def test_ids_of_the_table(spark, folder):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op7_transducer(spark, folder).collect()
    assert len(rows) == len(docs) and all(r.exact and r.ids == own.encode(docs[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


def test_ids_of_odd_rows(spark, odd, empty):
    rows = D.encoded_documents(odd, PIECES).collect()
    assert len(rows) == odd.count() and all(r.exact for r in rows) and any(r.n_tokens == 0 for r in rows)
    assert D.encoded_documents(empty, PIECES).collect() == []


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = op2_toxicity(spark, folder).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    good, bad = ([r.score for r in rows if r.held_out and toxic.get(r.doc_id) == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.88
    assert np.mean(np.array(bad) >= 0.7) < 0.05


def test_misspellings_share_grams(spark):
    rng = random.Random(6)
    filler = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(30))
    rows = [(k, filler() + (" you idiotic moron" if k % 3 == 0 else " dear friend"), int(k % 3 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = X.train(docs, docs, epochs=6)
    probe = spark.createDataFrame([(1, filler() + " you idiotick morons"), (2, filler())], "doc_id long, text string")
    score = {r.doc_id: r[X.SCORE] for r in X.score(probe, model).collect()}
    assert score[1] > 0.7 > score[2]


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 0, 1), (None, 1, 0), (4, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = X.toxicity(odd, labels, epochs=1).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in X.toxicity(odd, labels.limit(0)).collect()} == {0.5}
    assert X.toxicity(empty, labels).collect() == []
    assert X.drop_toxic(odd, labels.limit(0)).columns == odd.columns


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, folder)
        rows = spark.createDataFrame(out.collect(), out.schema)
        if name != "encoding":
            assert rows.columns == docs.columns and set(r.doc_id for r in rows.collect()) <= set(r.doc_id for r in seen.collect())
        if name == "near_dedup":
            want = brute_classes([(r.doc_id, r.text) for r in seen.collect()])
            assert sorted(r.doc_id for r in rows.collect()) == sorted({c for _, c, _ in want})
        seen = rows
    assert sorted(str(r) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(str(r) for r in seen.collect())


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rng = random.Random(4)
    key = lambda k: zlib.crc32(str(k).encode()).to_bytes(4, "big") * 4
    pairs = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(200)]
    rng.shuffle(pairs)
    edges = spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "a binary, b binary").repartition(7)
    want = {}
    for a, b in pairs:
        both = want.get(a, {a}) | want.get(b, {b})
        want.update(dict.fromkeys(both, both))
    want = sorted((key(x), min(map(key, group))) for x, group in want.items() if key(x) != min(map(key, group)))
    for most in (N.EDGES, 100):
        monkeypatch.setattr(N, "EDGES", most)
        assert sorted((bytes(r[0]), bytes(r[1])) for r in N.components(edges).collect()) == want


def test_links_of_a_small_table_are_joined_in_few_jobs(spark):
    key = lambda k: zlib.crc32(str(k).encode()).to_bytes(4, "big") * 4
    edges = spark.createDataFrame([(key(k), key(k + 1)) for k in range(300)], "a binary, b binary").repartition(7)
    context = spark.sparkContext
    context.setJobGroup("components of a chain", "")
    try:
        N.components(edges).collect()
    finally:
        context._jsc.sc().clearJobGroup()
    assert len(context.statusTracker().getJobIdsForGroup("components of a chain")) < 12


def test_parts_of_a_dealt_bucket_all_meet(spark):
    rows = list(baseless_family(300, 6))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.near_dedup(docs, block=8, dealt=40).collect()), key=str) == brute_classes(rows)
