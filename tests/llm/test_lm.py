"""The log-bilinear model: counts and base scores by brute force, normalisation, gradients, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import log_bilinear as lm
from plumbline.llm.tables import read


def tokens(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [None]


def base(rows):
    """The contract's columns but for the model's score."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    one = lambda w: math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1)))
    return [(d, held(d), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(map(one, tokens(t))), 6)) for d, t in rows]


def order(r):
    return tuple((x is not None, x) for x in r)


@pytest.fixture(scope="module")
def scored(spark, folder):
    return lm.lm_scores(read(spark, folder, "documents")).collect()


def test_counts_and_base_scores(spark, folder, scored):
    rows = [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]
    got = [(*r[:5], round(r.base_score, 6)) for r in scored]
    assert sorted(got, key=order) == sorted(base(rows), key=order)
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)


def test_few_hot_words_change_no_base_score(spark, folder, scored):
    """Most words then go by the join with the counts."""
    few = lm.lm_scores(read(spark, folder, "documents"), hot=50, out=20, rounds=1).collect()
    cut = lambda rows: sorted((*r[:5], round(r.base_score, 6)) for r in rows)
    assert cut(few) == cut(scored)


def test_held_out_texts_gain_on_the_base(spark):
    rows = lm.lm_scores(read(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    n = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.03
    assert sum(r.score > r.base_score for r in rows) > 0.75 * len(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = lm.lm_scores(odd).collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=order) == sorted(base(rows), key=order)
    assert all(math.isfinite(r.score) for r in got)
    repeated = [r.score for r in got if r.n_tokens == 4001]
    assert len(repeated) == 2 and repeated[0] == pytest.approx(repeated[1], rel=1e-5)
    assert lm.lm_scores(empty).collect() == []
    untrained = lm.lm_scores(odd.where("doc_id = 5"))  # crc32("5") % 5 == 1
    assert [(r.held_out, r.train_tokens, r.base_score) for r in untrained.collect()] == [(True, 0, 0.0)]


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(2)
    words = lm.Words(np.concatenate(([lm.END], rng.integers(1, 1 << 62, 40))).astype(np.uint64), np.arange(60, 19, -1), 2000, 70, out=12)
    ids = pa.array([rng.integers(-1, 41, k).tolist() for k in (1, 2, 30, 7)], pa.list_(pa.int32()))
    model = lm.Model(words, width=5)
    model.r, model.q = (rng.normal(0, 0.5, x.shape).astype(np.float64) for x in (model.r, model.q))
    return words, model, ids


def test_probabilities_sum_to_one(small):
    words, model, ids = small
    for s, _ in lm.stretches(ids, 16):
        h = model.contexts(s)[0]
        total = sum(np.exp(model.log_probability(h, np.full(len(h), k))) for k in range(words.out + 1))
        assert np.allclose(total, 1, atol=1e-4)
        assert np.isfinite(model.log_probability(h * 500, np.zeros(len(h), int))).all()


def test_stretches_cut_no_context(small):
    """Whatever the step, each target has the same context."""
    _, model, ids = small
    by = [np.concatenate([model.contexts(s)[0] for s, _ in lm.stretches(ids, step)]) for step in (3, 16, 1000)]
    assert np.allclose(by[0], by[2], atol=1e-5) and np.allclose(by[1], by[2], atol=1e-5)
    assert len(by[0]) == 40


def test_gradients_equal_differences(small):
    _, model, ids = small
    work = lm.Trainer(model.copy(), 0.1, (0,))
    s = next(lm.stretches(ids, 1000))[0]
    noise = np.array([0, 3, 3, 12])

    def loss(m):
        h = m.contexts(s)[0]
        y = np.where((s.target >= 0) & (s.target < 12), s.target, 12)
        good = (h * m.q[y]).sum(1) + m.b[y] - work.offset[y]
        bad = h @ m.q[noise].T + m.b[noise] - work.offset[noise]
        return np.logaddexp(0, -good).sum() + np.logaddexp(0, bad).sum()

    g = work.gradients(s, noise)
    for name in "rqbc":
        value = getattr(model, name).astype(np.float64)
        full = g[name] if name == "c" else np.zeros(value.shape)
        if name != "c":
            np.add.at(full, g[name][0], g[name][1])
        for at in list(np.ndindex(value.shape))[::7]:
            moved = []
            for d in (1e-3, -1e-3):
                m = model.copy()
                v = value.copy()
                v[at] += d
                setattr(m, name, v)
                moved.append(loss(m))
            assert full[at] == pytest.approx((moved[0] - moved[1]) / 2e-3, rel=0.02, abs=0.02)


def test_packing_keeps_the_parameters(small):
    _, model, _ = small
    other = model.copy()
    lm.unpacked(other, lm.packed(model))
    assert np.allclose(other.r, model.r) and np.allclose(other.q, model.q) and np.allclose(other.b, model.b) and np.allclose(other.c, model.c)
    assert all(np.allclose(other.seen[k], model.seen[k]) for k in "rqbc")
