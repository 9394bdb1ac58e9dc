"""Hard-negative mining and bit-plane clustering against plain Python."""

import hashlib
import math

import numpy as np
import pytest

from plumbline.llm import bit_planes, hard_negatives

COLUMNS = "vec_id long, embedding array<double>, label int, block int, group int, bucket string, score double, slot int, planes int, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], COLUMNS)


def usable(rows):
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    return [r for r in rows if r[0] is not None and r[2] is not None and fine(r[1])]


def mined(rows, every=100, noisy=7):
    kept = [(i, [math.floor(256 * x) for x in v], (c + 1) % 10 if i % noisy == 0 else c) for i, v, c in usable(rows)]
    anchors = {}
    for i, v, c in kept:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v)), i, c) for i, v, c in kept if i != a]
        near = sorted((s, i) for s, i, c in scored if c == label)[:5]
        for place, (s, p) in enumerate(near, 1):
            fits = sorted((t, i) for t, i, c in scored if c != label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(a, p, r, i, -s, -t, place) for r, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def clustered(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()))
    centroids = [list(v) for _, v in order[:k]]
    square = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min((square(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        where = [nearest(v)[1] for _, v in kept]
        for n in set(where):
            members = [v for (_, v), w in zip(kept, where) if w == n]
            centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = lambda n: sum(d for _, d, m in last if n in (None, m))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return [(i, n, d, inertia(n), inertia(None), digest(centroids[n])) for i, d, n in last]


@pytest.fixture(scope="module")
def vectors():
    """Skewed lengths, a vector that a third of the rows share, rows of other sizes, ties, opposite and zero vectors."""
    rng = np.random.default_rng(5)
    directions = rng.normal(size=(6, 64))
    common = (directions[0] / 8).tolist()
    rows = []
    for i in range(2400):
        v = (directions[rng.integers(6)] + rng.normal(size=64) * 0.6) * rng.lognormal(-2, 1)
        rows.append((i, common if i % 3 == 0 else v.tolist(), int(rng.integers(4))))
    rows[200] = (200, [0.0] * 64, 1)
    rows[300] = (300, (-directions[1]).tolist(), 2)
    return rows


def odd_rows(vectors):
    return vectors[:250] + [
        (None, vectors[1][1], 1), (9001, None, 1), (9002, vectors[1][1], None), (9003, [None] * 64, 1), (9004, [math.nan] * 64, 1),
        (9005, [math.inf] + [0.0] * 63, 2), (9006, [], 1), (9007, [1.0, -2.0], 1), (9100, [0.5] * 70, 3), vectors[100], vectors[101],
        (9008, [1e5] * 64, 2), (9009, [-1e5] * 64, 2), (9200, [1e5] * 64, 1),
    ]


def test_mining_equals_brute_force(spark, vectors):
    got = hard_negatives.mine(frame(spark, vectors))
    assert sorted(map(tuple, got.collect())) == mined(vectors)


def test_mining_of_odd_rows(spark, vectors):
    rows = odd_rows(vectors)
    got = hard_negatives.mine(frame(spark, rows), every=50)
    assert sorted(map(tuple, got.collect())) == mined(rows, every=50)
    assert hard_negatives.mine(frame(spark, [])).collect() == []


def test_pruning_skips_half_of_the_pairs_and_none_that_counts(vectors):
    c = np.array([[math.floor(256 * x) for x in v] for _, v, _ in vectors])
    c = c[np.argsort(-hard_negatives.lengths(c), kind="stable")]
    looked, anchors = 0, c[1::40]
    for start in range(0, len(c), 300):
        part = c[start : start + 300]
        lists = np.argsort(hard_negatives.unit(part), axis=0).astype(np.uint16).T
        bucket = hard_negatives.Bucket({
            "n": len(part), "width": 64, "longest": float(hard_negatives.lengths(part).max()), "ids": np.arange(len(part)).tobytes(),
            "labels": np.zeros(len(part), np.int64).tobytes(), "components": part.astype(np.int64).tobytes(), "lists": np.ascontiguousarray(lists).tobytes(),
        })
        for q in anchors:
            low = int(np.sort(c @ q)[-5])
            at = bucket.candidates(q, float(hard_negatives.lengths(q[None])[0]), low)
            at = np.arange(len(part)) if at is None else at
            assert set(np.flatnonzero(part @ q >= low)) <= set(at)
            looked += len(at)
    assert looked < 0.5 * len(c) * len(anchors)


def test_clusters_equal_brute_force(spark, vectors):
    for rows in (vectors[:700], odd_rows(vectors), vectors[:9]):
        got = bit_planes.cluster_vectors(frame(spark, rows))
        key = lambda r: (r[0] is not None, *map(str, r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(clustered(rows), key=key)
    assert bit_planes.cluster_vectors(frame(spark, [])).collect() == []


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-3, 4, (7, 64))
    assert (bit_planes.unpack(bit_planes.pack(x)) == x).all()
    assert (bit_planes.dots(bit_planes.pack(x), bit_planes.pack(c)) == x @ c.T).all()
    assert (bit_planes.squares(bit_planes.pack(x)) == (x * x).sum(1)).all()
