"""Set-overlap join against brute force, with a hot token and its sub-lists."""

import random

import pytest

from plumbline.operators.overlap import overlap_pairs


def rows(spark, sets, name):
    return spark.createDataFrame([(k, m, w) for k, m, w in sets], f"{name} int, matter int, w array<string>")


@pytest.mark.parametrize("least,on", [(1, ["matter"]), (2, []), (3, [])])
def test_pairs_equal_brute_force(spark, least, on):
    r = random.Random(3)
    vocabulary = ["hot"] * 12 + [f"t{i}" for i in range(25)]
    make = lambda n: [(i, i % 3, [r.choice(vocabulary) for _ in range(r.randint(0, 6))]) for i in range(n)]
    left, right = make(60), make(80)
    left += [(60, 1, None), (61, None, ["t1", "t2", "t3"]), (62, 1, [None, "t1"])]
    got = overlap_pairs(rows(spark, left, "a"), rows(spark, right, "b"), "a", "b", "w", on=on, least=least, group_rows=7)
    pairs = sorted((x.a, x.b, len(x.shared)) for x in got.collect())
    share = lambda x, y: len({*(x or [])} & {*(y or [])} - {None})
    expected = sorted((i, j, share(x, y)) for i, m, x in left for j, n, y in right if share(x, y) >= least and (not on or m == n))
    assert pairs == expected
    one = got.where("size(shared) > 1").first()
    counts = {w: sum(w in (y or []) for _, _, y in right) for w in one.shared}
    assert on or list(one.shared) == sorted(one.shared, key=lambda w: (counts[w], w))


def test_empty_sides(spark):
    none = rows(spark, [], "a")
    assert overlap_pairs(none, rows(spark, [(1, 1, ["x"])], "b"), "a", "b", "w").collect() == []


def test_tokens_that_the_other_side_lacks_are_left_out(spark):
    from plumbline.operators.overlap import asked_for

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, token string")
    b = spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (2, 12, "y"), (2, 13, "z"), (3, 14, "x")], "k int, _r int, token string")
    assert sorted((r.k, r._r, r.token) for r in asked_for(b, a, ["k"]).collect()) == [(1, 10, "x"), (2, 12, "y")]
    assert sorted(r._r for r in asked_for(b.drop("k"), a.drop("k"), []).collect()) == [10, 11, 12, 14]
