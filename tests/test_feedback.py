"""Feedback arms: counts, shares, different items, drafts without verified items; panels and pairs by position."""

from collections import Counter

from plumbline.operators import feedback as O

COLUMNS = "draft string, item int, kind string, verdict string, citation string, quote string, passage string"


def items(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_arms(spark):
    bad = [("d", i, "citation", "not_found", f"{i} U.S. {i}", None, None) for i in range(400)]
    bad += [("d", 400 + i, "quote", "near_miss", "1 U.S. 1", f"q{i}", "as it stands" if i == 0 else None) for i in range(400)]
    good = [("d", 1000 + i, "citation", "exists", f"9 F.2d {i}", None, None) for i in range(500)]
    good += [("d", 2000 + i, "quote", "accurate", f"8 F.2d {i}", f"right {i}", None) for i in range(500)]
    rows = [tuple(r) for r in O.feedback(items(spark, bad + good), "draft", "item").collect()]
    by = {arm: [r for r in rows if r[2] == arm] for arm in {r[2] for r in rows}}
    assert {a: len(r) for a, r in by.items()} == {"true": 800, "passage": 800, "none": 1, "scrambled": 800, "quarter": 800, "half": 800, "threequarter": 800}
    assert by["none"][0][1] is None and by["none"][0][4] == "__NONE__"
    assert sum("closest passage" in r[4] for r in by["passage"]) == 1
    true = {r[1]: r[4] for r in by["true"]}
    for arm, share in (("scrambled", 0), ("quarter", 0.25), ("half", 0.5), ("threequarter", 0.75)):
        kept = sum(r[3] == "true" for r in by[arm])
        assert abs(kept - 800 * share) <= 4 * (800 * share * (1 - share)) ** 0.5
        assert all((r[4] == true[r[1]]) == (r[3] == "true") for r in by[arm])
        origin = Counter(r[3] for r in by[arm])
        aimed = origin["quote"] + origin["citation"]
        assert abs(origin["quote"] - aimed / 2) <= 4 * (aimed / 4) ** 0.5
        lines = Counter(r[4] for r in by[arm] if r[3] != "true")
        assert max(lines.values()) <= 2  # 800 lines run through 500 items
    assert {r[1] for r in by["half"] if r[3] == "true"} != {r[1] for r in by["threequarter"] if r[3] == "true"}


def test_drafts_without_verified_items(spark):
    rows = [
        ("none ok", 1, "citation", "not_found", "1 U.S. 1", None, None), ("only quotes", 2, "citation", "not_found", "2 U.S. 2", None, None),
        ("only quotes", 3, "quote", "accurate", "3 U.S. 3", "fine", None), ("clean", 4, "citation", "exists", "4 U.S. 4", None, None),
        ("no citation", 5, "quote", "inaccurate", None, "q", None), (None, 6, "citation", "not_found", "6 U.S. 6", None, None),
    ]  # the last has no draft: its lines are true ones
    got = O.feedback(items(spark, rows), "draft", "item").collect()
    assert {r.draft for r in got} == {"none ok", "only quotes", None}
    assert not [r for r in got if r.draft == "none ok" and r.arm == "scrambled"]  # nothing to aim at
    assert [r.origin for r in got if r.draft == "none ok" and r.arm == "half"] == ["true"]
    assert all(r.origin in ("quote", "true") for r in got if r.draft == "only quotes" and r.arm in O.KEEP)
    assert O.feedback(items(spark, []), "draft", "item").collect() == []


def test_panel_carries_the_last_round(spark):
    planned = spark.createDataFrame([(1,), (2,), (3,)], "e int")
    seen = spark.createDataFrame([(1, 0, 5), (1, 2, 7), (2, 0, 1), (2, 1, 0), (2, 9, 4), (4, 0, 8)], "e int, r int, v int")
    got = O.carried_panel(planned, seen, ["e"], "r", "v", 3).groupBy("e").agg({"v": "sum"}).collect()
    assert {r.e: r[1] for r in got} == {1: 5 + 5 + 7 + 7, 2: 1, 3: 0}


def test_pairs_by_position(spark):
    a = spark.createDataFrame([("x", 3, "a"), ("x", 1, "b"), ("y", 1, "c")], "k string, s int, l string")
    b = spark.createDataFrame([("x", 9, "p"), ("z", 1, "q")], "k string, o int, r string")
    pairs = O.zip_by_position(a, b, "k", ["s"], ["o"])
    assert sorted((r.k, r.place, r.l or "", r.r or "", r.alone) for r in pairs.collect()) == [
        ("x", 0, "b", "p", False), ("x", 1, "a", "", True), ("y", 0, "c", "", True), ("z", 0, "", "q", True),
    ]
    assert sorted(tuple(r) for r in O.unequal_lengths(pairs, "k").collect()) == [("x", 2, 1), ("y", 1, 0), ("z", 1, 0)]
