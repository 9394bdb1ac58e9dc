"""Versions, merge on read, compaction, killed and competing writers of keyed tables."""

import pytest

from plumbline.sources.keyed_table import Conflict, KeyedTable


def rows(spark, *r):
    return spark.createDataFrame(r, "k string, seq int, v string")


def values(df):
    return {} if df is None else {r.k: r.v for r in df.collect()}


@pytest.mark.parametrize("keep,expected", [("last", {"a": "new", "b": "old", "c": "new"}), ("first", {"a": "old", "b": "old", "c": "new"})])
def test_upserts_and_versions(spark, tmp_path, keep, expected):
    table = KeyedTable(spark, str(tmp_path)).create(["k"], "seq", keep, ranges=4)
    assert table.read() is None
    one = table.upsert(rows(spark, ("a", 1, "old"), ("b", 1, "old"), ("b", 0 if keep == "last" else 5, "never")))
    two = table.upsert(rows(spark, ("a", 2, "new"), ("c", 2, "new")), compact_at=100)
    assert (one, two) == (1, 2)
    assert values(table.read()) == expected
    assert values(table.read(1)) == {"a": "old", "b": "old"}  # a version stays as it is
    assert table.read().columns == ["k", "seq", "v"]


def test_equal_numbers_and_null_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path)).create(["k"], "seq", "last", ranges=2)
    table.upsert(rows(spark, ("a", 1, "one"), (None, 1, "null")))
    table.upsert(rows(spark, ("a", 1, "two"), (None, 2, "later")))
    assert values(table.read()) == {"a": "two", None: "later"}


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path)).create(["k"], "seq", ranges=4)
    table.upsert(rows(spark, ("a", 1, "old")))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(table.fs, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(rows(spark, ("a", 2, "half")))
    assert values(KeyedTable(spark, str(tmp_path)).read()) == {"a": "old"}
    assert table.unused()  # what it left behind can be told
    assert table.upsert(rows(spark, ("a", 3, "new"))) == 2
    assert values(table.read()) == {"a": "new"}


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = KeyedTable(spark, str(tmp_path)).create(["k"], "seq", ranges=4), KeyedTable(spark, str(tmp_path))
    old = b.manifest()
    a.upsert(rows(spark, ("a", 1, "first")))
    b.manifest = lambda version=None: old
    with pytest.raises(Conflict):
        b.upsert(rows(spark, ("b", 1, "second")))
    assert values(a.read()) == {"a": "first"}


def test_only_touched_ranges_are_rewritten(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path)).create(["k"], "seq", ranges=16)
    table.upsert(spark.range(2000).selectExpr("cast(id as string) k", "1 seq", "repeat('x', 50) v"))
    before = table.manifest().files
    table.upsert(rows(spark, ("7", 2, "new")))
    after = table.manifest().files
    touched = [n for n in after if after[n] != before[n]]
    assert len(touched) == 1 and after[touched[0]][0] == before[touched[0]][0]  # a delta beside the same base
    plan = table.read()._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    for seq in range(3, 9):
        table.upsert(spark.range(2000).where(f"id % 16 = {seq}").selectExpr("cast(id as string) k", f"{seq} seq", f"repeat('y', {seq}) v"))
    assert min(len(f) for f in table.manifest().files.values()) == 1  # some range was compacted
    got = values(table.read())
    assert len(got) == 2000 and got["7"] == "y" * 7 and got["3"] == "yyy" and got["2"] == "x" * 50
