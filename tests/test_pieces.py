"""Split-aware records and archives: any size of split gives the same rows."""

import json
import random
import zipfile
from contextlib import contextmanager

import pytest

from plumbline.sources import archives
from plumbline.sources.pieces import records


@contextmanager
def splits(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "64", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


begins = lambda lines: [line.startswith(b"#") for line in lines]  # noqa: E731  workers do not know this module

@pytest.mark.parametrize("size", [17, 64, 300, 1 << 20])
def test_records_do_not_depend_on_splits(spark, tmp_path, size):
    r = random.Random(4)
    expected = []
    for f in range(3):
        lines = ["head", "of the file"] if f else []
        for k in range(25):
            body = [f"#{f}.{k}"] + ["é" * r.randint(0, 30) for _ in range(r.choice([0, 1, 2, 12]))]
            lines += body
            expected.append("\n".join(body))
        (tmp_path / f"{f}.txt").write_text("\n".join(lines) + "\n")
    with splits(spark, size):
        got = records(spark, str(tmp_path), begins)
        assert sorted(bytes(x.data).decode() for x in got.collect()) == sorted(expected)


def test_only_the_ends_of_splits_are_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"#{k}\nmore\n" for k in range(3000)))
    with splits(spark, 4096):
        got = records(spark, str(tmp_path), begins)
        parts = got.rdd.getNumPartitions()
        assert parts > 4
        cut = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in x]
        assert len(cut) == 2 and got.count() == 3000


def test_a_stretch_without_a_beginning_is_cut(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#1\n" + "x" * 50_000 + "\n" + ("y" * 99 + "\n") * 500 + "#2\nshort\n")
    for size in (2000, 1 << 20):
        with splits(spark, size):
            got = sorted(bytes(x.data) for x in records(spark, str(tmp_path), begins, longest=1000).collect())
        assert [len(x) for x in got] == [1000, 8] and got[1] == b"#2\nshort"


def test_no_files_lines_or_beginnings(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "none.txt").write_text("a\nb\n")
    assert records(spark, str(tmp_path), begins).collect() == []


def test_archive_is_read_by_many_tasks(spark, tmp_path):
    r = random.Random(1)
    content = {}
    for k in range(10_000):
        content[f"json/{k:05d}.json"] = bytes(r.randrange(256) for _ in range(r.randint(0, 60)))
    content["false.bin"] = b"PK\x03\x04" + b"\xff" * 40 + b"PK\x03\x04"  # marks in packed data begin no member
    for name, kind in (("packed", zipfile.ZIP_DEFLATED), ("stored", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", kind) as z:
            z.mkdir("json")
            for k, v in content.items():
                z.writestr(k, v)
    for size in (100_000, 1 << 24):
        with splits(spark, size):
            got = archives.members(spark, f"{tmp_path}/*.zip")
            rows = got.collect()
            tasks = got.rdd.getNumPartitions()
        assert size > 1 << 20 or tasks > 10
        for name in ("packed", "stored"):
            assert {x.member: bytes(x.content) for x in rows if name in x.path} == content


def test_cases_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "1.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("cases/0001.json", json.dumps({"text": "opinion"}))
        z.writestr("cases/0001.html", "<p>opinion</p>")
        z.writestr("cases/0002.json", json.dumps({"text": None}))
        z.writestr("cases/0003.json", "{broken")
        z.writestr("cases/0004.json", "[1]")
    got = sorted((r.member, r.text, r.html) for r in archives.cases(spark, f"{tmp_path}/*.zip").collect())
    assert got == [("cases/0001.json", "opinion", "<p>opinion</p>"), ("cases/0002.json", None, None), ("cases/0004.json", None, None)]


def test_a_torn_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(3):
            z.writestr(f"{k}.txt", random.Random(k).randbytes(500))
    whole = (tmp_path / "w.zip").read_bytes()
    (tmp_path / "t.zip").write_bytes(whole[:1200])  # the third member is cut
    got = {r.member: r.content for r in archives.members(spark, str(tmp_path / "t.zip")).collect()}
    assert [got[f"{k}.txt"] is None for k in range(3)] == [False, False, True]
