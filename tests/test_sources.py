"""Readers, writers, streams and packets on small files."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import packets as K
from plumbline.operators import sampling as M
from plumbline.operators import state as S
from plumbline.sources import readers, sinks
from plumbline.streaming import eventlog


def test_json_lines_drop_torn_rows(spark, tmp_path):
    lines = [json.dumps({"ts": 1.5, "step": "a", "type": "done", "extra": 1}), "{not json", json.dumps({"step": "b"}), '{"ts": 2.0, "step": "c", "ty']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    got = sorted(r.step for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), readers.EVENT_SCHEMA).collect())
    assert got == ["a", "b"]


def test_missing_source_is_empty(spark, tmp_path):
    df = readers.read_or_empty(spark, str(tmp_path / "none"), "a string", spark.read.text)
    assert df.count() == 0 and df.columns == ["a"]


def test_drafts_and_revisions_from_paths(spark, tmp_path):
    folder = tmp_path / "full_x" / "drafts"
    folder.mkdir(parents=True)
    (folder / "1997-033_quota.txt").write_text("line one\nline two")
    for n in (2, 9, 10):
        (folder / f"1997-033_true_r{n}.txt").write_text(f"round {n}")
    d = readers.drafts(spark, f"{tmp_path}/*/drafts/*.txt").collect()
    assert [(r.model, r.matter, r.condition, r.text) for r in d] == [("full_x", "1997-033", "quota", "line one\nline two")]
    from plumbline.operators.episodes import last_revision

    last = last_revision(readers.revisions(spark, f"{tmp_path}/*/drafts/*.txt"), ["matter", "arm"], "round", "text").first()
    assert (last.last_round, last.final, last.r0) == (10, "round 10", "round 2")


def test_keyed_tree_and_labels(spark, tmp_path):
    (tmp_path / "620_F3d_392.txt").write_text("federal")
    (tmp_path / "410_113.txt").write_text("supreme")
    got = sorted((r.volume, r.reporter_norm, r.page) for r in readers.keyed_tree(spark, f"{tmp_path}/*.txt").collect())
    assert got == [("410", "US", "113"), ("620", "F3D", "392")]
    case = tmp_path / "case1"
    case.mkdir()
    (case / "label.json").write_text(json.dumps({"citation": "Roe, 410 U.S. 113"}))
    (case / "text.txt").write_text("opinion")
    r = readers.labelled_texts(spark, f"{tmp_path}/case*/label.json", f"{tmp_path}/case*/text.txt").first()
    assert (r.volume, r.page, r.text) == ("410", "113", "opinion")


def test_delimited_text(spark, tmp_path):
    (tmp_path / "mega.txt").write_text("head\n--- [ Roe v. Wade ]" + "x" * 300 + "\n--- short\n--- no bracket " + "y" * 300)
    got = sorted(r.caption for r in readers.delimited(spark, str(tmp_path / "mega.txt")).collect())
    assert got[0] == "Roe v. Wade" and got[1].startswith("no bracket") and len(got) == 2


def test_torn_csv(spark, tmp_path):
    def row(i, name, docket="7"):
        cells = [str(i), "2020-01-01 00:00:00", "", "", "1999-05-05", *[""] * 3, name, "", f"s{i}", *[""] * 22, docket]
        return ",".join(f'"{c}"' for c in cells)

    torn = row(2, "Broken").replace('"Broken"', '"Bro\nken ""v"" x"')
    (tmp_path / "c.csv").write_text("\n".join(["id,header", row(1, "A v. B"), torn, row(3, "C").replace('"s3"', '"s3'), row(4, "D v. E")]))
    got = {r.id: r.case_name for r in readers.torn_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got[1] == "A v. B" and got[4] == "D v. E" and set(got) >= {1, 4}


def test_compressed_csv_and_clean_excerpts(spark, tmp_path):
    import bz2

    (tmp_path / "x.csv.bz2").write_bytes(bz2.compress(b"a,b,c\n1,2,3\n"))
    assert readers.csv_columns(spark, str(tmp_path / "x.csv.bz2"), ["c", "a"]).first().asDict() == {"c": "3", "a": "1"}
    rows = spark.createDataFrame([("a.pdf", {}), ("b.pdf", {"x": "1"}), ("c.txt", {}), ("d.pdf", None)], "filename string, list_hallucinations map<string,string>")
    assert sorted(r.filename for r in readers.clean_excerpts(rows).collect()) == ["a.pdf", "d.pdf"]


@pytest.mark.parametrize("keep,expect", [("last", {"a": "new", "b": "old", "c": "new"}), ("first", {"a": "old", "b": "old", "c": "new"})])
def test_upsert(spark, tmp_path, keep, expect):
    make = lambda rows: spark.createDataFrame(rows, "k string, seq int, v string")
    one = sinks.upsert(spark, "", f"{tmp_path}/1", make([("a", 1, "old"), ("b", 1, "old")]), ["k"], "seq", keep)
    two = sinks.upsert(spark, one, f"{tmp_path}/2", make([("a", 2, "new"), ("c", 2, "new")]), ["k"], "seq", keep)
    assert {r.k: r.v for r in spark.read.parquet(two).collect()} == expect
    lines = sinks.markdown_rows(spark.read.parquet(two), ["k", "v"]).collect()
    assert f"| a | {expect['a']} |" in {r.line for r in lines}


def test_stream_ingests_each_step_once_and_resumes(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    def step(s, n):
        return json.dumps({"ts": float(n), "step": s, "type": "done", "data": "{}"})

    (log / "1.jsonl").write_text("\n".join([step("a", 1), step("b", 2), step("a", 3), '{"torn']))
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"

    def go():
        stream = eventlog.tolerant_json(spark, str(log), readers.EVENT_SCHEMA)
        eventlog.ingest(eventlog.once_per_step(stream, "step"), out, ck).awaitTermination()
        return sorted(r.step for r in spark.read.parquet(out).collect())

    assert go() == ["a", "b"]
    (log / "2.jsonl").write_text("\n".join([step("b", 4), step("c", 5)]))
    assert go() == ["a", "b", "c"]
    assert go() == ["a", "b", "c"]


def test_budget_refuses_calls_after_the_crossing(spark):
    m = spark.createDataFrame([(1, 4), (2, 4), (3, 4), (4, 1)], "t int, cost int")
    got = {r.t: (r.spent, r.refused) for r in S.spend(m, "cost", ["t"], 8).collect()}
    assert got == {1: (4, False), 2: (8, False), 3: (12, True), 4: (13, True)}


def test_packet(spark):
    facts = [f"Fact {i} " + "word " * 30 for i in range(5)]
    texts = [
        "\n".join(["OPINION", *facts, "We affirm the judgment. Kept sentence here.", "DISCUSSION now", "more"]),
        "\n".join(["OPINION", facts[0], "DISCUSSION now", "more", "more"]),
        "\n".join([*facts[:3], "The court below affirmed it all", facts[3], "We review the rest"]),
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.p for r in rows.select("i", K.packet("t", 50, 110).alias("p")).orderBy("i").collect()]
    assert got[0] == "\n".join(f.strip() for f in facts[:3])  # whole paragraphs up to the budget
    assert got[1] is None and got[2] is None
    whole = rows.filter("i = 0").select(K.packet("t", 50, 900).alias("p")).first().p
    assert whole.endswith("Kept sentence here.") and "affirm" not in whole


def test_quota_selection_equals_the_plain_fold(spark):
    rows = [(i, f"g{i * 7 % 5}", (i * 13 % 10) < 6, f"{i * 7919 % 1000:04d}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, us boolean, o string")
    got = {r.id for r in K.quota_selection(df, "g", "us", "o", 16, 4).collect()}
    per, us, expect = {}, 0, set()
    for i, g, flag, _ in sorted(rows, key=lambda r: r[3]):
        if len(expect) == 16 or per.get(g, 0) >= 4 or (flag and us >= 4):
            continue
        us, per[g] = us + flag, per.get(g, 0) + 1
        expect.add(i)
    assert got == expect


def test_strided_sample(spark):
    got = [r.i for r in M.strided(spark.range(103).withColumnRenamed("id", "i"), ["i"], 10).orderBy("i").collect()]
    assert got == list(range(0, 100, 10))


def test_claims_against_texts(spark):
    claims = spark.createDataFrame([("a", r"\b94\.5%"), ("b", r"\b12 of 40\b"), ("c", "x")], "k string, pattern string")
    texts = spark.createDataFrame([("a", "traced in 94.5% of cases"), ("b", "112 of 40")], "k string, text string")
    assert {r.k: r.holds for r in sinks.check_claims(claims, texts, "k").collect()} == {"a": True, "b": False, "c": False}


def test_json_table_and_log_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "n int, s string")
    for _ in range(2):
        sinks.append_log(rows, f"{tmp_path}/log")
        sinks.json_table(rows, f"{tmp_path}/table")
        sinks.csv_table(rows, f"{tmp_path}/csv")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    assert spark.read.json(f"{tmp_path}/table").count() == 1
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().s == "a"
