"""Cases that once gave wrong answers."""

from plumbline.operators.containment import contained
from plumbline.operators.resolve import check_pins
from plumbline.sources.readers import torn_csv


def test_null_and_empty_fragments_are_in_no_text(spark):
    frags = spark.createDataFrame([(1, None), (2, ""), (3, "quick brown fox jumps")], "fid int, frag string")
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, None)], "did int, text string")
    for limit in (1 << 20, 0):
        rows = contained(frags, docs, frag_id="fid", frag="frag", doc_id="did", text="text", limit=limit).collect()
        assert [tuple(r) for r in rows] == [(3, 1)]


def test_appendix_spellings_share_a_volume(spark):
    index = spark.createDataFrame([("9", "F. App'x", "10"), ("9", "F. App'x", "40")], "volume string, reporter string, page string")
    claims = spark.createDataFrame([(1, "9", "F. Appx.", "10", 12)], "rid int, volume string, reporter string, page string, pin_page long")
    assert check_pins(claims, index, ["rid"]).first().pin_verdict == "in_range"


def test_torn_rows_survive_many_splits(spark, tmp_path):
    row = lambda k: ",".join(f'"{x}"' for x in [k, "2020-01-01 00:00:00", *(f"f{j}" for j in range(31)), "7"])
    for f in range(6):
        lines = []
        for k in range(200 + 60 * f):
            r = row(f * 10_000 + k)
            cut = r.index('"f9"') + 2
            lines += [r[:cut], r[cut:]] if k % 3 == 0 else [r]
        (tmp_path / f"part{f}.csv").write_text("\n".join(lines) + "\n")
    want = sum(200 + 60 * f for f in range(6))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        assert torn_csv(spark, str(tmp_path)).count() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
