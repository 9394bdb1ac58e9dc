"""Hot keys and range buckets change the plan, never the result."""

from pyspark.sql import functions as F

from plumbline.operators import inference as I
from plumbline.operators import resolve as P
from plumbline.operators import skew as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_join_equals_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("row"))
    left = left.unionByName(left.filter("row < 5"))  # repeated rows stay repeated
    right = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        salted = S.salted_join(left, right, ["k"], ["row"], how, hot_rows=500, salts=7, look_at=1.0)
        assert rows(salted.select("k", "row", "v")) == rows(left.join(right, "k", how).select("k", "row", "v"))


def test_running_total_over_buckets(spark):
    df = spark.range(2000).select((F.col("id") * 37 % 500).alias("o"), F.col("id").alias("tie"), (F.col("id") % 5).alias("v"), (F.col("id") % 3).alias("g"))
    got = {r.tie: r.t for r in S.running_total(df, "v", ["o", "tie"], "t", rows_per_bucket=90).collect()}
    total, expect = 0, {}
    for r in sorted(df.collect(), key=lambda r: (r.o, r.tie)):
        total += r.v
        expect[r.tie] = total
    assert got == expect
    per = S.number_rows(df, ["o", "tie"], "i", ("g",), rows_per_bucket=90)
    assert per.groupBy("g").agg(F.max("i"), F.countDistinct("i"), F.count("*")).filter("max(i) <> count(DISTINCT i) OR max(i) <> `count(1)`").count() == 0


def test_null_ordering_keys_come_first(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else i, i, 1) for i in range(400)], "o long, tie long, v long")
    got = {r.tie: r.i for r in S.number_rows(df, ["o", "tie"], "i", rows_per_bucket=50).collect()}
    expect = sorted(range(400), key=lambda i: (i % 10 != 0, i))
    assert got == {tie: n for n, tie in enumerate(expect, 1)}


def test_next_starts_across_page_ranges(spark):
    starts = [1, 2, 999, 1000, 5200, 5201, 9000]
    index = spark.createDataFrame([("1", "U.S.", str(p), p) for p in starts] + [("1", "U. S.", "2", 77), ("1", "U.S.", "iv", 5)], "volume string, reporter string, page string, cluster_id long")
    got = {r.start: r.next_start for r in P.next_starts(index).collect()}
    assert got == dict(zip(starts, [*starts[1:], None]))


def test_pin_verdicts(spark):
    index = spark.createDataFrame([("1", "U.S.", "100", 1), ("1", "U.S.", "150", 2)], "volume string, reporter string, page string, cluster_id long")
    asked = [("a", "100", 120, "in_range"), ("b", "100", 150, "out_of_range"), ("c", "100", 90, "out_of_range"), ("d", "150", 549, "in_range_unbounded"),
             ("e", "150", 550, "out_of_range"), ("f", "101", 120, "case_unknown"), ("g", "iv", 3, "unparsable"), ("h", "100", None, "no_pin")]
    claims = spark.createDataFrame([(i, "1", "U.S.", p, pin) for i, p, pin, _ in asked], "id string, volume string, reporter string, page string, pin_page long")
    got = {r.id: r.pin_verdict for r in P.check_pins(claims, index, ["id"]).collect()}
    assert got == {i: v for i, _, _, v in asked}


def test_lookup_takes_the_lowest_cluster_and_coverage_decides(spark):
    index = spark.createDataFrame([("1", "U. S.", "5", 9), ("1", "U.S.", "5", 4), ("2", "F. App'x", "7", 6)], "volume string, reporter string, page string, cluster_id long")
    clusters = spark.createDataFrame([(4, "A v. B", "1960-01-01"), (6, "C v. D", None)], "cluster_id long, case_name string, date_filed string")
    claims = spark.createDataFrame(
        [(1, "1", "U.S.", "5"), (2, "1", "U.S.", "6"), (3, "2", "Fed. Appx.", "7"), (4, "3", "M.S.P.B.", "1"), (5, "2019", "WL", "123"), (6, None, "U.S.", "5")],
        "id int, volume string, reporter string, page string",
    )
    got = {r.id: (r.verdict, r.cluster_id) for r in P.resolve(claims, index, clusters, ["id"]).collect()}
    assert got == {1: ("exists", 4), 2: ("not_found", None), 3: ("exists", 6), 4: ("unresolvable", None), 5: ("unresolvable", None), 6: ("unresolvable", None)}


def test_index_percentile(spark):
    v = spark.createDataFrame([("a", float(x)) for x in range(40)], "g string, v double")
    assert I.index_percentile(v, ["g"], "v", 0.025, "lo").first().lo == 1.0
