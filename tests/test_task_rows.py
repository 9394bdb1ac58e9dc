"""Tasks hold a bounded number of claims, however few bytes a row takes in a shuffle."""

from pyspark.sql import functions as F

from plumbline.operators import skew
from plumbline.plans import resolution, views
from plumbline.session import Tables


def _rows_of_tasks(df) -> list[int]:
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_are_dealt_by_their_number(spark):
    table = spark.range(40_000).withColumn("k", F.col("id") % 4_000)
    dealt = skew.dealt(table, ["k"], task_rows=1_000)
    assert dealt.rdd.getNumPartitions() == 40
    assert max(_rows_of_tasks(dealt)) < 2_000 and sorted(r.id for r in dealt.collect()) == list(range(40_000))
    assert skew.dealt(table, ["k"], task_rows=10_000) is table  # too few for all cores


def test_a_hot_key_is_left_to_the_join(spark, monkeypatch):
    one = spark.range(40_000).withColumn("k", F.lit(1))
    monkeypatch.setattr(skew, "hot_keys", lambda df, on: df)
    assert skew.dealt(one, ["k"], task_rows=1_000) is one


def test_claims_are_joined_in_small_tasks_with_the_same_rows(spark, folder, monkeypatch):
    t = Tables(spark, folder)
    before = sorted(map(str, views.claims(t).collect()))
    counted = sorted(map(str, resolution.source_cited_elsewhere(t).collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    lines = t.lineitem.count()
    assert views.claims(t)._jdf.queryExecution().optimizedPlan().toString().count(f", {lines // 100}") >= 1
    assert sorted(map(str, views.claims(t).collect())) == before
    assert sorted(map(str, resolution.source_cited_elsewhere(t).collect())) == counted
