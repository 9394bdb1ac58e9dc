"""Tables written to the shared folder in the forms of the readers, and read back through them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans import views as V
from plumbline.plans.registry import query
from plumbline.session import Tables, shared_dir
from plumbline.sources import readers, sinks


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("S5 S6", f"WITH {V.RECORDS} SELECT model, kind, verdict, count(*) AS n, count(DISTINCT matter) AS matters FROM records GROUP BY 1, 2, 3")
def reread_records(t: Tables) -> DataFrame:
    """Records as JSON lines with torn lines and unknown keys among them."""
    r = V.records(t).select("rid", "model", F.col("matter").cast("string").alias("matter"), "condition", "kind", "verdict", "reporter", F.lit(1).alias("unknown"))
    line = F.to_json(F.struct(*[c for c in r.columns if c != "rid"]))
    torn = F.when(F.col("rid") % 17 == 0, F.array(line, F.left(line, F.length(line) - 5), F.lit("{not json"))).otherwise(F.array(line))
    path = _folder(t, "records")
    r.select(F.explode(torn).alias("value")).write.text(path)
    back = readers.json_lines(t.spark, path, readers.RECORD_SCHEMA)
    return back.groupBy("model", "kind", "verdict").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("matter").alias("matters"))


@query("S1", """SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, count(DISTINCT props) AS props, min(props) AS first_props FROM events GROUP BY 1""")
def reread_events(t: Tables) -> DataFrame:
    """Events as compressed CSV with a header, three of its columns read back."""
    path = _folder(t, "events")
    t.events.write.option("header", True).option("compression", "bzip2").csv(path)
    back = readers.csv_columns(t.spark, path, ["event_type", "user_id", "props"])
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("user_id").cast("long")).alias("users"), F.countDistinct("props").alias("props"), F.min("props").alias("first_props"))


@query("K4", "SELECT n_regionkey, count(*) AS nations, min(n_name) AS first_name FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def reread_json_table(t: Tables) -> DataFrame:
    """A table of JSON objects as the sink writes it."""
    path = _folder(t, "table")
    joined = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_name")
    sinks.json_table(joined, path)
    back = t.spark.read.schema("n_regionkey int, n_name string").json(path)
    return back.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"), F.min("n_name").alias("first_name"))
