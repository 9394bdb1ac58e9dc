"""Event logs, keyed notes, caches and budgets on the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import state as O
from plumbline.plans.registry import query
from plumbline.session import Tables, shared_dir
from plumbline.sources.keyed_table import KeyedTable
from plumbline.streaming import eventlog, notes

_STEP = "concat(CAST(user_id AS STRING), ':', event_type)"


@query("Z1 Z2 A5", f"SELECT {_STEP} AS step, min(event_id) AS first_event_id, count(*) AS records FROM events GROUP BY 1")
def completed_steps(t: Tables) -> DataFrame:
    return O.completed(t.events.selectExpr(f"{_STEP} AS step", "event_id"), "step", ["event_id"])


@query("Z3 U6", f"""
WITH planned AS (SELECT DISTINCT concat(CAST(c_custkey AS VARCHAR), ':', e) AS step FROM customer, (SELECT unnest(['click','view','signup','error','purchase']) AS e))
SELECT step FROM planned WHERE step NOT IN (SELECT {_STEP} FROM events)""")
def pending_steps(t: Tables) -> DataFrame:
    kinds = F.explode(F.array(*[F.lit(x) for x in ("click", "view", "signup", "error", "purchase")]))
    planned = t.customer.select("c_custkey", kinds.alias("e")).select(F.concat_ws(":", F.col("c_custkey").cast("string"), "e").alias("step"))
    return O.pending(planned.distinct(), t.events.selectExpr(f"{_STEP} AS step"), "step")


_LIVE = """
WITH ops AS (SELECT user_id * 10 + event_id % 7 AS id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'retire' ELSE 'add' END AS op, value FROM events)
SELECT id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ops) WHERE rn = 1 AND op = 'add'"""
_OPS = ["user_id * 10 + event_id % 7 AS id", "event_id AS seq", "CASE WHEN event_type = 'error' THEN 'retire' ELSE 'add' END AS op", "value"]


@query("Z5 K2", _LIVE)
def live_notes(t: Tables) -> DataFrame:
    return O.live_notes(t.events.selectExpr(*_OPS), "id", "seq", "op", ["value"])


@query("Z5 Z1", _LIVE)
def streamed_notes(t: Tables) -> DataFrame:
    """The same notes, folded from a stream into keyed state and read back from it."""
    base = f"{shared_dir(t.spark)}/notes-{uuid.uuid4().hex}"
    ops = eventlog.parquet_stream(t.spark, t.folder, "events.parquet").selectExpr(*_OPS)
    notes.fold(ops, f"{base}/changes", f"{base}/checkpoint", "id", "seq").awaitTermination()
    return notes.live(notes.kept_notes(t.spark, f"{base}/checkpoint", "id"), "op").select("id", "seq", "value")


@query("Z7", """
WITH r AS (SELECT event_id, sha256(concat('{"event_type":"', event_type, '","user_id":', CAST(user_id AS VARCHAR), '}')) AS key FROM events)
, c AS (SELECT DISTINCT sha256(concat('{"event_type":"', event_type, '","user_id":', CAST(user_id AS VARCHAR), '}')) AS key FROM events WHERE value > 60)
SELECT r.key, count(*) AS requests, count(c.key) AS hits FROM r LEFT JOIN c ON c.key = r.key GROUP BY 1""")
def request_cache(t: Tables) -> DataFrame:
    asked = t.events.select("event_id", "value", O.request_key("user_id", "event_type").alias("key"))
    cache = asked.filter("value > 60").groupBy("key").agg(F.max("value").alias("cached"))
    j = O.with_cached(asked.select("event_id", "key"), cache, "key", "cached")
    return j.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"))


@query("Z8 A29", """
WITH m AS (SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
, s AS (SELECT event_id, cents, CAST(sum(cents) OVER (ORDER BY ts, event_id) AS BIGINT) AS spent FROM m)
SELECT event_id, spent, spent - cents >= 5000000 AS refused FROM s""")
def budget_stop(t: Tables) -> DataFrame:
    m = t.events.select("event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return O.spend(m, "cents", ["ts", "event_id"], 5000000).select("event_id", "spent", "refused")


@query("A29", """
SELECT event_type, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(ts) AS last_call FROM events GROUP BY 1""")
def metered_cost(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max("ts").alias("last_call")
    )


@query("Z1 Z4 K7", f"SELECT {_STEP} AS step, count(DISTINCT 1) AS kept FROM events GROUP BY 1")
def streamed_steps(t: Tables) -> DataFrame:
    """The same done-set, built by a stream that keeps each step once."""
    base = f"{shared_dir(t.spark)}/steps-{uuid.uuid4().hex}"
    stream = eventlog.parquet_stream(t.spark, t.folder, "events.parquet").selectExpr(f"{_STEP} AS step", "event_id")
    eventlog.ingest(eventlog.once_per_step(stream, "step"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("step").agg(F.count(F.lit(1)).alias("kept"))


def _written(t: Tables, keep: str) -> DataFrame:
    """The events, upserted by (user, kind) in three batches and read back."""
    table = KeyedTable(t.spark, f"{shared_dir(t.spark)}/table-{uuid.uuid4().hex}").create(["user_id", "event_type"], "event_id", keep, ranges=8)
    for batch in (2, 0, 1):
        table.upsert(t.events.where(F.col("event_id") % 3 == batch).select("user_id", "event_type", "event_id", "value"))
    return table.read()


@query("K1 K2 K6", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def upserted_events(t: Tables) -> DataFrame:
    return _written(t, "last")


@query("K1 K3 K6", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def inserted_events(t: Tables) -> DataFrame:
    return _written(t, "first")
