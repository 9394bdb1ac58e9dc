"""Keyed notes as state: each key's latest operation lives in the state store, and a batch touches its own keys only."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from plumbline.streaming.eventlog import STATE_STORE

STATE = "note"


class LatestOperation(StatefulProcessor):
    """Keeps, for a key, the operation of the highest sequence number; sends it on when it changes.

    An operation that is not newer than the one kept changes nothing, so that a batch that is run
    again after a failure, and events that arrive late, leave the state as it is.
    """

    def __init__(self, schema: StructType, seq: str):
        self.fields, self.seq, self.schema = schema.names, seq, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.note = handle.getValueState(STATE, self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max((r for r in rows if r[self.seq] is not None), key=lambda r: r[self.seq], default=None)
        if last is None:
            return
        kept = self.note.get() if self.note.exists() else None
        if kept is not None and kept[self.fields.index(self.seq)] >= last[self.seq]:
            return
        self.note.update(tuple(last[f] for f in self.fields))
        yield Row(**{"_key": key[0]}, **{f: last[f] for f in self.fields})

    def close(self) -> None:
        pass


@contextmanager
def rocks_db(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fold(stream: DataFrame, changes: str, checkpoint: str, key: str, seq: str) -> StreamingQuery:
    """Fold a stream of operations into keyed state; changed notes are appended to the table ``changes``.

    Runs over all that is there now, then stops; started again with the same checkpoint it goes on where it was.
    """
    spark = stream.sparkSession
    schema = StructType([f for f in stream.schema if f.name != key])
    out = StructType().add("_key", stream.schema[key].dataType)
    for f in schema:
        out = out.add(f)
    changed = stream.where(F.col(key).isNotNull()).groupBy(key).transformWithState(
        statefulProcessor=LatestOperation(schema, seq),
        outputStructType=out, outputMode="update", timeMode="none",
    )

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{changes}/batch={epoch}")  # a batch that is run again replaces its own file

    with rocks_db(spark):
        return changed.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_notes(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """The state after the last batch: one row a key."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.select(F.col(f"key.{key}").alias(key), "value.*")


def live(notes: DataFrame, op: str) -> DataFrame:
    return notes.where(F.col(op) == "add").drop(op)
