"""Notes in the state store: restarts, batches run again, late and repeated operations."""

import json
import os

import pytest

from plumbline.sources import readers
from plumbline.streaming import eventlog, notes


@pytest.fixture
def notebook(spark, tmp_path):
    (tmp_path / "log").mkdir()

    class Notebook:
        checkpoint = f"{tmp_path}/checkpoint"

        def add(self, name, *operations):
            lines = [json.dumps({"id": i, "op": op, "seq": seq, "text": text}) for i, op, seq, text in operations]
            (tmp_path / "log" / name).write_text("\n".join([*lines, '{"id": "torn']))

        def run(self):
            stream = eventlog.tolerant_json(spark, f"{tmp_path}/log", readers.NOTE_SCHEMA).select("id", "op", "seq", "text")
            notes.fold(stream, f"{tmp_path}/changes", self.checkpoint, "id", "seq").awaitTermination()
            kept = notes.kept_notes(spark, self.checkpoint, "id")
            return {r.id: (r.seq, r.text) for r in notes.live(kept, "op").collect()}

        def changes(self):
            return sorted((r.batch, r["_key"], r.seq) for r in spark.read.parquet(f"{tmp_path}/changes").collect())

    return Notebook()


def test_restart_goes_on_from_the_state(notebook):
    notebook.add("1", ("x", "add", 1, "one"), ("y", "add", 2, "two"), (None, "add", 3, "no key"))
    assert notebook.run() == {"x": (1, "one"), "y": (2, "two")}
    notebook.add("2", ("x", "retire", 3, None))
    assert notebook.run() == {"y": (2, "two")}
    notebook.add("3", ("x", "add", 4, "again"), ("y", "add", 1, "late"), ("y", "add", None, "unnumbered"))
    assert notebook.run() == {"x": (4, "again"), "y": (2, "two")}
    assert notebook.run() == {"x": (4, "again"), "y": (2, "two")}
    assert notebook.changes() == [(0, "x", 1), (0, "y", 2), (1, "x", 3), (2, "x", 4)]  # a batch rewrites what it changes


def test_a_batch_that_runs_again_changes_nothing(notebook):
    notebook.add("1", ("x", "add", 1, "one"))
    notebook.run()
    notebook.add("2", ("x", "add", 2, "two"), ("z", "add", 3, "three"))
    once, changes = notebook.run(), notebook.changes()
    for name in ("1", ".1.crc"):  # as if the driver had been lost before it noted the batch's end
        os.remove(os.path.join(notebook.checkpoint, "commits", name))
    assert notebook.run() == once
    assert notebook.changes() == changes


def test_the_session_keeps_its_state_store(spark, notebook):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    notebook.add("1", ("x", "add", 1, "one"))
    notebook.run()
    assert spark.conf.get(name, None) == before
