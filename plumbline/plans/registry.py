"""The query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import Tables


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def query(ids: str, oracle: str | None = None):
    """Register a query under its function name with the inventory ids it covers."""

    def add(fn: Callable[[Tables], DataFrame]):
        assert fn.__name__ not in ENTRIES, fn.__name__
        ENTRIES[fn.__name__] = Entry(fn.__name__, tuple(ids.split()), fn, oracle)
        return fn

    return add


def _runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.build(Tables(spark, sf_dir))

    run.__name__ = entry.name
    return run


def load() -> dict[str, Entry]:
    from plumbline.plans import (  # noqa: F401
        cells, claims, episodes, feedback, files, inference, overlaps, pages, reporters, resolution, search, state, texts,
    )

    return ENTRIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(e) for name, e in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.oracle for name, e in load().items() if e.oracle}
