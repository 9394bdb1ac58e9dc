"""A keyed table of immutable files: a base and later deltas for each range of keys, published by a manifest.

    data/<id>/_range=<n>/...parquet     written once, never changed
    manifests/<version>.json            which files make up a version

A commit writes files first and then renames its manifest into place; until that rename a reader sees the version
before, and so it does after a writer that was killed. A commit writes a delta for the ranges of its own keys;
a range whose deltas have grown past a share of its base is compacted in the same commit, the others are not touched. A reader
merges base and deltas of a range by key; ranges without deltas are read as they are, without a shuffle.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import union_all

RANGE, ORDER = "_range", "_commit"


class Conflict(RuntimeError):
    """Another writer has published the same version."""


@dataclass
class Manifest:
    version: int
    key: list[str]
    seq: str
    keep: str
    ranges: int
    # range number -> [[data id, commit, bytes], ...]; the first is the base if `based` holds the range
    files: dict[int, list[list]] = field(default_factory=dict)
    based: list[int] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def load(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(**d | {"files": {int(k): v for k, v in d["files"].items()}})


class Files:
    """The few calls on the file system that holds a path, whatever system that is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(folder))] if self.fs.exists(self.path(folder)) else []

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(folder)).getLength()

    def publish(self, folder: str, name: str, text: str) -> None:
        """The whole text under a name that nobody has taken, or nothing."""
        part = self.path(f"{folder}/.{name}.{uuid.uuid4().hex}")
        out = self.fs.create(part)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        rename = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(part).toUri(), self.conf)
            context.rename(self.fs.makeQualified(part), self.fs.makeQualified(self.path(f"{folder}/{name}")), rename)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self.fs.exists(self.path(f"{folder}/{name}")):
                raise Conflict(f"{folder}/{name}") from e
            raise


class KeyedTable:
    """Upserts by key; ``keep`` 'last' lets the highest sequence number win, 'first' the lowest; equal numbers go by commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.fs = spark, root.rstrip("/"), Files(spark, root)

    def create(self, key: list[str], seq: str, keep: str = "last", ranges: int = 64) -> KeyedTable:
        self.fs.publish(f"{self.root}/manifests", self._name(0), Manifest(0, key, seq, keep, ranges).dump())
        return self

    @staticmethod
    def _name(version: int) -> str:
        return f"{version:012d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.fs.names(f"{self.root}/manifests") if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.versions()[-1] if version is None else version
        return Manifest.load(self.spark.read.text(f"{self.root}/manifests/{self._name(version)}", wholetext=True).first().value)

    def _pick(self, rows: DataFrame, m: Manifest) -> DataFrame:
        """One row a key."""
        value = F.struct(*[c for c in rows.columns if c not in m.key])
        order = F.struct(m.seq, ORDER)
        best = F.max_by(value, order) if m.keep == "last" else F.min_by(value, order)
        return rows.groupBy(*m.key).agg(best.alias("_v")).select(*m.key, "_v.*")

    def _scan(self, m: Manifest, ranges: list[int], which: slice) -> DataFrame | None:
        by_commit: dict[tuple[str, int], list[str]] = {}
        for n in ranges:
            for data, commit, _ in m.files[n][which]:
                by_commit.setdefault((data, commit), []).append(f"{self.root}/data/{data}/{RANGE}={n}")
        parts = [self.spark.read.option("basePath", f"{self.root}/data/{d}").parquet(*paths).withColumn(ORDER, F.lit(c)) for (d, c), paths in by_commit.items()]
        return union_all(parts) if parts else None

    def _merged(self, m: Manifest, ranges: list[int]) -> DataFrame | None:
        rows = self._scan(m, ranges, slice(None))
        return None if rows is None else self._pick(rows, m)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the last one by default), or None before the first commit."""
        m = self.manifest(version)
        plain = [n for n, f in m.files.items() if len(f) == 1 and n in m.based]
        parts = [self._scan(m, plain, slice(None)), self._merged(m, [n for n in m.files if n not in plain])]
        found = [p.drop(RANGE, ORDER) for p in parts if p is not None]
        return union_all(found) if found else None

    def _store(self, rows: DataFrame, m: Manifest) -> tuple[str, dict[int, int]]:
        """Writes rows of distinct keys by range; its id and the bytes of each range."""
        data = uuid.uuid4().hex
        placed = rows.drop(RANGE, ORDER).withColumn(RANGE, F.pmod(F.xxhash64(*m.key), F.lit(m.ranges)).cast("int"))
        placed.repartition(RANGE).write.partitionBy(RANGE).parquet(f"{self.root}/data/{data}")
        names = [n for n in self.fs.names(f"{self.root}/data/{data}") if n.startswith(f"{RANGE}=")]
        return data, {int(n.split("=")[1]): self.fs.size(f"{self.root}/data/{data}/{n}") for n in names}

    def upsert(self, rows: DataFrame, compact_at: float = 0.5) -> int:
        """Merges rows into the table and returns the version; Conflict if another writer was first, nothing is lost then.

        A range is compacted when its deltas hold more than ``compact_at`` times the bytes of its base.
        """
        m = self.manifest()
        commit = m.version + 1
        data, sizes = self._store(self._pick(rows.withColumn(ORDER, F.lit(commit)), m), m)
        new = Manifest(commit, m.key, m.seq, m.keep, m.ranges, {n: list(f) for n, f in m.files.items()}, list(m.based))
        for n, size in sizes.items():
            if n not in new.files:
                new.based.append(n)
            new.files.setdefault(n, []).append([data, commit, size])
        full = [n for n in sizes if sum(b for *_, b in new.files[n][1:]) > compact_at * new.files[n][0][2]]
        if full:
            base, sizes = self._store(self._merged(new, full), m)
            for n in full:
                new.files[n] = [[base, commit, sizes[n]]]
        self.fs.publish(f"{self.root}/manifests", self._name(commit), new.dump())
        return commit

    def unused(self, keep_versions: int = 1) -> list[str]:
        """Data ids that none of the last versions names: of killed writers and of older versions."""
        used = {f[0] for v in self.versions()[-keep_versions:] for files in self.manifest(v).files.values() for f in files}
        return sorted(set(self.fs.names(f"{self.root}/data")) - used)
