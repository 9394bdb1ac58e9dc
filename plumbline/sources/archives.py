"""Zip archives read by ranges: Spark splits a file at the mark of its members' headers, and a task inflates one member at a time."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.pieces import records

# --- fixed values: the zip format's mark and header of a member ---------------
MARK = "PK\x03\x04"
HEADER = struct.Struct("<HHHHHIIIHH")  # version, flags, method, time, date, crc, packed size, size, length of name, of extra
STORED, DEFLATED = 0, 8
# ----------------------------------------------------------------------------
LONGEST = 1 << 30


def _header(piece: bytes) -> tuple | None:
    """The header's fields if a piece begins with one: the mark may also come up inside packed data."""
    if len(piece) < HEADER.size:
        return None
    h = HEADER.unpack_from(piece)
    version, method, name = h[0] & 0xFF, h[2], piece[HEADER.size : HEADER.size + h[8]]
    plain = len(name) == h[8] > 0 and b"\0" not in name and min(name) >= 0x20
    return h if version <= 63 and method in (STORED, DEFLATED) and plain else None


def _begins(pieces: list[bytes]) -> list[bool]:
    return [_header(p) is not None for p in pieces]


def member(record: bytes) -> tuple[str, bytes | None]:
    """Name and content; None for what cannot be unpacked."""
    h = _header(record)
    name = record[HEADER.size : HEADER.size + h[8]].decode("utf-8", "replace")
    body = memoryview(record)[HEADER.size + h[8] + h[9] :]
    if h[1] & 1:  # encrypted
        return name, None
    if h[2] == STORED:
        return name, bytes(body[: h[6]]) if len(body) >= h[6] else None
    unpack = zlib.decompressobj(-15)
    try:
        content = unpack.decompress(body)
    except zlib.error:
        return name, None
    return name, content if unpack.eof else None


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, record in zip(batch.column("path").to_pylist(), batch.column("data")):
            name, content = member(record.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([content], pa.binary())], ["path", "member", "content"])


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content) of every file in the archives, folders left out; content is null where it cannot be unpacked.

    A member is at most a gigabyte packed. An archive stored unpacked inside another counts as members of the outer one.
    """
    every = records(spark, path, _begins, MARK, LONGEST).mapInArrow(_unpack, "path string, member string, content binary")
    return every.where(~F.col("member").endswith("/"))


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            try:
                record = json.loads((row["content"] or b"").decode("utf-8", "ignore"))
            except ValueError:
                continue  # a broken case is passed over
            text = record.get("text") if isinstance(record, dict) else None
            yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["member"]]), pa.array([None if text is None else str(text)], pa.string())], ["path", "member", "text"])


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, text, html): the JSON cases of volume archives with their sibling pages."""
    every = members(spark, path)
    stem = F.regexp_replace("member", r"\.(json|html)$", "")
    told = every.where(F.col("member").endswith(".json")).mapInArrow(_text, "path string, member string, text string").withColumn("stem", stem)
    pages = every.where(F.col("member").endswith(".html")).select("path", stem.alias("stem"), F.decode("content", "utf-8").alias("html"))
    return told.join(pages, ["path", "stem"], "left").select("path", "member", "text", "html")
