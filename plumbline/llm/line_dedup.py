"""Line dedup: lines that many sites share are removed but for their first place.

Every line has a HyperLogLog sketch of the sites (sources) it is on: 32
registers; a register is kept as the 16-bit map of the ranks it has seen, four
registers in a long, so sketches merge by bitwise or inside an ordinary
aggregation, and a register's value is its highest bit. Lines whose estimate
lies within `z` standard errors of `min_sites` get an exact distinct count; those
above are on enough sites, those below are not. A boilerplate line stays at its
first place (least doc_id, then line), so a page that was copied to many sites
is kept once.

Lines are compared without leading and trailing spaces, by a 96-bit hash; lines of
spaces alone are never removed.

Defined results: a null or empty text has one empty line. A null source is one site.
Null doc_ids come first; rows of equal doc_id are told apart by their text's
hash, and rows equal in both lose the same lines. Other columns pass through `remove_lines`; of them
n_chars, where it is there, follows the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import split_small, stage, text_key
from plumbline.llm.words import pieces

REGISTERS, WIDTH = 32, 16
PER_LONG = 64 // WIDTH
DROPS, ID, KEY = "_plumbline_drops", "_plumbline_id", "_plumbline_key"


def sketch(site: Column) -> list[Column]:
    """The sketch of one site, as longs to be merged by bitwise or."""
    h = F.xxhash64(site, F.lit(11))
    register = h.bitwiseAND(F.lit(REGISTERS - 1)).cast("int")
    rest = F.shiftrightunsigned(h, 5)
    rank = rest.bitwiseAND(-rest).bitwiseAND(F.lit((1 << WIDTH) - 1))  # the lowest bit that is set
    rank = F.when(rank == 0, F.lit(1 << (WIDTH - 1)).cast("long")).otherwise(rank)
    placed = [F.shiftleft(rank, k * WIDTH) for k in range(PER_LONG)]
    shifted = F.element_at(F.array(*placed), (register % PER_LONG + 1).cast("int"))
    return [F.when(F.floor(register / PER_LONG) == k, shifted).otherwise(F.lit(0).cast("long")) for k in range(REGISTERS // PER_LONG)]


def estimate(longs: list[Column]) -> Column:
    """Distinct sites of a merged sketch."""
    maps = [F.shiftrightunsigned(x, k * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)) for x in longs for k in range(PER_LONG)]
    values = F.array(*(F.when(m == 0, F.lit(0)).otherwise(F.length(F.bin(m))) for m in maps))
    inverse = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.pow(F.lit(2.0), -v.cast("double")))
    empty = F.size(F.filter(values, lambda v: v == 0))
    raw = F.lit(0.697 * REGISTERS**2) / inverse
    return F.when((raw <= 2.5 * REGISTERS) & (empty > 0), REGISTERS * F.log(F.lit(float(REGISTERS)) / empty)).otherwise(raw)


def error(sites: float) -> float:
    """Standard error of the estimate near a small count (linear counting) or a large one."""
    load = sites / REGISTERS
    return max(math.sqrt(REGISTERS * (math.exp(min(load, 2.5)) - min(load, 2.5) - 1)), 1.04 / math.sqrt(REGISTERS) * sites if load > 2.5 else 0.0)


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def line_table(docs: DataFrame) -> DataFrame:
    """h1, h2, site, id, key and pos of every line that is not blank."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = split_small(docs.select("doc_id", "text", "source")).select(
        _id(F.col("doc_id")).alias("id"), text_key(F.col("text")).alias("key"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )
    line = F.trim("line")
    return lines.where(line != "").select(F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"), "site", "id", "key", "pos")


def boilerplate(lines: DataFrame, min_sites: int, z: float = 5.0) -> DataFrame:
    """h1, h2 and first place of the lines on `min_sites` sites or more."""
    names = [f"s{k}" for k in range(REGISTERS // PER_LONG)]
    place = F.struct("id", "key", "pos")
    rows = lines.select("h1", "h2", place.alias("place"), *(c.alias(n) for c, n in zip(sketch(F.col("site")), names)))
    merged = rows.groupBy("h1", "h2").agg(F.min("place").alias("first"), *(F.bit_or(n).alias(n) for n in names))
    margin = z * error(min_sites)
    judged = merged.select("h1", "h2", "first", estimate([F.col(n) for n in names]).alias("sites"))
    judged = stage(judged.where(F.col("sites") >= min_sites - margin))
    near = judged.where(F.col("sites") <= min_sites + margin)
    counted = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"]).distinct().groupBy("h1", "h2").count()
    exact = near.join(counted.where(F.col("count") >= min_sites), ["h1", "h2"]).select("h1", "h2", "first")
    return stage(judged.where(F.col("sites") > min_sites + margin).select("h1", "h2", "first").unionByName(exact))


def _cut(text_at: int, drops_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, 1 << 20):
            texts, counts = [], []
            for text, drops in zip(piece.column(text_at).to_pylist(), piece.column(drops_at).to_pylist()):
                gone = set(drops or ())
                if gone:
                    text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
                texts.append(text)
                counts.append([len(gone)])
            columns = piece.columns
            columns[text_at] = pa.array(texts, pa.string())
            columns[drops_at] = pa.array(counts, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, piece.schema.names)

    return run


def _removed(docs: DataFrame, min_sites: int) -> DataFrame:
    """`docs` with the lines removed and their number in the one-element array DROPS."""
    lines = stage(line_table(docs))
    late = lines.join(boilerplate(lines, min_sites), ["h1", "h2"]).where(F.struct("id", "key", "pos") > F.col("first"))
    drops = late.groupBy(F.col("id").alias(ID), F.col("key").alias(KEY)).agg(F.collect_set("pos").alias(DROPS))
    keyed = docs.withColumn(ID, _id(F.col("doc_id"))).withColumn(KEY, text_key(F.col("text")))
    joined = keyed.join(drops, [ID, KEY], "left").drop(ID, KEY)
    names = joined.columns
    return joined.mapInArrow(_cut(names.index("text"), names.index(DROPS)), joined.schema)


def remove_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """`docs` without the boilerplate lines."""
    out = _removed(docs, min_sites)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(DROPS)[0] > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def line_dedup(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """doc_id, n_removed (lines) and kept_sha256 (of the text that is left)."""
    out = _removed(docs.select("doc_id", "text", "source"), min_sites)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col(DROPS)[0].cast("long").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, source, pos, line FROM (
    SELECT doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
  ), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line)
), bad AS (
  SELECT trim(line) AS line, min(doc_id * 1000000 + pos) AS first FROM lines WHERE trim(line) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= 10
), judged AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id * 1000000 + l.pos > b.first, false) AS gone
  FROM lines l LEFT JOIN bad b ON trim(l.line) = b.line
)
SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
