"""Records that have no fixed separator, read by Spark's own splits.

Spark's text reader gives every split of a file the pieces (lines, or what lies between two separators) that begin in it,
in order and each once. A record is one or more pieces, and only its content tells where it begins. A task puts the
records together that begin and end in one split. What is left at the two ends of a split, at most two
fragments, is put together across splits; these fragments are all that is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = "path string, block long, kind int, data binary"
#: Bytes of a record; what goes beyond is cut off, so that a stretch without a beginning cannot fill a task.
LONGEST = 16 << 20


def _gather(begins: Callable[[list[bytes]], list[bool]], separator: bytes, longest: int, wanted: tuple[int, ...], rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, kind, parts, size = None, HEAD, [], 0
        out: list[tuple] = []
        held = 0

        def close(as_kind: int) -> None:
            nonlocal parts, size, held
            if as_kind in wanted and (parts or as_kind == TAIL):
                out.append((*split, as_kind, separator.join(parts)[:longest]))
                held += len(out[-1][-1])
            parts, size = [], 0

        def sent() -> pa.RecordBatch:
            nonlocal out, held
            columns, out, held = list(zip(*out)), [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.binary()))], ["path", "block", "kind", "data"])

        for batch in batches:
            data = batch.column("data").to_pylist()
            places = zip(batch.column("path").to_pylist(), batch.column("block").to_pylist())
            for place, piece, new in zip(places, data, begins(data)):
                if place != split:
                    if split:
                        close(kind)
                    split, kind = place, HEAD
                if new:
                    close(HEAD if kind == HEAD else WHOLE)
                    kind = TAIL
                if size <= longest:
                    parts.append(piece)
                    size += len(piece) + len(separator)
                if len(out) >= rows or held > longest:
                    yield sent()
        if split:
            close(kind)
        if out:
            yield sent()

    return run


def records(
    spark: SparkSession, path: str, begins: Callable[[list[bytes]], list[bool]], separator: str = "\n", longest: int = LONGEST
) -> DataFrame:
    """(path, data): the records of the files, from one piece that `begins` a record to the next, joined by the separator.

    What stands in a file before its first record is left out. A record over ``longest`` bytes is cut there.
    """
    raw = spark.read.option("lineSep", separator).text(path)
    pieces = raw.select(F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    cut = lambda *kinds: pieces.mapInArrow(_gather(begins, separator.encode(), longest, kinds), PIECES)
    ends = cut(HEAD, TAIL)
    order = Window.partitionBy("path").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = ends.withColumn("record", F.sum((F.col("kind") == TAIL).cast("long")).over(order)).where("record > 0")
    joined = numbered.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "data"))).alias("parts"))
    mark = F.encode(F.lit(separator), "utf-8")
    whole = F.aggregate(
        F.slice("parts", F.lit(2), F.greatest(F.lit(0), F.size("parts") - 1)), F.col("parts")[0]["data"],
        lambda s, p: F.when(F.octet_length(s) > longest, s).otherwise(F.concat(s, mark, p["data"])),
    )
    return cut(WHOLE).select("path", "data").unionByName(joined.select("path", F.substring(whole, 1, longest).alias("data")))
