"""Benchmark decontamination: document words inside any window of a benchmark item are hit.

Words are runs of digits, letters and characters beyond ASCII, A-Z in lower
case. A window is `n` consecutive words of an item; an item of fewer words is
one window. The distinct windows' hashes are a broadcast set, looked up first
in a small bit table and then in the sorted set; every match is verified by a
second, independent hash of the same words (128 bits in all).

The set is broadcast in blocks of at most `block_windows` windows (32 bytes
each), whatever the benchmark's size: the documents pass one scan per block in
a chain, each adding its hits, so neither a broadcast nor a worker's memory
grows with the benchmark.

Defined results: null and empty texts have no words and no hits; null items are
ignored, items of equal item_id count once, an empty benchmark hits nothing. Rows
of equal doc_id are judged each by itself; a null doc_id stays null. Other
columns of both tables are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.tables import split_small

MARKS = 1 << 22
#: The internal column of packed hits; other columns of the documents pass through.
HITS = "_plumbline_hits"


def _words(column: pa.Array):
    raw, at = W.text_bytes(column)
    raw = W.LOWER[raw]
    starts, ends, doc = W.spans(raw, at, W.ALNUM)
    return W.word_hashes(raw, starts, ends), doc, np.searchsorted(doc, np.arange(len(at)))


def _item_windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            hashes, doc, first = _words(piece.column("text"))
            count = np.diff(first)
            for size in np.unique(np.clip(count[count > 0], 1, n)):
                one, two = W.windows(hashes, int(size)), W.windows(hashes, int(size), W.OTHER_BASE)
                ok = (doc[: len(one)] == doc[size - 1 :]) & (np.minimum(count[doc[: len(one)]], n) == size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[ok].view(np.int64)), pa.array(two[ok].view(np.int64)), pa.array(np.full(ok.sum(), size, np.int32)), piece.column("item_id").take(pa.array(doc[: len(one)][ok]))],
                    ["h1", "h2", "size", "item_id"],
                )

    return run


class Grams:
    """A block of benchmark windows, sorted by size and hash, with the items of each."""

    def __init__(self, rows):
        size, one, two, item = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        one, two = one.view(W.U64), two.view(W.U64)
        self.by_size = {}
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            at = at[np.lexsort((item[at], two[at], one[at]))]
            marks = np.zeros(MARKS, bool)
            marks[(one[at] % W.U64(MARKS)).astype(np.int64)] = True
            self.by_size[int(s)] = (marks, one[at], two[at], item[at])

    def find(self, hashes: np.ndarray, doc: np.ndarray):
        """Yield (first words, size, items) of all windows that occur; a window of several items occurs once for each."""
        for size, (marks, one, two, item) in self.by_size.items():
            seen = W.windows(hashes, size)
            if not len(seen):
                continue
            at = np.flatnonzero(marks[(seen % W.U64(MARKS)).astype(np.int64)])
            at = at[doc[at] == doc[at + size - 1]]
            low, high = np.searchsorted(one, seen[at], "left"), np.searchsorted(one, seen[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if not len(at):
                continue
            many = high - low
            row = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            start = np.repeat(at, many)
            other = W.windows(hashes, size, W.OTHER_BASE)[start]
            same = other == two[row]
            yield start[same], size, item[row[same]]


def _scan(shared):
    """Add the block's hits to those of earlier blocks: first word, size and item of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for piece in W.pieces(batches):
            hashes, doc, first = _words(piece.column("text"))
            hits: dict[int, list[np.ndarray]] = {}
            for start, size, item in grams.find(hashes, doc):
                rows = np.stack([start - first[doc[start]], np.full(len(start), size), item], 1).astype(np.int64)
                order = np.argsort(doc[start], kind="stable")
                which, cut = np.unique(doc[start][order], return_index=True)
                for d, part in zip(which.tolist(), np.split(rows[order], cut[1:])):
                    hits.setdefault(d, []).append(part)
            old = piece.column(HITS).to_pylist()
            out = [(old[d] or b"") + b"".join(x.tobytes() for x in hits.get(d, ())) for d in range(piece.num_rows)]
            at = piece.schema.get_field_index(HITS)
            columns = piece.columns
            columns[at] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, piece.schema.names)

    return run


def benchmark_blocks(bench: DataFrame, n: int, block_windows: int):
    """Broadcasts of the benchmark's distinct (window, item) rows, each of about `block_windows` rows."""
    rows = split_small(bench.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text"))
    rows = rows.mapInArrow(_item_windows(n), "h1 long, h2 long, size int, item_id long").distinct()
    blocks = -(-rows.count() // block_windows)
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("h1"), F.lit(max(1, blocks))))
    for block in range(blocks):
        part = numbered.where(F.col("block") == block).select("size", "h1", "h2", "item_id").collect()
        if part:
            yield bench.sparkSession.sparkContext.broadcast(Grams(part))


def find_hits(docs: DataFrame, bench: DataFrame, n: int = 13, block_windows: int = 1 << 20) -> DataFrame:
    """`docs` with the column HITS: packed int64 triples (first word, size, item_id)."""
    out = split_small(docs).withColumn(HITS, F.lit(None).cast("binary"))
    for shared in benchmark_blocks(bench, n, block_windows):
        out = out.mapInArrow(_scan(shared), out.schema)
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in W.pieces(batches):
        raw, at = W.text_bytes(piece.column("text"))
        starts, _, doc = W.spans(W.LOWER[raw], at, W.ALNUM)
        count = np.diff(np.searchsorted(doc, np.arange(len(at))))
        n_hit, n_items, names = [], [], []
        for words, hits in zip(count.tolist(), piece.column(HITS).to_pylist()):
            found = np.frombuffer(hits or b"", np.int64).reshape(-1, 3)
            n_hit.append(int(W.cover(found[:, 0], found[:, 1], words).sum()) if len(found) else 0)
            items = sorted(map(str, np.unique(found[:, 2]).tolist()))
            n_items.append(len(items))
            names.append(",".join(items))
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(names, pa.string())],
            ["doc_id", "n_words", "n_hit", "n_items", "items"],
        )


def contamination(docs: DataFrame, bench: DataFrame, n: int = 13, least_share: float = 0.05, block_windows: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (item_ids sorted as strings) and contaminated (a share of words hit)."""
    kind = dict(docs.dtypes)["doc_id"]
    found = find_hits(docs.select("doc_id", "text"), bench, n, block_windows)
    judged = found.mapInArrow(_judge, f"doc_id {kind}, n_words long, n_hit long, n_items long, items string")
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / least_share) >= F.col("n_words")))


def _strip(least_share: float, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            raw, at = W.text_bytes(piece.column("text"))
            starts, ends, doc = W.spans(W.LOWER[raw], at, W.ALNUM)
            first = np.searchsorted(doc, np.arange(len(at)))
            texts, reject = [], []
            for d, (text, hits) in enumerate(zip(piece.column("text").to_pylist(), piece.column(HITS).to_pylist())):
                found = np.frombuffer(hits or b"", np.int64).reshape(-1, 3)
                n = int(first[d + 1] - first[d])
                hit = W.cover(found[:, 0], found[:, 1], n) if len(found) else np.zeros(n, bool)
                reject.append(bool(hit.any() and hit.sum() * round(1 / least_share) >= n))
                if cut and hit.any():
                    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    data, kept, last = raw[at[d] : at[d + 1]].tobytes(), [], 0
                    for low, high in edge:
                        kept.append(data[last : starts[first[d] + low] - at[d]])
                        last = ends[first[d] + high - 1] + 1 - at[d]
                    text = b"".join([*kept, data[last:]]).decode()
                texts.append(text)
            columns, names = piece.columns, piece.schema.names
            columns[names.index("text")] = pa.array(texts, pa.string())
            columns[names.index(HITS)] = pa.array(reject)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 13, least_share: float = 0.05, spans: bool = False, block_windows: int = 1 << 20) -> DataFrame:
    """The documents that are not contaminated; with `spans`, hit words are cut from those that stay."""
    found = find_hits(docs, bench, n, block_windows)
    schema = ", ".join(f"`{c}` {t}" for c, t in [*docs.dtypes, (HITS, "boolean")])
    return found.mapInArrow(_strip(least_share, spans), schema).where(~F.col(HITS)).drop(HITS)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")
