"""Substring dedup: remove words covered by a window that also starts in an earlier document.

Method (count-min prefilter). Every window of `length` words has an anchor: the
least hash among the runs of `length // 2` words inside it. Equal windows have
equal anchors, so the number of documents that hold a window's anchor is at
least the number that hold the window. Each partition counts its anchors in a
sparse count-min sketch; the sketches are merged by block of cells, and what is
left of the merged sketch is one bit per cell: counted twice or more. A second
pass emits only the windows whose anchor is twice or more in every row of the
sketch - it overestimates, so no repeated window is lost - and an exact
grouping of their 96-bit hashes decides. A task first decides among its own
documents: of equal windows only those of its earliest document are sent on, so a
passage that a third of all documents share sends one row a task, not one a document.

The sketch grows with the text (`cells_per_anchor`) up to `max_cells` a row,
which bounds the broadcast to `depth * max_cells / 8` bytes; beyond that more
windows pass the filter, and the result stays the same.

Defined results: a null or empty text has no words. Rows with equal doc_id are
separate documents, neither smaller than the other. A row with a null doc_id
keeps all its words and makes none repeat. Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.tables import split_small, text_key

BLOCK = 1 << 16
FLUSH = 4 << 20


def _anchors(piece: pa.RecordBatch, length: int):
    """Text of each window, its first word, the word hashes, each window's anchor and each text's first word."""
    raw, at = W.text_bytes(piece.column("text"))
    starts, ends, doc = W.spans(raw, at, W.NOT_SPACE)
    hashes = W.word_hashes(raw, starts, ends)
    first = np.searchsorted(doc, np.arange(len(at)))
    n = len(hashes) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, hashes, np.zeros(0, W.U64), first
    half = length // 2
    least = W.windows(hashes, half)
    size, step = length - half + 1, 1  # least of `size` runs, by doubling
    while 2 * step <= size:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if size > step:
        least = np.minimum(least[: len(least) - (size - step)], least[size - step :])
    at_word = np.flatnonzero(doc[:n] == doc[length - 1 :])
    return doc[at_word], at_word, hashes, least[:n][at_word], first


def _cells(anchors: np.ndarray, bits: int, depth: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch; rows follow one another."""
    return [
        (W.mix(anchors + W.U64(0x632BE59BD9B4E019 * (row + 1) % (1 << 64))) >> W.U64(64 - bits)).astype(np.int64) + (row << bits)
        for row in range(depth)
    ]


def _sparse(cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Cells with how often they were counted (1, or 2 for more), by block."""
    if not cells:
        return
    cell, count = np.unique(np.concatenate(cells), return_counts=True)
    cuts = np.flatnonzero(np.diff(cell // BLOCK, prepend=-1))
    out = [[], [], []]
    for low, high in zip(cuts, [*cuts[1:], len(cell)]):
        part, twice = (cell[low:high] % BLOCK).astype(np.uint16), count[low:high] > 1
        for column, value in zip(out, (int(cell[low] // BLOCK), part[~twice].tobytes(), part[twice].tobytes())):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["block", "once", "twice"])


def _sketch(length: int, bits: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for piece in W.pieces(batches):
            doc, _, _, anchor, _ = _anchors(piece, length)
            if not len(doc):
                continue
            new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(anchor, prepend=anchor[:1] ^ W.U64(1)) != 0))
            doc, anchor = doc[new], anchor[new]
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            once = np.ones(len(doc), bool)
            once[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            held += _cells(anchor[once], bits, depth)
            n += int(once.sum()) * depth
            if n > FLUSH:
                yield from _sparse(held)
                held, n = [], 0
        yield from _sparse(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the sketches of a block; 64 KB of counters for each block of this partition."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, twice in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "twice"))):
            have = counts.setdefault(block, np.zeros(BLOCK, np.uint8))
            one = np.frombuffer(once, np.uint16)
            have[one] = np.minimum(have[one] + 1, 2)
            have[np.frombuffer(twice, np.uint16)] = 2
    full = [(b, np.packbits(c >= 2).tobytes()) for b, c in counts.items() if (c >= 2).any()]
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in full], pa.int32()), pa.array([x for _, x in full], pa.binary())], ["block", "bits"])


def repeated_bits(docs: DataFrame, length: int, bits: int, depth: int) -> bytes:
    """The merged sketch: a bit for each cell, set where it was counted twice or more."""
    sparse = docs.select("text").mapInArrow(_sketch(length, bits, depth), "block int, once binary, twice binary")
    blocks = max(1, (depth << bits) // BLOCK)
    parts = max(1, min(blocks, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 256)))
    out = np.zeros((blocks, BLOCK // 8), np.uint8)
    for row in sparse.repartition(parts, "block").mapInArrow(_merge, "block int, bits binary").toLocalIterator():
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def _decide(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Of the equal windows found, send those of the earliest document on; the others are repeats already."""
    if not found:
        return
    h1, h2, doc_id, key, pos = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((doc_id, h2, h1))
    h1, h2, doc_id, key, pos = (c[order] for c in (h1, h2, doc_id, key, pos))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    late = doc_id > doc_id[np.flatnonzero(new)[np.cumsum(new) - 1]]
    open_ = ~late
    yield _rows(h1[open_], h2[open_], doc_id[open_], key[open_], pos[open_], None)
    doc_id, key, pos = doc_id[late], key[late], pos[late]
    order = np.lexsort((key, doc_id))
    doc_id, key, pos = doc_id[order], key[order], pos[order]
    first = np.flatnonzero(np.r_[True, (np.diff(doc_id) != 0) | (np.diff(key) != 0)]) if len(pos) else np.zeros(0, np.int64)
    packed = [x.tobytes() for x in np.split(pos, first[1:])] if len(pos) else []
    spread = W.mix(doc_id[first].view(W.U64))
    yield _rows(spread.view(np.int64), np.zeros(len(first), np.int32), doc_id[first], key[first], np.full(len(first), -1, np.int32), packed)


def _rows(h1, h2, doc_id, key, pos, packed) -> pa.RecordBatch:
    packed = pa.nulls(len(h1), pa.binary()) if packed is None else pa.array(packed, pa.binary())
    return pa.RecordBatch.from_arrays([*map(pa.array, (h1, h2, doc_id, key, pos)), packed], ["h1", "h2", "doc_id", "key", "pos", "packed"])


def _emit(length: int, bits: int, depth: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, found, n = np.frombuffer(shared.value, np.uint8), [], 0
        for piece in W.pieces(batches):
            doc, at_word, hashes, anchor, first = _anchors(piece, length)
            ok = np.ones(len(doc), bool)
            for cell in _cells(anchor, bits, depth):
                ok &= (sketch[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
            doc, at_word = doc[ok], at_word[ok]
            if not len(doc):
                continue
            found.append((
                W.windows(hashes, length)[at_word].view(np.int64),
                (W.windows(hashes, length, W.OTHER_BASE)[at_word] >> W.U64(32)).astype(np.uint32).view(np.int32),
                piece.column("doc_id").to_numpy()[doc],
                piece.column("key").to_numpy()[doc],
                (at_word - first[doc]).astype(np.int32),
            ))
            n += len(doc)
            if n > FLUSH // 2:
                yield from _decide(found)
                found, n = [], 0
        yield from _decide(found)

    return run


def repeats(docs: DataFrame, length: int = 50, depth: int = 2, cells_per_anchor: int = 4, max_cells: int = 1 << 29) -> DataFrame:
    """Per document (doc_id, key = text_key) the first words of its windows that an earlier document holds too: `drops`, and `packed` int32."""
    keyed = split_small(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text", text_key(F.col("text")).alias("key")))
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = max(1, size // (3 * length))  # about two anchors in `length // 2` words of six bytes
    bits = min(max(16, math.ceil(math.log2(anchors * cells_per_anchor))), int(math.log2(max_cells)))
    shared = docs.sparkSession.sparkContext.broadcast(repeated_bits(keyed, length, bits, depth))
    found = keyed.mapInArrow(_emit(length, bits, depth, shared), "h1 long, h2 int, doc_id long, key int, pos int, packed binary")
    same = Window.partitionBy("h1", "h2").orderBy("doc_id")  # a row for each task that holds the window, and running: nothing is gathered
    late = found.withColumn("least", F.first("doc_id").over(same)).where("packed is not null or doc_id > least")
    return late.groupBy("doc_id", "key").agg(F.collect_list(F.when(F.col("pos") >= 0, F.col("pos"))).alias("drops"), F.collect_list("packed").alias("packed"))


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches, 8 << 20):
            kept_texts, n_words, n_removed = [], [], []
            for text, drops, packed in zip(piece.column("text"), piece.column("drops"), piece.column("packed")):
                words = (text.as_py() or "").encode().split()  # bytes.split knows ASCII white space only
                n_words.append(len(words))
                if drops.is_valid:
                    places = [drops.values.to_numpy(), *(np.frombuffer(x, np.int32) for x in packed.as_py())]
                    gone = W.cover(np.concatenate(places), length, len(words))
                    words = [w for w, out in zip(words, gone) if not out]
                n_removed.append(n_words[-1] - len(words))
                kept_texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    return run


def substring_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space, as `text`."""
    drops = repeats(docs, length)
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    joined = keyed.join(drops, ["doc_id", "key"], "left").select("doc_id", "text", "drops", "packed")
    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(_apply(length), f"doc_id {kind}, n_words long, n_removed long, text string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
