"""Word spans, word hashes and window hashes of Arrow text columns, vectorised over the UTF-8 bytes.

All hashes are polynomials modulo 2**64 over random odd bases, finished by a
mixer; they depend on the bytes alone, so every task and every retry agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BYTE_BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the 256 byte values: true inside the ranges (ends included)."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Word bytes: all but ASCII white space / ASCII digits, lower-case letters and everything beyond ASCII.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))


@lru_cache(maxsize=12)
def _power_table(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _power_table(base, 1 << max(16, int(n).bit_length()))[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column `text` of a piece holds about `limit` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of each text (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans(raw: np.ndarray, at: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each word (a run of member bytes inside one text), and the text it is in."""
    inside = members[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True  # a text begins here
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:]))
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTE_VALUE[raw] * powers(BYTE_BASE, len(raw)), out=total[1:])
    return mix((total[ends + 1] - total[starts]) * powers(inverse(BYTE_BASE), len(raw))[starts])


def windows(hashes: np.ndarray, length: int, base: int = WORD_BASE) -> np.ndarray:
    """The hash of `length` words from each word on (windows across texts included: mask them)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
    return mix((total[length:] - total[:n]) * powers(inverse(base), n))


def cover(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + lengths, n), -1)
    return np.cumsum(change[:n]) > 0
