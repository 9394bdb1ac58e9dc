"""Token ids as Arrow random-access files of fixed-size-list batches.

The ids of all documents, each with an end id, follow one another in ascending
doc_id order and are cut into sequences of `length` ids. A range of doc_ids is
one file: record batches with the columns

    ids   fixed_size_list<uint16 or uint32>[length]   the sequence, zeros behind the last id
    mask  fixed_size_list<bool>[length]               true where there is an id
    ends  fixed_size_list<bool>[length]               true at the last id of a document

Only the last sequence of a file is short. Every batch but the last has
`batch_rows` sequences, so sequence k is row k % batch_rows of batch
k // batch_rows, and an uncompressed, memory-mapped file gives it without a copy. A
second small file beside it holds doc_id, start and n_tokens of its documents.

Files are written under a name of their own for each attempt and reach the
manifest only with the committed output of the task, so lost executors and
repeated tasks leave no double rows. The folder is any URI that pyarrow's file
systems read; it must be shared.

Texts are encoded by the tokenizers library. A text is cut before each single
space between two characters that are not white space - a boundary of the byte
level pre-tokenizer, so the ids of the parts are the ids of the whole - and each
distinct part is encoded once per worker (about `CACHE` parts are kept; then the
store is emptied). Texts with other white space beside a space or with a special
token's string are encoded whole.

Defined results: null and empty texts give the end id alone; rows of equal
doc_id are ordered by their text's hash, rows equal in both are adjacent and
interchangeable; null doc_ids come first. An empty table gives no file and no row.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.tables import shared_dir, stage, text_key
from plumbline.llm.words import pieces

CACHE = 500_000
_STATE: dict = {}


class Encoder:
    """A tokenizer that encodes each distinct part of the texts once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.opens = np.zeros(size, bool)  # tokens that begin with a space
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[k] = token.startswith("Ġ")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # parts behind a space: neither empty nor with white space at an end
        self.before: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, parts: list[str]) -> None:
        """Encode distinct parts in one string; each begins with its only space, so its first token tells where."""
        for low in range(0, len(parts), 20_000):
            some = parts[low : low + 20_000]
            ids = self.ids(" " + " ".join(some))
            at = np.flatnonzero(self.opens[ids])
            assert len(at) == len(some)
            data, cuts = ids.tobytes(), [*(at * ids.itemsize).tolist(), len(ids) * ids.itemsize]
            self.known.update((part, data[a:b]) for part, a, b in zip(some, cuts, cuts[1:]))

    def _renew(self) -> None:
        """Past CACHE parts a new generation begins; parts of the one before are carried over as they are met."""
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        if len(self.heads) > CACHE // 8:
            self.heads.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of self.dtype."""
        self._renew()
        known, heads, whole = self.known, self.heads, set()
        cut = [t.split(" ") for t in texts]
        tails = [list(map(known.get, islice(parts, 1, None))) for parts in cut]  # looked up once: most of the time goes there
        missed = [[p for p, ids in zip(islice(parts, 1, None), tail) if ids is None] if None in tail else [] for parts, tail in zip(cut, tails)]
        new = set().union(*missed)
        carried = new & self.before.keys()
        known.update(zip(carried, map(self.before.__getitem__, carried)))
        new -= carried
        unseen = new | ({parts[0] for parts in cut} - heads.keys())
        bad = {p for p in unseen if p.strip() != p or not p}
        text = " ".join(unseen)
        bad |= {p for x in self.special if x in text for p in unseen if x in p}
        if bad:
            whole = {k for k, parts in enumerate(cut) if parts[0] in bad or not bad.isdisjoint(missed[k])}
        self._learn(list(new - bad))
        first = list({parts[0] for k, parts in enumerate(cut) if k not in whole} - heads.keys())
        heads.update((h, np.array(e.ids, self.dtype).tobytes()) for h, e in zip(first, self.tokenizer.encode_batch_fast(first, add_special_tokens=False)))
        out = []
        for k, (text, parts, tail) in enumerate(zip(texts, cut, tails)):
            if k in whole:
                out.append(self.ids(text).tobytes())
            else:
                if missed[k]:
                    learned = map(known.__getitem__, missed[k])
                    tail = [next(learned) if ids is None else ids for ids in tail]
                out.append(heads[parts[0]] + b"".join(tail))
        return out


def encoder(path: str) -> Encoder:
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]


def file_system(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _write(folder: str, path: str, end: int, length: int, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        kind = np.dtype(tool.dtype)
        name = uuid.uuid4().hex
        fs, root = file_system(folder)
        seq = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        out = None
        held, marks, total, docs = bytearray(), bytearray(), 0, 0
        step = length * batch_rows

        def batch(n: int) -> pa.RecordBatch:
            """The first n ids held, filled up to whole sequences."""
            rows = -(-n // length)
            ids = np.zeros(rows * length, kind)
            ids[:n] = np.frombuffer(bytes(held[: n * kind.itemsize]), kind)
            ends = np.zeros(rows * length, bool)
            ends[:n] = np.frombuffer(bytes(marks[:n]), bool)
            mask = np.arange(rows * length) < n
            return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask, ends)], schema=seq)

        for piece in pieces(batches):
            if out is None:
                files = [fs.open_output_stream(f"{root}/{name}.{x}") for x in ("arrow", "docs.arrow")]
                out = [ipc.new_file(f, s) for f, s in zip(files, (seq, index))]
            tokens = tool.encode([t or "" for t in piece.column("text").to_pylist()])
            tail = np.array([end], kind).tobytes()
            starts, counts = [], []
            for x in tokens:
                n = len(x) // kind.itemsize + 1
                starts.append(total)
                counts.append(n)
                held += x + tail
                marks += bytes(n - 1) + b"\x01"
                total += n
            docs += len(tokens)
            out[1].write(pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index))
            while len(marks) >= step:
                out[0].write(batch(step))
                del held[: step * kind.itemsize], marks[:step]
        if out is not None:
            if marks:
                out[0].write(batch(len(marks)))
            for x in (*out, *files):
                x.close()
            yield pa.RecordBatch.from_arrays([pa.array([partition_id()], pa.int32()), *(pa.array([x]) for x in (name, docs, total))], ["part", "file", "n_docs", "n_tokens"])

    return run


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def write_token_files(docs: DataFrame, path: str, end: int = 2, folder: str | None = None, length: int = 1024, batch_rows: int = 64, files: int | None = None) -> tuple[str, DataFrame]:
    """Write the files; return their folder and the manifest: part, file, n_docs, n_tokens, in doc_id order of part."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text", text_key(F.col("text")).alias("key"))
    ordered = keyed.repartitionByRange(files, "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    made = ordered.mapInArrow(_write(folder, path, end, length, batch_rows), "part int, file string, n_docs long, n_tokens long")
    return folder, stage(made)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{root}/{name}.docs.arrow") as f, fs.open_input_file(f"{root}/{name}.arrow") as g:
                    index, seqs = ipc.open_file(f), ipc.open_file(g)
                    stream = (seqs.get_batch(k) for k in range(seqs.num_record_batches))
                    held, ends = np.zeros(0, np.uint32), np.zeros(0, bool)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        counts = part.column("n_tokens").to_numpy()
                        need = int(counts.sum())
                        parts, marks, have = [held], [ends], len(held)
                        while have < need:
                            seq = next(stream)
                            mask = seq.column("mask").flatten().to_numpy(zero_copy_only=False)
                            parts.append(seq.column("ids").flatten().to_numpy()[mask])
                            marks.append(seq.column("ends").flatten().to_numpy(zero_copy_only=False)[mask])
                            have += len(parts[-1])
                        ids, ends = np.concatenate(parts).astype("<u4"), np.concatenate(marks)
                        cuts = np.cumsum(counts)
                        assert (np.flatnonzero(ends[:need]) == cuts - 1).all()
                        rows = [ids[a:b].tobytes() for a, b in zip(cuts - counts, cuts)]
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id"), pa.array(part.column("start").to_numpy() + start), pa.array(counts), pa.array(rows, pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        held, ends = ids[need:], ends[need:]

    return run


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian uint32) from the files, one task a file."""
    rows, start = [], 0
    for r in manifest.select("part", "file", "n_tokens").orderBy("part").collect():  # one row a file
        rows.append((r.file, start))
        start += r.n_tokens
    listed = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
