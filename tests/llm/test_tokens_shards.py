"""Token files against the tokenizer itself, shards and fingerprints against their laws."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.ipc as ipc
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import fingerprints as P
from plumbline.llm import shards as H
from plumbline.llm import token_files as T
from plumbline.llm.queries import op4_token_files, op6_shards, op10_fingerprints

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_tokens(rows):
    tool, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in rows:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens_of_the_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    assert sorted(map(tuple, op4_token_files(spark, folder).collect())) == brute_tokens([(r.doc_id, r.text) for r in docs])


def test_parts_are_encoded_as_the_whole():
    tool, plain, rng = T.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(3)
    atoms = ["a", "don't", " ", "\n", "  ", "\t", "é", "日本", "1", "<|endoftext|>", "|", " ", " ", "\x1c", "😀", "'s", "..", "\x85"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["", " ", " a", "a "]
    for t, x in zip(texts, tool.encode(texts)):
        assert np.frombuffer(x, tool.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_tokens_of_odd_rows(spark, odd, empty, tmp_path):
    folder, manifest = T.write_token_files(odd, PATH, folder=str(tmp_path / "x"), length=8, batch_rows=3, files=3)
    got = sorted(T.digest(T.read_token_files(spark, folder, manifest)).collect(), key=lambda r: r.start)
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(brute_tokens([(r.doc_id, r.text)])[0][2:])
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(str((i, *x)) for i, xs in texts.items() for x in xs)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    folder, manifest = T.write_token_files(empty, PATH, folder=str(tmp_path / "y"))
    assert T.read_token_files(spark, folder, manifest).collect() == []


def test_files_give_sequences_without_a_copy(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(40)], "doc_id long, text string")
    folder, manifest = T.write_token_files(docs, PATH, folder=str(tmp_path / "z"), length=16, batch_rows=2, files=1)
    row = manifest.first()
    reader = ipc.open_file(pa.memory_map(f"{folder}/{row.file}.arrow"))
    assert reader.schema.field("ids").type == pa.list_(pa.uint16(), 16)
    before = pa.total_allocated_bytes()
    seqs = [reader.get_batch(k) for k in range(reader.num_record_batches)]
    assert all(b.num_rows == 2 for b in seqs[:-1]) and pa.total_allocated_bytes() - before < 1000
    mask = np.concatenate([b.column("mask").flatten().to_numpy(zero_copy_only=False) for b in seqs])
    ids = np.concatenate([b.column("ids").flatten().to_numpy() for b in seqs])
    assert mask.sum() == row.n_tokens and (ids[~mask] == 0).all()


def test_shards_of_the_table(spark, folder):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op6_shards(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    check_slots(rows, 8)


def check_slots(rows, shards):
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert all(x == list(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == len(rows)
    counts = list(map(len, slots.values()))
    assert max(counts) - min(counts) <= 1


def test_shards_are_exact_and_random(spark, odd, empty):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'same' AS text", "1 AS at")
    one = H.shuffle_into_shards(docs, 7, seed=1, rows=150).collect()
    check_slots(one, 7)
    ids = np.array([r.doc_id for r in sorted(one, key=lambda r: (r.shard, r.slot))])
    assert abs(np.corrcoef(np.arange(4000), ids)[0, 1]) < 0.06
    means = [np.mean([r.doc_id for r in one if r.shard == s]) for s in range(7)]
    assert max(abs(m - 2000) for m in means) < 4 * 1155 / np.sqrt(4000 / 7)
    two = {r.doc_id: (r.shard, r.slot) for r in H.shuffle_into_shards(docs, 7, seed=2, rows=150).collect()}
    assert sum(two[r.doc_id] == (r.shard, r.slot) for r in one) < 40
    check_slots(H.shuffle_into_shards(odd).collect(), 8)
    assert H.shuffle_into_shards(empty).collect() == []


def test_matrix_has_exact_margins_and_the_right_law():
    parts, sizes = [5, 0, 12, 3], [7, 7, 6]
    draws = np.array([H.communication_matrix(parts, sizes, s) for s in range(3000)])
    assert (draws.sum(2) == parts).all() and (draws.sum(1) == sizes).all() and (draws >= 0).all()
    assert np.allclose(draws.mean(0), np.outer(parts, sizes) / 20, atol=0.08)
    cell = draws[:, 2, 0]  # hypergeometric: 12 of 20 rows, 7 wanted
    assert abs(cell.var() - 12 * 7 / 20 * (8 / 20) * (13 / 19)) < 0.1


def test_fingerprints_of_the_table(spark, folder):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = {r.doc_id: r for r in op10_fingerprints(spark, folder).collect()}
    assert len(rows) == len(docs)
    seen = {}
    for (i, t), (_, after) in zip(docs, [*docs[1:], docs[0]]):
        r, k = rows[i], len(t) // 2
        edited = t[: len(t) - k] + after[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(seen.values())) == len({"\n".join(sorted(x for x in t.split("\n") if x.strip())) for t in seen})
    near, far = (np.array([getattr(r, c) for r in rows.values()]) for c in ("near_edited", "near_next"))
    assert 0 <= near.min() and near.max() <= 1 and near.mean() > 0.3 > 0.1 > far.mean()


def test_fingerprints_add_and_forget_order(spark):
    texts = {"ab": "one two\nthree four five six seven", "ba": "three four five six seven\n\none two", "a": "one two", "b": "three four five six seven", "none": ""}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    fp = {r.name: r.fingerprint for r in P.fingerprints(df, ["name"]).collect()}
    assert fp["ab"] == fp["ba"] != fp["a"] and fp["none"] == "0" * 576
    row = spark.createDataFrame([(fp["a"], fp["b"], fp["ab"])], "a string, b string, ab string")
    got = row.select(P.plus(F.col("a"), F.col("b")), P.minus(F.col("ab"), F.col("b")), P.likeness(F.col("ab"), F.col("ab")), P.likeness(F.col("a"), F.lit(fp["none"]))).first()
    assert tuple(got) == (fp["ab"], fp["a"], 1.0, 0.0)


def test_fingerprints_of_odd_rows(spark, odd, empty):
    rows = P.fingerprint_report(odd).collect()
    assert len(rows) == odd.count() and P.fingerprint_report(empty).collect() == []
    single = P.fingerprint_report(odd.where("doc_id = 4")).first()
    assert single.n_chars == 3 and single.near_next == 1.0


def test_parts_are_looked_up_once_and_heads_are_not_learned_as_parts():
    tool = T.Encoder(PATH)

    class Counted(dict):
        looked = 0

        def get(self, key, default=None):
            Counted.looked += 1
            return dict.get(self, key, default)

        def __getitem__(self, key):
            Counted.looked += 1
            return dict.__getitem__(self, key)

    tool.known = Counted()
    texts = ["alpha beta gamma", "alpha  beta", "delta\n beta", "", "x<|endoftext|> beta gamma", "gamma beta\tgamma delta", " beta"]
    want = [tool.ids(t).tobytes() for t in texts]
    assert tool.encode(texts) == want and "alpha" not in tool.known
    Counted.looked = 0
    assert tool.encode(["alpha beta gamma"] * 5) == want[:1] * 5 and Counted.looked == 10
