"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a model and composed with each input:

* normaliser: a word mark for each space and one before the text (models whose
  normaliser is the identity);
* pieces: a trie whose arcs read characters and write a piece. Its states also
  remember the piece before, because a merge model is not additive: an arc has
  weight one where the two pieces, joined, are encoded as just these two, and
  infinite weight otherwise. A sequence of pieces whose neighbours all agree is
  the model's own encoding, and there is just one;
* byte fallback: a character that is no piece reads as its UTF-8 bytes' pieces.

The shortest path over the tropical semiring (least sum of weights) is taken by
relaxing the arcs from left to right. Texts are cut where no piece of the model
holds the two characters side by side: no path crosses such a place, so the
shortest path is the concatenation of the parts', and each distinct part is composed
once per worker (the last `CACHE` to twice as many parts are kept, in two generations).

Neighbours agree: decided by the merge rule on the two pieces' characters (best
score first, leftmost on ties), once for each pair.

Defined results: null and empty texts have no ids; other columns pass through
`encode` untouched. Decoding gives the text back, word marks in it (U+2581) as spaces.
An id outside the model is an error.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import split_small
from plumbline.llm.words import pieces as text_pieces

MARK = "▁"
CACHE = 200_000
LONG = 64  # longer parts are not kept
_STATE: dict = {}


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models with an identity normaliser and a leading word mark")
        self.texts = [p.piece for p in model.pieces]
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        self.output = [bytes([int(t[3:5], 16)]) if p.type == 6 else t.replace(MARK, " ").encode() if p.type == 1 else b"" for t, p in zip(self.texts, model.pieces)]
        self.joined = {a + b for t in self.ids for a, b in zip(t, t[1:])}
        self.trie: dict = {}
        for text, k in self.ids.items():
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[""] = k
        for c, node in self.trie.items():  # characters that only begin pieces
            node.setdefault("", len(self.texts) + ord(c))
        self.agree: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # words that stand behind a space, without their mark
        self.older_words: dict[str, bytes] = {}

    def _text(self, k: int) -> str:
        """The characters an arc has read: a piece's, or the one that falls back to bytes."""
        return self.texts[k] if k < len(self.texts) else chr(k - len(self.texts))

    def merged(self, text: str, seam: int = 0) -> list[str]:
        """The merge rule on a few characters: best score first, leftmost on ties. It stops at a merge over the place `seam`."""
        parts, scores = list(text), self.scores
        found = list(map(scores.get, map(add, parts, parts[1:])))
        while True:
            best, i = None, -1
            for k, score in enumerate(found):
                if score is not None and (best is None or score > best):
                    best, i = score, k
            if best is None:
                return parts
            if seam and sum(map(len, parts[: i + 1])) == seam:
                return []
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = scores.get(parts[i - 1] + parts[i])
            if i < len(found):
                found[i] = scores.get(parts[i] + parts[i + 1])

    def weight(self, before: int, piece: int) -> float:
        """Of the arc that writes `piece` behind `before` (-1: at the beginning)."""
        key = (before + 1) << 24 | piece
        ok = self.agree.get(key)
        if ok is None:
            both = [self._text(before), self._text(piece)] if before >= 0 else [self._text(piece)]
            ok = self.agree[key] = self.merged("".join(both), len(both[0])) == both
        return 1.0 if ok else float("inf")

    def shortest(self, text: str) -> list[int]:
        """The pieces on the shortest path through the composition with a normalised part."""
        n, infinite = len(text), float("inf")
        cost, last, back = [infinite] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0
        trie, known, fallback = self.trie, self.agree, len(self.texts)
        for i in range(n):
            reached = cost[i] + 1
            if reached == infinite:
                continue
            before = (last[i] + 1) << 24
            node, k = trie, i
            for c in text[i:] if i else text:
                node = node.get(c)
                if node is None:
                    if k == i and reached < cost[i + 1] and self.weight(last[i], piece := fallback + ord(c)) == 1:
                        cost[i + 1], last[i + 1], back[i + 1] = reached, piece, i
                    break
                k += 1
                piece = node.get("")
                if piece is None or reached >= cost[k]:
                    continue
                ok = known.get(before | piece)
                if ok or ok is None and self.weight(last[i], piece) == 1:
                    cost[k], last[k], back[k] = reached, piece, i
        path, at = [], n
        while at:
            path.append(last[at])
            at = back[at]
        return path[::-1]

    def _compose(self, part: str) -> bytes:
        """ids of a part of the normalised text, cut where no piece holds both neighbours."""
        n, joined = len(part), self.joined
        if n > 1 and part[-2:] not in joined and n <= LONG:  # a word and its punctuation mark
            return self._part(part[:-1]) + self._part(part[-1])
        if not joined.issuperset(map(add, part, part[1:])):
            cuts = [i for i in range(1, n) if part[i - 1 : i + 1] not in joined]
            return b"".join([self._part(part[a:b]) for a, b in zip([0, *cuts], [*cuts, n])])
        out = array("i")
        for k in self.shortest(part):
            if k < len(self.texts):
                out.append(k)
            else:
                out.extend(self.bytes[b] for b in chr(k - len(self.texts)).encode())
        return out.tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            ids = self.older.get(part)
            if ids is None:
                ids = self._compose(part)
            if len(part) <= LONG:
                self.known[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        ids = self.older_words.get(word)
        if ids is None:
            ids = self._compose(MARK + word)
        if len(word) < LONG:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """int32 ids of a text."""
        if not text:
            return b""
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        if len(self.words) > CACHE:
            self.older_words, self.words = self.words, {}
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return b"".join(map(self._part, re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", (MARK + text.replace(" ", MARK)))))
        get, word = self.words.get, self._word
        return b"".join([get(p) or word(p) for p in text.split(" ")])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.output.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def transducer(path: str) -> Transducer:
    if path not in _STATE:
        _STATE[path] = Transducer(path)
    return _STATE[path]


def _lists(rows: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = transducer(path)
        for piece in text_pieces(batches, 4 << 20):
            at = piece.schema.get_field_index("ids")
            columns = piece.columns
            columns[at] = _lists([tool.encode(t or "") for t in piece.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(columns, piece.schema.names)

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with the column `ids` (replaced if there is one)."""
    out = split_small(docs).withColumn("ids", F.lit(None).cast("array<int>"))
    return out.mapInArrow(_encode(path), out.schema)


def _decode(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = transducer(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [tool.decode(x.values.to_numpy()) if x.is_valid else None for x in part.column("ids")]
                columns = part.columns
                columns[part.schema.get_field_index(name)] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return run


def decode(encoded: DataFrame, path: str, name: str = "text") -> DataFrame:
    """`encoded` with the text of its `ids` in the column `name`."""
    out = encoded.withColumn(name, F.lit(None).cast("string"))
    return out.mapInArrow(_decode(path, name), out.schema)


def encoded_documents(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """`columns` of every document, n_tokens, ids, decoded_sha256 and exact: whether decoding gives the text back."""
    both = decode(encode(docs.select(*columns, "text"), path), path, "decoded")
    text = F.coalesce(F.col("text"), F.lit(""))
    return both.select(*columns, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == text).alias("exact"))
