"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text in lower case is the bag of the character 3- to 6-grams of its words
(word ends are part of them), so that an unseen misspelling shares most of its
grams with the word. Grams are hashed to `buckets` embeddings of `width` numbers;
a passage is the mean of its grams' embeddings, and a linear softmax over two
classes is trained together with the embeddings by Adagrad. A document is cut
into passages of `passage` grams, and its class scores are those of its most toxic
passage: in training the gradient flows through that passage (multiple-instance
learning), so one insult in a long text is not averaged away.

Training rows are a bounded sample of the labelled rows that are not held out:
up to `max_rows` of each class, the first by a hash of doc_id, and of each at most
`max_passages` evenly spaced passages; these reach the driver. The model is one number a
bucket once the product of embeddings and softmax is taken, and is broadcast.
Every text is scored whole.

Defined results: null and empty texts have no grams and get the model's bias as
score. Rows of equal doc_id are scored each by itself; null doc_ids are held out
as the crc32 of the empty text says. Without a labelled row every score is 0.5. Labels,
lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import split_small
from plumbline.llm.words import U64, mix, pieces

SIZES = (3, 4, 5, 6)
PASSAGE = 256  # characters
BITS = 18
#: The internal column of scores; other columns of the documents pass through.
SCORE = "_plumbline_score"


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case (0 for what is not part of a word), each text between two zeros."""
    lowered = [(t or "").lower() for t in texts]
    raw = ("\0" + "\0\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass") if texts else b""
    codes = np.frombuffer(raw, np.uint32)
    word = (codes >= 0x80) | ((codes >= 0x30) & (codes <= 0x39)) | ((codes >= 0x61) & (codes <= 0x7A))
    ends = np.cumsum([len(t) + 2 for t in lowered]) if texts else np.zeros(0, np.int64)
    return np.where(word, codes, 0), ends


def gram_buckets(codes: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: where a gram begins and its bucket."""
    value = mix(codes.astype(U64) + U64(1))
    outside = np.concatenate(([0], np.cumsum(codes == 0)))
    total = value.copy()
    base, power = 0x9E3779B97F4A7C15, 1
    for k in range(1, max(SIZES)):
        power = power * base % (1 << 64)
        total = total[: len(value) - k] + value[k:] * U64(power)
        size = k + 1
        if size in SIZES:
            at = np.flatnonzero(outside[size - 1 : len(codes)][: len(total)] == outside[1 : len(total) + 1])
            yield at, (mix(total[at]) >> U64(64 - bits)).astype(np.int32)


def passages(ends: np.ndarray) -> np.ndarray:
    """First code of each passage: every text is cut evenly into passages of about PASSAGE characters."""
    starts = np.concatenate(([0], ends[:-1]))
    count = np.maximum(1, np.round((ends - starts) / PASSAGE).astype(np.int64))
    text = np.repeat(np.arange(len(ends)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return starts[text] + nth * (ends - starts)[text] // count[text], text


def passage_scores(codes: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean weight of the grams of each passage, and the passage's text."""
    first, text = passages(ends)
    sums, counts = np.zeros(len(first)), np.zeros(len(first), np.int64)
    for at, bucket in gram_buckets(codes):
        cut = np.searchsorted(at, np.append(first, len(codes)))
        total = np.concatenate(([0.0], np.cumsum(weights[bucket], dtype=np.float64)))
        sums += total[cut[1:]] - total[cut[:-1]]
        counts += np.diff(cut)
    return sums / np.maximum(counts, 1), text


class Model:
    """buckets x width embeddings and a softmax of two classes over their mean, trained jointly."""

    def __init__(self, width: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.table = rng.uniform(-0.5, 0.5, (1 << BITS, width)).astype(np.float32) / width
        self.soft = rng.uniform(-0.5, 0.5, (width, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def weights(self) -> tuple[np.ndarray, float]:
        """What one gram adds to the log-odds, and the bias."""
        return (self.table @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])

    def fit(self, bags: list[list[np.ndarray]], labels: np.ndarray, epochs: int, rate: float, seed: int = 0) -> None:
        """bags: per document its passages, each the buckets of its grams."""
        rng = np.random.default_rng(seed)
        g_table, g_soft, g_bias = np.full(len(self.table), 1e-8, np.float32), np.full(self.soft.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
        weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))  # classes count alike
        for _ in range(epochs):
            for d in rng.permutation(len(bags)):
                means = [self.table[bucket].mean(0) for bucket in bags[d]]
                if not means:
                    continue
                most = int(np.argmax([x @ (self.soft[:, 1] - self.soft[:, 0]) for x in means]))
                bucket, mean = bags[d][most], means[most]
                logits = mean @ self.soft + self.bias
                p = np.exp(logits - logits.max())
                error = (p / p.sum() - np.eye(2, dtype=np.float32)[labels[d]]) * np.float32(weight[labels[d]])
                down = self.soft @ error / len(bucket)
                soft = np.outer(mean, error)
                g_soft += soft**2
                g_bias += error**2
                self.soft -= rate * soft / np.sqrt(g_soft)
                self.bias -= rate * error / np.sqrt(g_bias)
                g_table[bucket] += down @ down
                self.table[bucket] -= (rate / np.sqrt(g_table[bucket]))[:, None] * down


def bags(text: str) -> list[np.ndarray]:
    """The buckets of the grams of each passage that has any."""
    codes, ends = _codes([text])
    first, _ = passages(ends)
    grams = list(gram_buckets(codes))
    cuts = [np.searchsorted(at, np.append(first, len(codes))) for at, _ in grams]
    rows = [np.concatenate([bucket[c[k] : c[k + 1]] for (_, bucket), c in zip(grams, cuts)]) for k in range(len(first))] if grams else []
    return [r for r in rows if len(r)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _excerpt(most: int):
    """Texts of more than `most` passages keep that many, evenly spaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = []
            for t in piece.column("text").to_pylist():
                n = max(1, round(len(t) / PASSAGE))
                if n > most:
                    at = np.linspace(0, n - 1, most).round().astype(int) * PASSAGE
                    t = "\n".join(t[a : a + PASSAGE] for a in at)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.string()), piece.column("toxic")], ["doc_id", "text", "toxic"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_passages: int):
    """Up to max_rows labelled, not held out rows of each class, in the order of a hash of doc_id."""
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = labelled.where(~held_out(F.col("doc_id")))
    drawn = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * max_rows rows at most
    found = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id")
    one = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    return sorted(one.mapInArrow(_excerpt(max_passages), "doc_id long, text string, toxic int").collect())


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2000, max_passages: int = 64, epochs: int = 8, rate: float = 0.1, width: int = 4) -> tuple[np.ndarray, float]:
    """The weight of each gram bucket in the log-odds, and the bias."""
    rows = training_rows(docs, labels, max_rows, max_passages)
    model = Model(width)
    if rows:
        model.fit([bags(r.text) for r in rows], np.array([r.toxic for r in rows]), epochs, rate)
        return model.weights()
    return np.zeros(1 << BITS, np.float32), 0.0


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for piece in pieces(batches, 1 << 18):
            codes, ends = _codes(piece.column("text").to_pylist())
            means, text = passage_scores(codes, ends, weights)
            top = np.full(piece.num_rows, -np.inf)
            np.maximum.at(top, text, means)
            at = piece.schema.get_field_index(SCORE)
            columns = piece.columns
            columns[at] = pa.array(1 / (1 + np.exp(-(top + bias))))
            yield pa.RecordBatch.from_arrays(columns, piece.schema.names)

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """`docs` with the column SCORE, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket
    out = split_small(docs).withColumn(SCORE, F.lit(None).cast("double"))
    return out.mapInArrow(_score(shared), out.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **fit))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """The documents that score below the threshold, unchanged."""
    return score(docs, train(docs, labels, **fit)).where(F.col(SCORE) < threshold).drop(SCORE)
