"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, beside a unigram base.

Tokens are the words of the text (A-Z in lower case) and one end. Words are told apart by 64-bit hashes:
of V distinct words V**2 / 2**65 pairs are expected to be taken for one.

Counts: every training token is counted, in the tasks first and then by aggregation, and the counts are
written to the shared folder. The most frequent words, at most HOT (by a threshold on the count, found from a histogram of at most
a few hundred rows), are broadcast; occurrences of the others are counted per document and joined with the counts.

Model: the prediction from a context is h = c1*r[previous] + c2*r[before it] + c3*mean of r over the last SPAN
words (elementwise products), and the score of class y is h.q[y] + b[y]. Classes are the OUT most frequent words and
one class for all others; a word of that class has its smoothed unigram share in it. r has a row for each of the CONTEXT
most frequent words, one for other words and one for the start of a text. Training is noise-contrastive: a word against
NOISE words drawn from the unigram distribution; b starts at log unigram. Every training text is used once, in ROUNDS parts: in
each round the tasks start from the same parameters, run over their own texts, and their parameters are averaged,
row by row, weighted by how often a task met the row. Averages are sums of integers, so they
don't depend on the order of tasks. Scoring takes matrix products of all contexts of a batch with all q, so
that probabilities sum to one. What the driver holds are the hot words and the parameters, a few MB at any size of the corpus.

Defined results: null and empty texts are one end token. Rows are scored each by itself, repeated or not (single precision: scores of equal texts agree to six digits). A null
doc_id is that of the empty text in crc32. Without training rows N and V are 0, base_score is 0, and the model is uniform
over the end and one other class. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import split_small, stage
from plumbline.llm.words import LOWER, NOT_SPACE, U64, pieces, spans, text_bytes, word_hashes

HOT = 1 << 18  # words in a task's table, at most
CONTEXT = 1 << 14  # words with an own context row
OUT = 256  # words with an own output row
WIDTH = 16  # of the embeddings
SPAN = 16  # words of the averaged context
NOISE = 32
ROUNDS = 4
STEP = 2048  # tokens of a step of training, and of a product in scoring
RATE = 0.2
END = 0x656E64  # the end token's hash
UNIT = 1 << 24  # averages are taken over multiples of 1 / UNIT


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 1


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each text, and the number of tokens of each."""
    raw, at = text_bytes(texts)
    raw = LOWER[raw]
    starts, ends, text = spans(raw, at, NOT_SPACE)
    n = np.bincount(text, minlength=len(texts)) + 1
    out = np.full(n.sum(), END, U64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = word_hashes(raw, starts, ends)
    return out, n


# --- counts


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, n = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(words, kind="stable")
    words, n = words[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    return words[first], np.add.reduceat(n, first)


def _count(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Counts by word, of all the task's texts or of as many as fit."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        words, n = parts.pop()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "c"])

    for piece in pieces(batches):
        parts.append(np.unique(token_hashes(piece.column("text"))[0], return_counts=True))
        if sum(len(w) for w, _ in parts) > most:
            parts = [_merged(parts)]
            if len(parts[0][0]) > most // 2:
                yield sent()
    if parts:
        parts = [_merged(parts)]
        yield sent()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and c of all tokens of the documents, in the shared folder."""
    return stage(split_small(docs.select("text")).mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")))


class Words:
    """The hot words by rank (the end is rank 0), their counts, and the corpus's totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, out: int = OUT):
        order = np.lexsort((words, -counts, words != END))
        words, counts = words[order], counts[order]
        if not len(words) or words[0] != END:
            words, counts = np.concatenate(([U64(END)], words)), np.concatenate(([0], counts))
        self.tokens, self.distinct, self.counts = tokens, distinct, counts.astype(np.int64)
        by_hash = np.argsort(words)
        self.keys, self.ranks = words[by_hash], by_hash.astype(np.int32)
        self.out = min(out, len(words))
        own = self.counts[: self.out]
        self.other_tokens, self.other_words = tokens - int(own.sum()), distinct - int((own > 0).sum())
        classes = np.append(own, self.other_tokens) + 0.5
        self.unigram = classes / classes.sum()
        self.log_count = np.log10(self.counts + 0.5)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "first"}

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 for those that are not hot."""
        if "first" not in self.__dict__:
            self.first = np.searchsorted(self.keys, np.arange((1 << 18) + 1, dtype=U64)[:-1] << U64(46)).astype(np.int32)
            self.first = np.append(self.first, np.int32(len(self.keys)))
        slot = (hashes >> U64(46)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(hashes), -1, np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            same = self.keys[here] == hashes[todo]
            out[todo[same]] = self.ranks[here[same]]
            at[todo] = here + 1
            todo = todo[~same & (here + 1 < end[todo])]
        return out


def hot_words(counts: DataFrame, hot: int = HOT, out: int = OUT) -> Words:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    level = F.floor(F.log2("c") * 16)  # at most 16 * 63 levels
    steps = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    least, room = None, hot
    for r in steps:
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    chosen = counts.where((F.col("word") == END) | (level >= (least if least is not None else 1 << 20)))
    table = chosen.toArrow()  # hot + 1 rows at most
    return Words(table["word"].to_numpy().view(U64), table["c"].to_numpy(), total.n or 0, total.v, out)


# --- ranks of all tokens, written once


ENCODED = "row long, doc_id long, held_out boolean, ids array<int>, rare array<struct<word: long, n: int>>"


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for piece in pieces(batches):
            hashes, n = token_hashes(piece.column("text"))
            ids = shared.value.rank(hashes)
            text = np.repeat(np.arange(len(n)), n)
            far = np.flatnonzero(ids < 0)
            order = far[np.lexsort((hashes[far], text[far]))]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order))).astype(np.int32)
            rare = pa.StructArray.from_arrays([pa.array(hashes[order[first]].view(np.int64)), pa.array(times)], ["word", "n"])
            cuts = np.searchsorted(text[order[first]], np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(len(n))), piece.column("doc_id"), piece.column("held_out"),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids)),
                    pa.ListArray.from_arrays(pa.array(cuts), rare),
                ],
                ["row", "doc_id", "held_out", "ids", "rare"],
            )
            row += len(n)

    return run


# --- the model


class Model:
    def __init__(self, words: Words, width: int = WIDTH, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.known = min(CONTEXT, len(words.counts))
        self.r = rng.normal(0, 0.1, (self.known + 2, width)).astype(np.float32)  # then: other words, start
        self.q = rng.normal(0, 0.1, (words.out + 1, width)).astype(np.float32)
        self.b = np.log(words.unigram).astype(np.float32)
        self.c = np.array([[1.0], [0.5], [1.0]], np.float32).repeat(width, 1)
        self.noise = words.unigram
        self.seen = {k: np.full(len(getattr(self, k)), 1e-1, np.float32) for k in "rqb"} | {"c": np.full(self.c.shape, 1e-1, np.float32)}

    def copy(self) -> Model:
        return deepcopy(self)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """The row of r of each rank; -2 is the start of a text."""
        return np.where((ids >= 0) & (ids < self.known), ids, np.where(ids == -2, self.known + 1, self.known))

    def contexts(self, s: Stretch) -> tuple[np.ndarray, ...]:
        """h of each target and what its gradient needs."""
        e = self.r[self.rows(s.ids)]
        total = np.concatenate((np.zeros((1, e.shape[1]), np.float32), np.cumsum(e, axis=0, dtype=np.float32)))
        mean = (total[s.at] - total[s.low]) / s.n[:, None]
        one, two = e[s.at - 1], e[s.at - 2] * s.second[:, None]
        return self.c[0] * one + self.c[1] * two + self.c[2] * mean, one, two, mean

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The logarithm of the probability of class y after each context h, over all classes."""
        scores = h @ self.q.T
        scores += self.b
        if np.sqrt(np.einsum("ij,ij->i", h, h).max() * np.einsum("ij,ij->i", self.q, self.q).max()) + np.abs(self.b).max() > 60:  # else no exponential leaves its range
            scores -= scores.max(axis=1)[:, None]
        own = scores[np.arange(len(y)), y].astype(np.float64)
        np.exp(scores, out=scores)
        return own - np.log(scores @ np.ones(scores.shape[1], np.float32))


class Stretch:
    """The targets from `low` to `high` of a run of texts; each text begins with -2."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int, high: int):
        cut = max(0, low - SPAN)
        self.ids = ids[cut:high]
        start = np.maximum(starts[cut:high] - cut, 0)
        self.end = np.minimum(ends[cut:high] - cut, high - cut - 1)
        self.at = low - cut + np.flatnonzero(ids[low:high] != -2)
        self.target = self.ids[self.at]
        self.low = np.maximum(start[self.at], self.at - SPAN)
        self.n = (self.at - self.low).astype(np.float32)
        self.second = (self.at - 2 >= start[self.at]).astype(np.float32)


def stretches(ids: pa.ListArray, step: int = STEP) -> Iterator[tuple[Stretch, np.ndarray]]:
    """The texts of a batch in stretches, with each target's text."""
    offsets = ids.offsets.to_numpy()
    n = np.diff(offsets) + 1
    firsts = np.cumsum(n) - n
    run = np.full(n.sum(), -2, np.int32)
    inner = np.ones(len(run), bool)
    inner[firsts] = False
    run[inner] = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    starts, ends, text = np.repeat(firsts, n), np.repeat(firsts + n - 1, n), np.repeat(np.arange(len(n)), n)
    for low in range(0, len(run), step):
        s = Stretch(run, starts, ends, low, min(low + step, len(run)))
        if len(s.at):
            yield s, text[max(0, low - SPAN) + s.at]


def _logistic(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -60, 60)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of their values, and how many there are."""
    order = np.argsort(keys, kind="stable")
    found, first, n = np.unique(keys[order], return_index=True, return_counts=True)
    return found, np.add.reduceat(values[order], first, axis=0), n


class Trainer:
    """Adagrad on the noise-contrastive loss, over the texts of one task."""

    def __init__(self, model: Model, rate: float, seed: tuple[int, ...]):
        self.m, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        self.met = {k: np.zeros(len(getattr(model, k)), np.int64) for k in "rq"}
        self.steps = 0
        self.edges = np.cumsum(model.noise)
        self.offset = np.log(NOISE * model.noise).astype(np.float32)

    def gradients(self, s: Stretch, noise: np.ndarray) -> dict:
        """For each parameter the rows and the gradients of the loss: minus the sum of log logistic(good) and log logistic(-bad)."""
        m = self.m
        h, one, two, mean = m.contexts(s)
        y = np.where((s.target >= 0) & (s.target < len(m.q) - 1), s.target, len(m.q) - 1)
        q_y, q_noise = m.q[y], m.q[noise]
        good = (h * q_y).sum(1) + m.b[y] - self.offset[y]
        bad = h @ q_noise.T + (m.b[noise] - self.offset[noise])
        up, down = -_logistic(-good), _logistic(bad)
        dh = up[:, None] * q_y + down @ q_noise
        de = np.zeros((len(s.ids), h.shape[1]), np.float32)
        de[s.at - 1] += m.c[0] * dh
        some = s.second > 0
        de[s.at[some] - 2] += m.c[1] * dh[some]
        part = np.zeros_like(de)
        part[s.at] = m.c[2] * dh / s.n[:, None]
        total = np.concatenate((np.zeros((1, h.shape[1]), np.float32), np.cumsum(part, axis=0, dtype=np.float32)))
        here = np.arange(len(s.ids))
        de += total[np.minimum(here + SPAN, s.end) + 1] - total[here + 1]
        keys = np.concatenate((y, noise))
        return {
            "r": (m.rows(s.ids), de),
            "q": (keys, np.concatenate((up[:, None] * h, down.T @ h))),
            "b": (keys, np.concatenate((up, down.sum(0)))),
            "c": np.stack([(dh * x).sum(0) for x in (one, two, mean)]),
        }

    def step(self, s: Stretch) -> None:
        noise = np.searchsorted(self.edges, self.rng.random(NOISE) * self.edges[-1], side="right").clip(max=len(self.edges) - 1)
        g = self.gradients(s, noise)
        for name in "rqb":
            rows, grad, n = _sums(*g[name])
            seen = self.m.seen[name]
            seen[rows] += grad**2 if grad.ndim == 1 else np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
            pace = self.rate / np.sqrt(seen[rows])
            getattr(self.m, name)[rows] -= (pace if grad.ndim == 1 else pace[:, None]) * grad
            if name in self.met:
                self.met[name][rows] += n
        self.m.seen["c"] += g["c"] ** 2
        self.m.c -= 0.1 * self.rate * g["c"] / np.sqrt(self.m.seen["c"])
        self.steps += 1

    def weighted(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each table of `packed`: its number, rows, weights and values times UNIT."""
        once = np.full(3, self.steps)
        for k, (values, n) in enumerate(zip(packed(self.m), (self.met["r"], self.met["q"], once, once))):
            rows = np.flatnonzero(n)
            weight = np.minimum(n[rows], 1 << 15)
            yield k, rows, weight, np.rint(np.clip(values[rows], -1e3, 1e3) * UNIT).astype(np.int64) * weight[:, None]


def packed(m: Model) -> list[np.ndarray]:
    """All that is averaged, in tables of width + 3 columns: r, q with b, c, and logarithms of Adagrad's sums."""
    out = []
    for parts in ((m.r, None, m.seen["r"], None), (m.q, m.b, m.seen["q"], m.seen["b"]), (m.c, None, None, None), (np.log(m.seen["c"]), None, None, None)):
        wide = np.zeros((len(parts[0]), m.q.shape[1] + 3))
        wide[:, :-3] = parts[0]
        for i, x in enumerate(parts[1:]):
            if x is not None:
                wide[:, i - 3] = np.log(x) if i else x
        out.append(wide)
    return out


def unpacked(m: Model, tables: list[np.ndarray]) -> None:
    """Takes the parameters from such tables."""
    r, q, c, seen_c = (t.astype(np.float32) for t in tables)
    m.r, m.q, m.b, m.c = r[:, :-3].copy(), q[:, :-3].copy(), q[:, -3].copy(), c[:, :-3].copy()
    m.seen = {"r": np.exp(r[:, -2]), "q": np.exp(q[:, -2]), "b": np.exp(q[:, -1]), "c": np.exp(seen_c[:, :-3])}


def train(encoded: DataFrame, words: Words, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    spark, model = encoded.sparkSession, Model(words)
    names = [f"v{i}" for i in range(model.q.shape[1] + 3)]
    texts = encoded.where(~F.col("held_out"))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            work = Trainer(shared.value.copy(), rate, (turn, TaskContext.get().partitionId()))
            for batch in batches:
                for s, _ in stretches(batch.column("ids")) if batch.num_rows else ():
                    work.step(s)
            for k, rows, weight, values in work.weighted():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(rows.astype(np.int32)), pa.array(weight), *(pa.array(v) for v in values.T)], ["part", "at", "n", *names])

        mine = split_small(texts.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn).select("ids"))
        sent = mine.mapInArrow(run, "part int, at int, n long, " + ", ".join(f"{v} long" for v in names))
        table = sent.groupBy("part", "at").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in names)).toArrow()  # one row a row of the parameters
        shared.destroy()
        if table.num_rows:
            part, at, n = (table[c].to_numpy() for c in ("part", "at", "n"))
            mean = np.stack([table[v].to_numpy() for v in names], 1) / n[:, None] / UNIT
            tables = packed(model)
            for k, values in enumerate(tables):
                values[at[part == k]] = mean[part == k]
            unpacked(model, tables)
    return model


# --- scores


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_hot long, n_other long, base double, model double"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("ids")
            scores, others = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for s, text in stretches(column):
                y = np.where((s.target >= 0) & (s.target < words.out), s.target, words.out)
                scores += np.bincount(text, model.log_probability(model.contexts(s)[0], y), len(scores))
                others += np.bincount(text[y == words.out], minlength=len(others))
            offsets = column.offsets.to_numpy()
            n = np.diff(offsets).astype(np.int64)
            flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            text = np.repeat(np.arange(len(n)), n)
            hot = flat >= 0
            known = hot & (words.counts[flat] > 0)
            base = np.bincount(text[hot], words.log_count[flat[hot]], len(n))
            far = hot & (flat >= words.out)
            inside = np.bincount(text[far], words.log_count[flat[far]], len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(np.bincount(text[known], minlength=len(n))), pa.array(others), pa.array(base), pa.array(scores / np.log(10) + inside)],
                [c.split()[0] for c in SCORED.split(", ")],
            )

    return run


def lm_scores(docs: DataFrame, folds: int = 5, hot: int = HOT, out: int = OUT, rounds: int = ROUNDS, rate: float = RATE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document (columns doc_id and text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), folds).alias("held_out"))
    counts = word_counts(rows.where(~F.col("held_out")))
    words = hot_words(counts, hot, out)
    context = docs.sparkSession.sparkContext
    encoded = stage(split_small(rows).mapInArrow(_encode(context.broadcast(words)), ENCODED))
    model = train(encoded, words, rounds, rate)
    scored = encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(_score(context.broadcast((model, words))), SCORED)
    rare = encoded.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n").join(counts, "word", "left")
    sums = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_base"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_rare"),
    )
    whole, inside = words.tokens + 0.5 * (words.distinct + 1), words.other_tokens + 0.5 * (words.other_words + 1)
    far = F.coalesce("rare_base", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + far - F.col("n_tokens") * float(np.log10(whole))).alias("base_score"),
        (F.col("model") + far - F.col("n_other") * float(np.log10(inside))).alias("score"),
    )
