"""Hard-negative mining by coordinate pruning: exact top-k under score windows, after the manner of LEMP.

Index: rows are ordered by length and cut into buckets of at most ROWS vectors of nearly equal
length. A bucket holds, for each coordinate, its vectors in ascending order of that coordinate of
the unit vectors (sorted lists). The index covers every row and is written once to the shared folder.

Search: an anchor q that needs scores of at least t looks at a bucket whose longest vector is l
with the local threshold t / (|q| l). Beyond 1 the bucket is passed over. Else, for each focus coordinate f (those
of the largest |q_f| / |q|), only vectors p with
q_f p_f + sqrt(1 - q_f**2) sqrt(1 - p_f**2) >= threshold can reach it, which is a range of p_f and so a
stretch of the sorted list. Candidates are the vectors in the stretches of all focus coordinates; their inner
products are taken exactly in integers. t is the lower end of the anchor's window, or the score of its
k-th best so far: it starts from a search of a few buckets and rises in the task's own buckets.

Anchors are packed in blocks, and each block meets each group of buckets once, in a join on the group: a
row of the join holds one block and one bucket, a few MB whatever the table. Each task sends at most k rows
a window on; they are merged by a ranking per anchor and window.

Defined results: rows with a null vec_id, label or vector or a null or non-finite component take no part. Vectors of
unequal size are filled up with zeros. Repeated rows of one vec_id are rows of their own (as positives and
negatives they are listed as often as they occur, and neither is a row of the anchor's own id); an anchor id
that occurs several times is one anchor, of the least label and vector. Components beyond a long are held there; inner
products beyond a long wrap around. Anchors without positives, and positives without negatives, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.tables import bound_batches, stage

ROWS = 2048  # vectors of a bucket
GROUP = 8  # buckets that meet a block in one task
BLOCK = 256  # anchors of a block, about
FOCUS = 3  # coordinates intersected
SEEDS = 2  # buckets searched first, about
INDEX = "bucket long, n int, width int, longest double, ids binary, labels binary, components binary, lists binary"
FOUND = "anchor_id long, slot int, score long, vec_id long"


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, components (integers) of the rows that take part."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole)
    return kept.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("components"),
    )


def rectangle(lists: pa.Array) -> np.ndarray:
    """The lists as rows of one matrix, filled up with zeros."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    counts = np.diff(offsets)
    width = max(1, int(counts.max()))
    if (counts == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width).astype(np.int64)
    out = np.zeros((len(counts), width), np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], counts)] = flat[offsets[0] : offsets[-1]]
    return out


def lengths(components: np.ndarray) -> np.ndarray:
    return np.sqrt((components.astype(np.float64) ** 2).sum(1))


def unit(components: np.ndarray) -> np.ndarray:
    return components / np.maximum(lengths(components), 1e-300)[:, None]


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending order of length: a row for each ROWS of them."""
    from pyspark import TaskContext

    first, held, rows = TaskContext.get().partitionId() << 32, [], 0

    def row(table: pa.Table) -> pa.RecordBatch:
        nonlocal first
        table = table.combine_chunks()
        components = rectangle(table.column("components").chunk(0))
        lists = np.argsort(unit(components), axis=0, kind="stable").astype(np.uint16).T
        small = components.astype(np.int32)
        packed = small if (small == components).all() else components
        first += 1
        values = [
            first - 1, len(components), components.shape[1], float(lengths(components).max()), table.column("vec_id").to_numpy().tobytes(),
            table.column("label").to_numpy().tobytes(), packed.tobytes(), np.ascontiguousarray(lists).tobytes(),
        ]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in INDEX.split(", ")])

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, ROWS - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == ROWS:
                yield row(pa.Table.from_batches(held))
                held, rows = [], 0
    if rows:
        yield row(pa.Table.from_batches(held))


def build_index(rows: DataFrame) -> DataFrame:
    """One row a length bucket, in the shared folder."""
    length = F.aggregate("components", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    ordered = rows.withColumn("length", length).repartitionByRange(F.col("length").desc(), "vec_id").sortWithinPartitions(F.col("length").desc())
    return stage(ordered.drop("length").mapInArrow(_bucket, INDEX))


class Bucket:
    """A row of the index as arrays."""

    def __init__(self, row: dict):
        n, width = row["n"], row["width"]
        self.longest = row["longest"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.components = np.frombuffer(row["components"], np.int32 if len(row["components"]) == 4 * n * width else np.int64).reshape(n, width)
        self.exact = self.components.astype(np.float64)
        self.most = float(np.abs(self.exact).max())
        self.lists = np.frombuffer(row["lists"], np.uint16).reshape(width, n)
        self.sorted = np.take_along_axis(unit(self.components).T, self.lists.astype(np.int64), axis=1)

    def candidates(self, q: np.ndarray, length: float, low: int) -> np.ndarray | None:
        """Rows that may have an inner product of `low` or more with q; None: all of them."""
        if low <= 0 or not length or not self.longest:
            return np.zeros(0, np.int64) if low > 0 else None
        threshold = low / (length * self.longest) - 1e-9
        if threshold > 1:
            return np.zeros(0, np.int64)
        u = q / length
        counts, used = np.zeros(len(self.ids), np.uint8), 0
        for f in np.argsort(-np.abs(u[: len(self.sorted)]))[:FOCUS]:
            c = float(np.clip(u[f], -1, 1))
            spread = float(np.sqrt(max(0.0, (1 - threshold * threshold) * (1 - c * c))))
            # beyond +-threshold a coordinate of q leaves its own end of the range open
            least = -1.0 if c <= -threshold else c * threshold - spread
            most = 1.0 if c >= threshold else c * threshold + spread
            a, b = np.searchsorted(self.sorted[f], (least - 1e-9, most + 1e-9))
            counts[self.lists[f, a:b]] += 1
            used += 1
        return np.flatnonzero(counts == used)

    def products(self, q: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        """Exact inner products with the rows at `at`."""
        width = min(len(q), self.components.shape[1])
        q = q[:width]
        if self.most * float(np.abs(q).max(initial=0)) * width < 2.0**53:
            m = self.exact if at is None else self.exact[at]
            return (m[:, :width] @ q.astype(np.float64)).astype(np.int64)
        m = self.components if at is None else self.components[at]
        return m[:, :width].astype(np.int64) @ q


class Search:
    """The best k rows of each window of each anchor of a block, over the buckets that come along."""

    def __init__(self, anchors: list[dict], same_label: bool, k: int):
        self.k, self.same = k, same_label
        self.anchors = [(a["anchor_id"], a["label"], q := np.array(a["components"] or [0], np.int64), float(lengths(q[None, :])[0])) for a in anchors]
        self.windows = [[[w["slot"], w["low"], w["high"], np.zeros(0, np.int64), np.zeros(0, np.int64)] for w in a["windows"] if w["low"] <= w["high"]] for a in anchors]

    def meet(self, bucket: Bucket) -> None:
        for (own, label, q, length), windows in zip(self.anchors, self.windows):
            if not windows:
                continue
            low, high = min(w[1] for w in windows), max(w[2] for w in windows)
            at = bucket.candidates(q, length, low)
            if at is not None and not len(at):
                continue
            scores = bucket.products(q, at)
            labels, ids = (bucket.labels, bucket.ids) if at is None else (bucket.labels[at], bucket.ids[at])
            fits = (scores >= low) & (scores <= high) & ((labels == label) == self.same) & (ids != own)
            scores, ids = scores[fits], ids[fits]
            for w in windows if len(scores) else ():
                inside = (scores >= w[1]) & (scores <= w[2])
                if inside.any():
                    self._take(w, scores[inside], ids[inside])

    def _take(self, w: list, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((w[3], scores)), np.concatenate((w[4], ids))
        if len(scores) > 4 * self.k:
            worth = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[worth], ids[worth]
        best = np.lexsort((ids, -scores))[: self.k]
        w[3], w[4] = scores[best], ids[best]
        if len(best) == self.k:
            w[1] = max(w[1], int(w[3][-1]))

    def found(self) -> pa.RecordBatch:
        rows = [(own, w[0], s, i) for (own, *_), windows in zip(self.anchors, self.windows) for w in windows for s, i in zip(w[3].tolist(), w[4].tolist())]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in FOUND.split(", ")])


def search(index: DataFrame, groups: int, anchors: DataFrame, blocks: int, same_label: bool, k: int) -> DataFrame:
    """The k best rows of each window: anchors has anchor_id, label, components and windows of (slot, low, high).

    A block's rows of the join follow one another as long as the block is the streamed side; should they
    not, the block begins anew and only more rows are sent on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, work = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                key = (one.column("group")[0].as_py(), one.column("block")[0].as_py())
                if key != now:
                    if work:
                        yield work.found()
                    now, work = key, Search(one.column("anchors")[0].as_py(), same_label, k)
                work.meet(Bucket(one.select([c.split()[0] for c in INDEX.split(", ")]).to_pylist()[0]))
        if work:
            yield work.found()

    packed = anchors.groupBy(F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("anchor_id", "label", "components", "windows")).alias("anchors"))
    met = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).hint("merge")
    pairs = met.join(index.withColumn("group", F.pmod(F.xxhash64("bucket"), F.lit(groups)).cast("int")), "group")
    return best(pairs.mapInArrow(run, FOUND), k)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _windows(*parts: Column) -> Column:
    return F.struct(*(p.cast("long").alias(n) for p, n in zip(parts, ("slot", "low", "high"))))


def mine(vectors: DataFrame, every: int = 100, noisy: int | None = 7, classes: int = 10, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and the two scores; positive_rank tells the positives of an anchor apart.

    Anchors are the rows whose vec_id `every` divides. Where `noisy` divides vec_id the label first becomes
    (label + 1) % classes. A negative's score lies within `share` percent of its positive's and that score.
    """
    bound_batches(vectors.sparkSession)
    rows = usable(vectors, scale)
    if noisy:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % noisy == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")))
    index = build_index(rows)
    buckets = index.count()
    groups = max(1, -(-buckets // GROUP))
    seeds = index.where(F.pmod(F.xxhash64("bucket", F.lit(1)), F.lit(max(1, buckets // SEEDS))) == 0)
    own = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "components")).alias("row"))
    anchors = stage(own.select("anchor_id", "row.label", "row.components"))
    blocks = max(1, -(-anchors.count() // BLOCK))

    def closest(windowed: DataFrame, same_label: bool, k: int) -> DataFrame:
        """Searched in the seeds for a lower end first, then in all buckets."""
        known = search(seeds, 1, windowed, blocks, same_label, k).where(F.col("place") == k).select("anchor_id", F.col("slot").cast("long").alias("slot"), F.col("score").alias("kth"))
        parts = windowed.select("anchor_id", "label", "components", F.explode("windows").alias("w")).select("anchor_id", "label", "components", "w.*")
        raised = parts.join(known, ["anchor_id", "slot"], "left").withColumn("low", F.greatest("low", "kth"))
        again = raised.groupBy("anchor_id").agg(F.first("label").alias("label"), F.first("components").alias("components"), F.collect_list(_windows(F.col("slot"), F.col("low"), F.col("high"))).alias("windows"))
        return stage(search(index, groups, again, blocks, same_label, k))

    everything = F.array(_windows(F.lit(0), F.lit(-(1 << 63)), F.lit((1 << 63) - 1)))
    near = closest(anchors.withColumn("windows", everything), True, positives)
    least = F.ceil((F.col("score").cast("decimal(30,0)") * share / F.lit(100).cast("decimal(3,0)"))).cast("long")
    spans = near.groupBy("anchor_id").agg(F.collect_list(_windows(F.col("place"), least, F.col("score"))).alias("windows"))
    hard = closest(anchors.join(spans, "anchor_id"), False, negatives)
    chosen = near.select("anchor_id", F.col("place").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(hard.withColumnRenamed("slot", "positive_rank"), ["anchor_id", "positive_rank"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"), F.col("positive_rank").cast("int").alias("positive_rank"),
    )


ORACLE = """
with kept as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as l,
    list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as materialized (
  select a.vec_id a, b.vec_id b, a.l = b.l same, list_inner_product(a.v, b.v)::bigint s
  from kept a join kept b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
near as (
  select a, b, s, row_number() over (partition by a order by s desc, b) place from scored where same qualify place <= 5)
select near.a as anchor_id, near.b as positive_id,
  (row_number() over (partition by near.a, near.place order by o.s desc, o.b))::int as "rank",
  o.b as negative_id, near.s as positive_score, o.s as negative_score, near.place::int as positive_rank
from near join scored o on o.a = near.a and not o.same and 80 * near.s <= 100 * o.s and o.s <= near.s
qualify "rank" <= 5
"""
