"""Near-dedup by Order MinHash, verified by banded alignment.

Texts are word sequences; a k-mer is `k` words in a row (a shorter text is one
k-mer). Equal texts are one node from the start. For each of `sketches`
hash functions a node's k-mers, labelled with their occurrence number, are ranked, and
the `picks` least are kept in text order: two texts share the sketch if they
hold the same least k-mers in the same order, which favours texts at a small
edit distance. Nodes with an equal sketch form a bucket.

Buckets are resolved in rounds. First every member is compared with the bucket's center,
the node with the most company. Then a sixteenth of the nodes, and at last all of them, are held
against all members of another class: a bucket's members lie in blocks of about `block`
nodes, and a row holds two blocks with a bit map of each node's k-mers; a bucket of more than `dealt`
nodes is dealt over tasks by pairs of its parts. A bit of one
map only is a k-mer of one text only, which bounds the similarity from above; texts are fetched
for the pairs whose bound reaches the threshold. So at the end no two nodes of one
bucket are in two classes without having been compared, and a class that fills blocks of its own is not held
against itself. Two texts at the threshold share about eight of twenty sketches.

A pair is similar if the Jaccard similarity of its k-mer sets is `similar` or
more. Banded alignment verifies it: d edits change k * d k-mers at most, so an edit
distance within a band of (1 - s) / (1 + s) / k of the k-mers proves it; pairs outside the
band get the exact comparison of the sets.

Defined results: null and empty texts are one class. Texts without words are
similar to equal texts only. Rows of equal doc_id are rows of their own. A class id is the
least doc_id of the class (null where it has none). Other columns are ignored, or pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.tables import split_small, stage

NODE = "_plumbline_node"
MAP_BITS = 2048
#: Edges that a task joins in its memory.
EDGES = 1 << 17


def node_of(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    return W.windows(hashes, min(k, len(hashes))) if len(hashes) else hashes


def order_sketches(grams: np.ndarray, factors: np.ndarray, picks: int) -> np.ndarray:
    """One 64-bit sketch for each hash function."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    if first.all():
        labelled = grams
    else:
        at = np.flatnonzero(first)
        nth = np.arange(len(grams)) - at[np.cumsum(first) - 1]
        labelled = np.empty_like(grams)
        labelled[order] = W.mix(ranked + nth.astype(W.U64) * W.U64(0x9E3779B97F4A7C15))
    step = max(1, (1 << 19) // len(grams))
    out = []
    for low in range(0, len(factors), step):
        rank = labelled * factors[low : low + step, None]
        if len(grams) > picks:
            least = np.sort(np.argpartition(rank, picks - 1, axis=1)[:, :picks], axis=1)
        else:
            least = np.broadcast_to(np.arange(len(grams)), (len(rank), len(grams)))
        total = np.zeros(len(rank), W.U64)
        for column in least.T:
            total = W.mix(total * W.U64(0xF1357AEA2E62A9C5) + grams[column])
        out.append(total)
    return np.concatenate(out)


def _sketch(k: int, sketches: int, picks: int):
    factors = W.mix(np.arange(1, sketches + 1, dtype=W.U64) * W.U64(0xD1342543DE82EF95)) | W.U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in W.pieces(batches):
            raw, at = W.text_bytes(piece.column("text"))
            starts, ends, doc = W.spans(raw, at, W.NOT_SPACE)
            hashes = W.word_hashes(raw, starts, ends)
            first = np.searchsorted(doc, np.arange(len(at)))
            rows = np.flatnonzero(np.diff(first))
            if not len(rows):
                continue
            found = np.concatenate([order_sketches(kmers(hashes[first[d] : first[d + 1]], k), factors, picks) for d in rows.tolist()])
            yield pa.RecordBatch.from_arrays(
                [piece.column("node").take(pa.array(np.repeat(rows, sketches))), pa.array(np.tile(np.arange(sketches, dtype=np.int16), len(rows))), pa.array(found.view(np.int64))],
                ["node", "fn", "sketch"],
            )

    return run


def buckets(docs: DataFrame, k: int, sketches: int, picks: int) -> DataFrame:
    """node, fn, sketch and size (rows of the bucket) where a bucket has two nodes or more."""
    rows = split_small(docs.select(node_of(F.col("text")).alias("node"), "text"))
    rows = stage(rows.mapInArrow(_sketch(k, sketches, picks), "node binary, fn short, sketch long"))
    key = ["fn", "sketch"]
    sizes = rows.groupBy(*key).agg(F.min(F.xxhash64("node")).alias("a"), F.max(F.xxhash64("node")).alias("b"), F.count("*").alias("size")).where("a < b").drop("a", "b")
    return stage(rows.join(sizes, key).groupBy(*key, "node").agg(F.max("size").alias("size")))


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The edit distance of two sequences if it is at most `band`, else band + 1: furthest points on 2 * band + 1 diagonals."""
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return band + 1
    unequal: dict[int, np.ndarray] = {}

    def slide(i: int, k: int) -> int:
        if k not in unequal:
            low, high = max(0, -k), min(n, m - k)
            unequal[k] = np.append(np.flatnonzero(a[low:high] != b[low + k : high + k]) + low, high)
        miss = unequal[k]
        return max(i, int(miss[min(np.searchsorted(miss, i), len(miss) - 1)]))

    reach = {0: slide(0, 0)}
    for d in range(band + 1):
        if reach.get(m - n, -1) >= n:
            return d
        new = {}
        for k in range(-min(d + 1, band), min(d + 1, band) + 1):
            i = max(reach.get(k - 1, -1), reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i >= max(0, -k):
                new[k] = slide(i, k)
        reach = new
    return band + 1


def are_similar(a: np.ndarray, b: np.ndarray, k: int, similar: float) -> bool:
    """Of two texts' word hashes."""
    if not len(a) or not len(b):
        return False
    one, two = np.unique(kmers(a, k)), np.unique(kmers(b, k))
    few, many = sorted((len(one), len(two)))
    if few < similar * many:
        return False
    band = int((1 - similar) / (1 + similar) * few / k)
    # an edit takes one word away and adds one at most: with more words apart no alignment lies in the band
    if min(len(a), len(b)) >= k and len(np.setxor1d(a, b)) <= 2 * band and banded_distance(a, b, band) <= band:
        return True
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= similar * (few + many - both)


def _hashes(text: str) -> np.ndarray:
    raw, at = W.text_bytes(pa.array([text]))
    return W.word_hashes(raw, *W.spans(raw, at, W.NOT_SPACE)[:2])


def _verify(k: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            nodes = batch.column("a").to_pylist()
            ok = np.zeros(batch.num_rows, bool)
            for r, node in enumerate(nodes):
                if node != last:
                    last, held = node, _hashes(batch.column("text_a")[r].as_py())
                ok[r] = are_similar(held, _hashes(batch.column("text_b")[r].as_py()), k, similar)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the same components, each from a node to the least that `EDGES` edges in a row, or some more, join it to."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(parent)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in ([a for a, b in pairs if a != b], [b for a, b in pairs if a != b])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > 2 * EDGES:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser node, which has none."""
    ends = edges.select(F.col("a").alias("node"), "b").unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("binary").alias("b")))
    ends = ends.groupBy("node").agg(F.min("b").alias("x"), F.max("b").alias("y"), F.bool_or(F.col("b").isNull()).alias("root"))
    return ends.where("x != y or x is not null and root").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and class (the component's least node) of every other node of the edges (a, b).

    Tasks join what meets in them, `EDGES` edges each; where that takes more tasks than one, large-star and small-star
    rounds follow until nothing is left to join.
    """
    joined = lambda rows: stage(rows.mapInArrow(_forests, "a binary, b binary"))
    edges = joined(edges.select("a", "b").where("a != b"))
    tasks = -(-edges.count() // EDGES)
    if tasks <= 1:
        return joined(edges.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("class"))
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = joined(small)
    return stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("class")))


def _marks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, maps = [], []
            for text in batch.column("text"):
                grams = np.unique(kmers(_hashes(text.as_py()), k))
                bits = np.zeros(MAP_BITS, bool)
                bits[(W.mix(grams) % W.U64(MAP_BITS)).astype(np.int64)] = True
                counts.append(len(grams))
                maps.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(counts, pa.int32()), pa.array(maps, pa.binary())], ["node", "n", "bits"])

    return run


def may_be_similar(n_a: np.ndarray, bits_a: np.ndarray, n_b: np.ndarray, bits_b: np.ndarray, similar: float) -> np.ndarray:
    """For each node of a and each of b: whether the maps leave room for the similarity. Never false for similar texts."""
    only_a = np.bitwise_count(bits_a[:, None] & ~bits_b[None]).sum(axis=2, dtype=np.int64)
    only_b = np.bitwise_count(bits_b[None] & ~bits_a[:, None]).sum(axis=2, dtype=np.int64)
    both = np.minimum(n_a[:, None] - only_a, n_b[None] - only_b)
    return both * (1 + similar) >= similar * (n_a[:, None] + n_b[None]) - 1e-6


def _candidates(similar: float):
    def side(blocks: pa.ListArray):
        rows, cuts = blocks.flatten(), blocks.offsets.to_numpy()
        bits = np.frombuffer(b"".join(rows.field("bits").to_pylist()), np.uint64).reshape(len(rows), -1)
        return cuts - cuts[0], rows.field("class"), rows.field("node").to_pylist(), rows.field("n").to_numpy(), bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (cuts_a, class_a, *one), (cuts_b, class_b, *two) = side(batch.column("one")), side(batch.column("two"))
            code = pa.concat_arrays([class_a, class_b]).dictionary_encode().indices.to_numpy()
            code_a, code_b, found = code[: len(class_a)], code[len(class_a) :], set()
            for r in range(batch.num_rows):
                x, y = slice(*cuts_a[r : r + 2]), slice(*cuts_b[r : r + 2])
                (a, n_a, bits_a), (b, n_b, bits_b) = (v[x] for v in one), (v[y] for v in two)
                hit = may_be_similar(n_a, bits_a, n_b, bits_b, similar) & (code_a[x, None] != code_b[None, y])
                found.update((max(a[i], b[j]), min(a[i], b[j])) for i, j in zip(*np.nonzero(hit)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def classes(docs: DataFrame, k: int = 5, similar: float = 0.8, sketches: int = 20, picks: int = 4, block: int = 64, dealt: int = 4096) -> DataFrame:
    """node and class of every node that is similar to another; the node that names its class may be left out."""
    key = ["fn", "sketch"]
    left = buckets(docs, k, sketches, picks)
    members = left.select("node").distinct()
    texts = docs.select(node_of(F.col("text")).alias("node"), "text").join(members, "node").groupBy("node").agg(F.first("text").alias("text"))
    texts = stage(texts)
    marks = stage(texts.mapInArrow(_marks(k), "node binary, n int, bits binary"))
    found = components(_links(left, key, texts, k, similar))
    for part in (16, 1):
        links = _rest(left, found, key, texts, marks, k, similar, block, dealt, part)
        if not links.isEmpty():
            found = components(links.unionByName(found.select(F.col("node").alias("a"), F.col("class").alias("b"))))
    return found


def _rest(members: DataFrame, classed: DataFrame, key: list[str], texts: DataFrame, marks: DataFrame, k: int, similar: float, block: int, dealt: int, part: int) -> DataFrame:
    """The similar pairs (a, b) of two classes' members in one bucket, a or b of every `part`-th node."""
    members = members.select("node", *key).join(classed, "node", "left").withColumn("class", F.coalesce("class", "node"))
    members = stage(members.join(marks, "node"))
    # only buckets with two classes; a class that fills a block has blocks of its own
    sizes = members.groupBy(*key, "class").agg(F.count("*").alias("size")).repartition(*key)
    small = F.col("size") < block
    wholes = sizes.groupBy(*key).agg(F.count("*").alias("classes"), F.sum("size").alias("total"), F.sum(F.when(small, F.col("size"))).alias("rest")).where("classes > 1")
    named = sizes.join(wholes, key).select(
        *key, "class", F.ceil(F.col("total") / dealt).alias("parts"),
        F.when(small, F.unhex(F.lit(""))).otherwise(F.col("class")).alias("group"), F.when(small, F.col("rest")).otherwise(F.col("size")).alias("size"),
    )
    held = members.join(named, [*key, "class"]).withColumn("h", F.xxhash64("node")).withColumn("me", F.pmod(F.xxhash64("h", F.lit(1)), "parts"))
    # (i, j): two parts of a bucket, which nearly always is one part
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    at = [*key, "i", "j"]
    held = held.withColumns({"i": F.least("me", "other"), "j": F.greatest("me", "other")}).drop("other")

    def blocks(rows: DataFrame, of: str, size: int) -> DataFrame:
        rows = rows.withColumn("no", F.pmod(F.xxhash64("h"), F.ceil(F.col("size") / F.col("parts") / size))).repartition(*at)
        return rows.groupBy(*at, "me", "group", "no").agg(F.collect_list(F.struct("node", "class", "n", "bits")).alias(of))

    ones, twos = blocks(held.where(F.pmod("h", F.lit(part)) == 0), "one", block * part), blocks(held, "two", block)
    both = ones.alias("l").join(twos.alias("r"), at).where("l.group != r.group or l.group = unhex('')")
    if part == 1:
        both = both.where("l.me < r.me or i = j and struct(l.group, l.no) <= struct(r.group, r.no)")
    else:
        both = both.where("l.me != r.me or i = j")
    pairs = stage(both.select("one", "two").mapInArrow(_candidates(similar), "a binary, b binary"))
    return _similar_pairs(pairs, texts, k, similar)


def _links(members: DataFrame, key: list[str], texts: DataFrame, k: int, similar: float) -> DataFrame:
    """The similar pairs (a, b) of a bucket's center, whose buckets have the most members, and its other members."""
    company = members.groupBy("node").agg(F.sum("size").alias("company"))
    centers = members.join(company, "node").groupBy(*key).agg(F.max(F.struct("company", "node")).alias("top"))
    pairs = members.join(centers.select(*key, F.col("top.node").alias("a")), key).where("node != a").select("a", F.col("node").alias("b"))
    return _similar_pairs(pairs, texts, k, similar)


def _similar_pairs(pairs: DataFrame, texts: DataFrame, k: int, similar: float) -> DataFrame:
    pairs = pairs.repartition("b").distinct()
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return stage(with_a.mapInArrow(_verify(k, similar), "a binary, b binary"))


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """doc_id and class_id (the class's least doc_id) of every document."""
    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"))
    named = rows.join(classes(docs, **how), "node", "left").select("doc_id", F.coalesce("class", "node").alias("class"))
    named = stage(named)
    least = named.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return named.join(stage(least), "class").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents without near copies: of each class the row of the least doc_id stays."""
    rows = docs.select("doc_id", node_of(F.col("text")).alias("node"))
    named = rows.join(classes(docs, **how), "node", "left")
    kept = named.groupBy(F.coalesce("class", "node")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("least")).select("least.doc_id", F.col("least.node").alias(NODE))
    keyed = docs.withColumn(NODE, node_of(F.col("text")))
    joined = keyed.join(stage(kept).withColumnRenamed("doc_id", NODE + "_id"), [NODE]).where(F.col("doc_id").eqNullSafe(F.col(NODE + "_id")))
    return joined.dropDuplicates([NODE]).select(*docs.columns)
