"""Centroid clustering by bit planes: exact integer k-means from AND and popcount.

A vector of 64 components becomes integers floor(scale * x). Bit b of all 64 components is
packed into one uint64, the bit plane b; the last plane is the sign of two's complement.
The dot product of two vectors is the sum over their planes a and b of
w(a) * w(b) * popcount(X[a] & C[b]), where w is 2**b, and -2**b for the sign plane. So
|x|**2, |c|**2 and x.c, and with them the squared distance, are exact integers.

The planes are written once to the shared folder. Each round broadcasts k centroids (k * 64
numbers), every task sums the components of its vectors by cluster, and k * 64 totals
reach the driver.

Defined results: vectors that are null, have another number of components than 64, or hold a
null, NaN or infinite component are left out. Repeated rows are vectors of their own; rows
of a null vec_id are kept, and their order string is that of an empty id. Equal order strings go by
planes. With fewer vectors than k there are fewer centroids; an empty table gives no rows. Components beyond
2**62 are held there, and sums beyond a long wrap around.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import split_small, stage

WIDTH = 64
PLANES = "vec_id long, planes array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"
COLUMNS = ASSIGNED + ", cluster_inertia long, inertia long, centroid_sha256 string"
ROWS = 4096  # vectors that a task holds against the centroids at once


def pack(components: np.ndarray) -> np.ndarray:
    """The bit planes of n x 64 integers: n x bits of uint64, the sign plane last."""
    bits = 1 + max((int(np.abs(components).max()).bit_length() if components.size else 0), 1)
    planes = [np.packbits(((components >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0] for b in range(bits)]
    return np.stack(planes, axis=1)


def unpack(planes: np.ndarray) -> np.ndarray:
    """The n x 64 integers of n x bits planes."""
    n, bits = planes.shape
    ones = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(n, bits, 8), axis=2, bitorder="little")
    return np.einsum("nbi,b->ni", ones.astype(np.int64), weights(bits))


def weights(bits: int) -> np.ndarray:
    out = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    out[-1] = -out[-1]
    return out


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The dot products of n vectors with k vectors, both as planes."""
    out = np.zeros((len(x), len(c)), np.int64)
    for a, wa in enumerate(weights(x.shape[1])):
        for b, wb in enumerate(weights(c.shape[1])):
            out += np.bitwise_count(x[:, a, None] & c[None, :, b]).astype(np.int64) * (wa * wb)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """The squared length of each vector."""
    out, w = np.zeros(len(x), np.int64), weights(x.shape[1])
    for a in range(x.shape[1]):
        for b in range(x.shape[1]):
            out += np.bitwise_count(x[:, a] & x[:, b]).astype(np.int64) * (w[a] * w[b])
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (the first of equal ones) and the squared distance."""
    distances = squares(x)[:, None] + squares(c)[None, :] - 2 * dots(x, c)
    cluster = np.argmin(distances, axis=1)
    return cluster, distances[np.arange(len(x)), cluster]


def vector_planes(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and planes of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
            planes = pack(np.clip(np.floor(scale * values), -(2.0**62), 2.0**62).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), listed(planes)], ["vec_id", "planes"])

    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where((F.size(x) == WIDTH) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    return split_small(kept).mapInArrow(run, PLANES)


def listed(planes: np.ndarray) -> pa.Array:
    n, bits = planes.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bits), pa.array(planes.reshape(-1).view(np.int64)))


def plane_matrix(column: pa.Array) -> np.ndarray:
    """n x bits; vectors of fewer planes repeat their sign plane, which changes no component."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    counts = np.diff(offsets)
    at = np.minimum(np.arange(counts.max())[None, :], counts[:, None] - 1)
    return flat[offsets[:-1, None] + at]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def cluster_sums(planes: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of every non-empty cluster: its number of vectors and the sum of each component."""
    shared = planes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, count = np.zeros((len(c), WIDTH), np.int64), np.zeros(len(c), np.int64)
        for batch in _slices(batches):
            x = plane_matrix(batch.column("planes"))
            cluster, _ = nearest(x, c)
            components = unpack(x)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(components[order], first, axis=0)
            count += np.bincount(cluster, minlength=len(c))
        k, i = (g.reshape(-1).astype(np.int32) for g in np.indices(total.shape))
        some = count[k] > 0
        yield pa.RecordBatch.from_arrays([pa.array(a[some]) for a in (k, i, total.reshape(-1), count[k])], ["cluster", "component", "total", "n"])

    parts = planes.mapInArrow(run, "cluster int, component int, total long, n long")
    rows = parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # k * 64
    shared.destroy()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.cluster, (r.n, [0] * WIDTH))[1][r.component] = int(r.total)
    return out


def assign(planes: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    shared = planes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            cluster, distance = nearest(plane_matrix(batch.column("planes")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return planes.mapInArrow(run, ASSIGNED)


def first_centroids(planes: DataFrame, k: int, seed: int) -> np.ndarray:
    """The components of the k vectors of least sha256 of `seed:vec_id`."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = planes.select(order.alias("o"), "planes").orderBy("o", "planes").limit(k).collect()
    return np.concatenate([unpack(np.array([r.planes], np.int64).view(np.uint64)) for r in rows]) if rows else np.zeros((0, WIDTH), np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """Each vector's cluster and distance after `rounds` of exact k-means, with the inertia and the digest of its centroid.

    Needs columns vec_id and embedding (an array of numbers); others are ignored.
    """
    planes = stage(vector_planes(vectors, scale))
    centroids = first_centroids(planes, k, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], COLUMNS)
    for _ in range(rounds):
        for c, (n, total) in cluster_sums(planes, pack(centroids)).items():
            centroids[c] = [t // n for t in total]
    assigned = stage(assign(planes, pack(centroids)))
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame(
        [(c, wrapped(d), wrapped(sum(inertia.values())), digests[c]) for c, d in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def wrapped(x: int) -> int:
    """x as a long."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def oracle(k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> str:
    """The same clustering in DuckDB's SQL, over components as rows."""
    steps = [f"""
kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 c, v from kept
  order by sha256('{seed}:' || vec_id) limit {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
  select vec_id, any_value(v) v, arg_min(c, (d, c)) c, min(d) d from (
    select kept.vec_id, kept.v, c{r}.c,
      list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d from kept, c{r})
  group by vec_id)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} as materialized (
  select c{r}.c, coalesce(m.v, c{r}.v) v from c{r} left join (
    select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) v from (
      select c, i, sum(x)::bigint s, count(*) n from (
        select c, unnest(v) x, generate_subscripts(v, 1) i from a{r}) group by c, i) group by c) m on m.c = c{r}.c)""")
    return "with " + ",".join(steps) + f"""
select vec_id, a{rounds}.c::int as "cluster", d as distance, (sum(d) over (partition by a{rounds}.c))::bigint as cluster_inertia,
  (sum(d) over ())::bigint as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join c{rounds} on c{rounds}.c = a{rounds}.c"""


ORACLE = oracle()
