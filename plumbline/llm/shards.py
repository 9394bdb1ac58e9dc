"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in `parts` local parts (a hash of their columns). Shard sizes are fixed
first: at most one row apart. How many rows each part sends to each shard is a
draw without replacement: part by part and shard by shard, a hypergeometric
number given the room that the shard has left - the matrix of a uniform random
permutation, with exact row and column sums. Inside a part the rows are put in
random order (a seeded hash) and dealt to the shards by the part's row of the
matrix; then they are exchanged; inside a shard they are put in random order again
(buckets by hash, ordered by hash, offset by the buckets' counts), which gives a
gapless slot. No window ever holds a whole shard: parts and buckets have about
`rows` rows each.

Only counts reach the driver: one row a part and one a bucket.

Law: rows. Defined results: a null text has size 1 and the checksum of the empty
text; rows equal in every column used are interchangeable; null doc_ids are
rows like others; an empty table gives an empty result. Fewer rows than shards
leave shards empty. Other columns are ignored.
"""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import stage


def hypergeometric(draws: int, good: int, total: int, rng: random.Random) -> int:
    """How many of `draws` rows drawn without replacement from `total` fall among `good` ones.

    Inversion from the mode outward: the expected number of steps is of the
    order of the standard deviation.
    """
    import math

    low, high = max(0, draws + good - total), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(log(good, mode) + log(total - good, draws - mode) - log(total, draws))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (total - good - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (total - good - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows that each part sends to each shard; sums are `parts` and `shards` exactly."""
    rng, room, matrix = random.Random(seed), list(shards), []
    for size in parts:
        left, total, row = size, sum(room), []
        for k, free in enumerate(room):
            take = hypergeometric(left, free, total, rng)
            row.append(take)
            total -= free
            left -= take
            room[k] -= take
        matrix.append(row)
    return matrix


def _offsets(counts: dict, keys: list) -> dict:
    return dict(zip(keys, accumulate((counts.get(k, 0) for k in keys), initial=0)))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 7, rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # read once, from here on rows of 24 bytes; the written order tells equal rows apart
    kept = stage(narrow.withColumn("at", F.monotonically_increasing_id()))
    total = kept.count()
    parts = max(1, -(-total // rows))
    drawn = lambda tag: F.xxhash64(F.lit(seed), F.lit(tag), "doc_id", "text_crc32", "at")
    local = kept.withColumn("part", F.pmod(drawn("part"), F.lit(parts)).cast("int"))
    have = {r.part: r["count"] for r in local.groupBy("part").count().collect()}
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([have.get(p, 0) for p in range(parts)], sizes, seed)
    bounds = spark.createDataFrame([(p, list(accumulate(row))) for p, row in enumerate(matrix)], "part int, upto array<long>")
    place = F.row_number().over(Window.partitionBy("part").orderBy(drawn("place"), "at"))
    dealt = local.withColumn("place", place).join(bounds, "part")
    shard = F.aggregate("upto", F.lit(0), lambda n, upto: n + (upto < F.col("place")).cast("int"))
    buckets = max(1, -(-total // (shards * rows)))
    dealt = dealt.select("doc_id", "size", "text_crc32", "at", shard.alias("shard"), F.pmod(drawn("bucket"), F.lit(buckets)).cast("int").alias("bucket"))
    dealt = stage(dealt)
    counts = {(r.shard, r.bucket): r["count"] for r in dealt.groupBy("shard", "bucket").count().collect()}
    before = []
    for s in range(shards):
        keys = [(s, b) for b in range(buckets)]
        before += [(*k, v) for k, v in _offsets(counts, keys).items()]
    first = spark.createDataFrame(before, "shard int, bucket int, first long")
    order = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(drawn("slot"), "at"))
    placed = dealt.withColumn("order", order).join(F.broadcast(first), ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("order") - 1).alias("slot"))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
