"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A paragraph (a line that is not blank) is hashed to a wide vector, and a text's
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers
of two. Order does not matter; a paragraph is inserted or deleted by adding or
subtracting its own fingerprint (`plus`, `minus`), with no need for the text. The vector of
a paragraph has two parts:

* 8 lanes modulo 2**32, hashed from the whole paragraph: equality;
* 128 lanes modulo 2**16, the sum over the paragraph's runs of up to four words
  of +1 or -1 by the bits of the run's hash: the scalar product of two
  fingerprints estimates how many runs two texts share, and `likeness` is its
  cosine (standard error about 0.09), cut to 0..1. It is meant for lanes whose sums stay below
  2**15; a run repeated more often wraps, which affects the likeness alone.

The text form is lower-case hex: eight digits a lane of the first part, four a
lane of the second. Hashes are xxHash64 with a lane number: fit for finding copies, not
against an adversary.

Defined results: null and empty texts have the zero fingerprint; two zero
fingerprints have likeness 1, a zero and another 0. Rows equal in doc_id and text count as one
document in the order and give one equal row each; null doc_ids come first. A single document is
its own next. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import stage

WIDE, SIGNS = 8, 128
#: One bit in each half of a long; the lower half.
PAIR, LOW = (1 << 32) + 1, (1 << 32) - 1
RUN = r"\S+(?:\s+\S+){0,3}"


def _total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0).cast("long"))


def lanes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and the fingerprint's lanes of the texts of each key, as `wide` and `signs`."""
    pars = df.select(*keys, F.explode_outer(F.split(F.col(text), "\n")).alias("par"))
    runs = pars.select(*keys, "par", F.posexplode_outer(F.regexp_extract_all("par", F.lit(RUN), F.lit(0))).alias("n", "run"))
    whole = [F.xxhash64("par", F.lit(k)) for k in range(WIDE // 2)]
    half = [F.xxhash64("run", F.lit(k)) for k in range(100, 100 + SIGNS // 64)]
    head = F.when(F.col("n") == 0, F.lit(1))
    # two lanes of 32 bits in each sum of the second part
    sums = [_total(F.when(F.col("n") == 0, part)).alias(f"w{k}{side}") for k, h in enumerate(whole) for side, part in (("a", h.bitwiseAND(F.lit(LOW))), ("b", F.shiftrightunsigned(h, 32)))]
    sums += [_total(F.when(F.col("n").isNotNull(), F.shiftrightunsigned(h, j).bitwiseAND(F.lit(PAIR)))).alias(f"s{k}_{j}") for k, h in enumerate(half) for j in range(32)]
    hashed = runs.groupBy(*keys).agg(*sums, F.count("n").alias("runs"), F.count(head).alias("paragraphs"))
    wide = F.array(*(F.pmod(F.col(f"w{k}{side}"), F.lit(1 << 32)) for k in range(WIDE // 2) for side in "ab"))
    signed = lambda x: F.pmod(2 * x - F.col("runs"), F.lit(1 << 16))
    signs = F.array(
        *(signed(part) for k in range(SIGNS // 64) for j in range(32) for part in (F.col(f"s{k}_{j}").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(f"s{k}_{j}", 32)))
    )
    return hashed.select(*keys, wide.alias("wide"), signs.alias("signs"))


def to_text(wide: Column, signs: Column) -> Column:
    digits = lambda xs, n: F.array_join(F.transform(xs, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.lower(F.concat(digits(wide, 8), digits(signs, 4)))


def _lanes(fp: Column, start: int, count: int, digits: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda k: F.conv(F.substring(fp, k * digits + start + 1, F.lit(digits)), 16, 10).cast("long"),
    )


def wide_lanes(fp: Column) -> Column:
    return _lanes(fp, 0, WIDE, 8)


def sign_lanes(fp: Column) -> Column:
    return _lanes(fp, WIDE * 8, SIGNS, 4)


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    mod = lambda xs, ys, m: F.zip_with(xs, ys, lambda x, y: F.pmod(x + sign * y, F.lit(m)))
    return to_text(mod(wide_lanes(a), wide_lanes(b), 1 << 32), mod(sign_lanes(a), sign_lanes(b), 1 << 16))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both texts."""
    return _lanewise(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of a without the paragraphs of b."""
    return _lanewise(a, b, -1)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of lanes modulo 2**16, read as signed numbers; cut to 0..1."""
    signed = lambda x: x - F.when(x >= 1 << 15, F.lit(1 << 16)).otherwise(F.lit(0))
    record = lambda **fields: F.named_struct(*(x for k, v in fields.items() for x in (F.lit(k), v)))
    zero = F.lit(0).cast("long")
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: record(x=signed(x), y=signed(y))),
        record(ab=zero, aa=zero, bb=zero),
        lambda s, v: record(ab=s.ab + v.x * v.y, aa=s.aa + v.x * v.x, bb=s.bb + v.y * v.y),
        lambda s: F.when((s.aa == 0) | (s.bb == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.ab / F.sqrt(s.aa.cast("double") * s.bb)))),
    )


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints in text form: 1 if equal, else the share of runs in common (cosine)."""
    return F.when(a == b, F.lit(1.0)).otherwise(cosine(sign_lanes(a), sign_lanes(b)))


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return lanes(df, keys, text).select(*keys, to_text(F.col("wide"), F.col("signs")).alias("fingerprint"))


def next_documents(docs: DataFrame) -> DataFrame:
    """id, key, n_chars, copies, next_id, next_key: each document's successor by (id, key), the last one's is the first."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.groupBy("id", "key").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"), F.first("doc_id").alias("doc_id"))
    ordered = stage(rows.repartitionByRange(parts, "id", "key").withColumn("part", F.spark_partition_id()))
    firsts = ordered.groupBy("part").agg(F.min(F.struct("id", "key")).alias("first")).orderBy("part").collect()  # one row a partition
    turned = [(r.part, f.first.id, f.first.key) for r, f in zip(firsts, [*firsts[1:], *firsts[:1]])]
    after = spark.createDataFrame(turned, "part int, first_id long, first_key long")
    order = Window.partitionBy("part").orderBy("id", "key")
    following = ordered.withColumn("following", F.lead(F.struct("id", "key")).over(order)).join(F.broadcast(after), "part")
    return following.select(
        "id", "key", "doc_id", "n_chars", "copies",
        F.coalesce("following.id", "first_id").alias("next_id"), F.coalesce("following.key", "first_key").alias("next_key"),
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document with its edited text: the last half replaced by the beginning of the next document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("key"),
        text.alias("text"),
    )
    order = stage(next_documents(rows))
    whole = rows.groupBy("id", "key").agg(F.first("text").alias("text"))
    half = F.floor(F.col("n_chars") / 2)
    asked = order.select(F.col("id").alias("for_id"), F.col("key").alias("for_key"), F.col("next_id").alias("id"), F.col("next_key").alias("key"), half.alias("half"))
    heads = asked.join(whole, ["id", "key"]).select(F.col("for_id").alias("id"), F.col("for_key").alias("key"), F.substring("text", F.lit(1), F.col("half").cast("int")).alias("head"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int"))
    return order.join(whole, ["id", "key"]).join(heads, ["id", "key"]).withColumn("edited", F.concat(kept, "head")).drop("head")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and edited texts with their likeness, one row per document."""
    keys = ["id", "key", "doc_id", "n_chars", "copies", "next_id", "next_key", "edited_sha256"]
    pairs = edited_pairs(docs).withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    bodies = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(body).alias("body")) for kind, body in enumerate(("text", "edited"))))
    both = pairs.select(*keys, F.explode(bodies).alias("x")).select(*keys, "x.kind", "x.body")
    hashed = fingerprints(both, [*keys, "kind"], "body")
    # digests travel as bytes, half of their hex digits
    pick = lambda kind: F.unhex(F.max(F.when(F.col("kind") == kind, F.col("fingerprint"))))
    own = stage(hashed.groupBy(*keys).agg(pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint")))
    following = own.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint"))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    joined = own.join(following, ["next_id", "next_key"]).select("doc_id", "n_chars", "copies", *map(text, ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")))
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
