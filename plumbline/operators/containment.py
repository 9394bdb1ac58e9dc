"""Which documents hold a fragment? An exact substring join without comparing every pair.

A fragment is a substring of a text, so its inner words are whole words of
that text. Every fragment gets one anchor that any containing text must also
produce; fragments meet texts on equal anchors and each meeting is verified
with a plain substring test. Anchor kinds by number of words in the fragment:

* five or more: the longest three-word run that leaves out the first and last word; where fragments
  are too many to be broadcast, a six-word run if there are eight words or more, and in place of a run that is
  common in a sample of the texts the one that the fewest of them hold
* three or four: the longest inner word; where fragments are many, with three letters of either neighbour if these have them
* two: the last seven letters of the first word, or the first seven of the second,
  whichever word is longer
* one, of fifteen letters or more: its first fifteen letters
* anything shorter has no anchor and is verified against every text

An anchor has one place in its fragment, so a text is never sent on: each place of the text with an anchor's key sends on the
letters around it, as many as the fragments reach, and these decide whether the fragment stands there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.operators.skew import LOOK_AT, salted_join
from plumbline.session import stage, union_all

# Fragments up to this many bytes, keys included, are broadcast; beyond it the
# join shuffles keys only and fetches the texts of the meeting pairs.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64
AFFIX = 7
GRAM = 15
GAPLESS_GRAM = 8
# Where fragments are many, the commonest runs of a sample of the texts are avoided as anchors. Which ones decides balance only.
SAMPLE_TEXTS = 20_000
COMMON_RUNS = 10_000

RUN, INNER, AFFIXES, LONG, BARE, STRETCH, NEAR = "run", "inner", "affix", "long", "bare", "stretch", "near"
NEIGHBOUR = 3
WORDS = {RUN: 3, STRETCH: 6}
# A bit map of the fragments' anchors goes to the texts, which send on only keys that it holds: bits an anchor, the most bits (8 MB),
# and the bits that are set for an anchor.
ANCHOR_BITS = 16
MOST_BITS = 1 << 26
PROBES = 3
# Fragments of up to this many words meet the texts in one pass; each further pass takes those of up to eight times as many, so that
# a few long fragments do not widen what is sent on for all others.
BAND_WORDS, BAND_GROWTH = 256, 8
WIDE_WORDS = 32


def _word(w: Column, i) -> Column:
    return F.get(w, i if isinstance(i, Column) else F.lit(i))


def _run_hash(w: Column, i: Column, kind: str = RUN) -> Column:
    return F.xxhash64(F.lit(kind), F.slice(w, i + 1, F.lit(WORDS[kind])))


def _near_hash(w: Column, i: Column) -> Column:
    """A word with the letters next to it; null where a neighbour is too short."""
    ahead, after = F.get(w, i - 1), F.get(w, i + 1)
    enough = (F.length(ahead) >= NEIGHBOUR) & (F.length(after) >= NEIGHBOUR)
    return F.when(enough, F.xxhash64(F.lit(NEAR), F.right(ahead, F.lit(NEIGHBOUR)), F.get(w, i), F.left(after, F.lit(NEIGHBOUR))))


def _letters(w: Column, i: Column, kind: str = RUN) -> Column:
    lengths = [F.length(_word(w, i + k)) for k in range(WORDS[kind])]
    return sum(lengths[1:], lengths[0])


def _tagged(tag: str, value: Column) -> Column:
    return F.xxhash64(F.lit(tag), value)


def _inner_runs(w: Column, kind: str) -> Column:
    """The runs a fragment may be anchored at: all that leave out its first and last word."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1 - WORDS[kind])),
        lambda i: F.struct((-_letters(w, i, kind)).alias("k"), _run_hash(w, i, kind).alias("h")),
    )


def _anchor_of(w: Column, stretches: bool = False) -> Column:
    """struct(kind, anchor) of the words of a fragment."""
    n = F.size(w)
    first, second = _word(w, 0), _word(w, 1)
    inner = F.transform(
        F.slice(w, F.lit(2), F.greatest(F.lit(0), n - 2)),
        lambda x: F.struct((-F.length(x)).alias("k"), x.alias("w")),
    )
    affix = F.when(F.length(first) >= F.length(second), _tagged("tail", F.right(first, F.lit(AFFIX)))).otherwise(
        _tagged("head", F.left(second, F.lit(AFFIX)))
    )
    near = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), n - 2)), lambda i: F.struct((-F.length(_word(w, i))).alias("k"), _near_hash(w, i).alias("h"))
    )
    near = F.array_min(F.filter(near, lambda x: x["h"].isNotNull()))["h"]
    made = lambda kind, anchor: F.struct(F.lit(kind).alias("kind"), anchor.alias("anchor"))
    longer = WORDS[STRETCH] + 2 if stretches else None
    return (
        F.when(n >= longer if stretches else F.lit(False), made(STRETCH, F.array_min(_inner_runs(w, STRETCH))["h"]))
        .when(n >= 5, made(RUN, F.array_min(_inner_runs(w, RUN))["h"]))
        .when((n >= 3) & near.isNotNull() if stretches else F.lit(False), made(NEAR, near))
        .when(n >= 3, made(INNER, _tagged("word", F.array_min(inner)["w"])))
        .when((n == 2) & (F.greatest(F.length(first), F.length(second)) >= AFFIX), made(AFFIXES, affix))
        .when((n == 1) & (F.length(first) >= GRAM), made(LONG, _tagged("gram", F.left(first, F.lit(GRAM)))))
        .otherwise(made(BARE, F.lit(None).cast("long")))
    )


def with_anchor(frags: DataFrame, frag: str, stretches: bool = False) -> DataFrame:
    """Add ``_kind`` and ``_anchor`` to fragments; with ``stretches`` those of eight words or more have six-word runs."""
    # as a generated column the anchor is computed once; later filters stay above it
    made = frags.withColumn("_a", F.explode(F.array(let(F.split(frag, " "), lambda w: _anchor_of(w, stretches)))))
    return made.withColumn("_kind", F.col("_a.kind")).withColumn("_anchor", F.col("_a.anchor")).drop("_a")


def drawn_texts(docs: DataFrame, doc_id: str, sample: int = SAMPLE_TEXTS) -> DataFrame:
    """About ``sample`` of the texts."""
    step = max(1, docs.count() // sample)
    return docs.where(F.pmod(F.xxhash64(doc_id), F.lit(step)) == 0)  # a filter on the id goes below the normalisation


def common_runs(
    docs: DataFrame, doc_id: str, text: str, sample: int = SAMPLE_TEXTS, most: int = COMMON_RUNS, kinds: frozenset[str] = frozenset({RUN})
) -> DataFrame:
    """(h, texts): the runs that the sampled texts hold most often, at most ``most`` of them."""
    counted = _keyed(drawn_texts(docs, doc_id, sample), doc_id, text, set(kinds)).groupBy(F.col("_anchor").alias("h")).agg(F.count(F.lit(1)).alias("texts"))
    return stage(counted.where("texts > 1 AND h IS NOT NULL").orderBy(F.desc("texts"), "h").limit(most))


def rarest_anchor(anchored: DataFrame, common: DataFrame, frag_id: str, frag: str, kind: str = RUN) -> DataFrame:
    """Fragments whose run is a common one at the run that the fewest texts hold, the longest of equals.

    Only they are taken apart into their runs: the others stay rows of their own and are not shuffled.
    """
    common = F.broadcast(common)  # COMMON_RUNS rows at most
    marked = anchored.join(common.select(F.col("h").alias("_anchor"), F.lit(True).alias("_common")), "_anchor", "left")
    again = F.col("_common").isNotNull() & (F.col("_kind") == kind)
    each = marked.where(again).select(frag_id, frag, F.explode(let(F.split(frag, " "), lambda w: _inner_runs(w, kind))).alias("r"))
    known = each.select(frag_id, frag, F.col("r.k").alias("k"), F.col("r.h").alias("h")).join(common, "h", "left")
    best = F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "k", "h"))["h"]
    chosen = known.groupBy(frag_id, frag).agg(best.alias("_anchor")).withColumn("_kind", F.lit(kind))
    return marked.where(~again).select(anchored.columns).unionByName(chosen.select(anchored.columns))


def _nested(docs: DataFrame, frags: DataFrame, size: int, limit: int, text: str, frag: str) -> DataFrame:
    """Every text against every fragment, by broadcasts of about ``limit`` bytes each."""
    blocks = max(1, -(-size // max(1, limit)))
    part = F.pmod(F.xxhash64(frag), F.lit(blocks))
    return union_all([docs.join(F.broadcast(frags.where(part == b)), F.contains(F.col(text), F.col(frag))) for b in range(blocks)])


def _all_runs(w: Column, kind: str) -> Column:
    last = F.greatest(F.lit(0), F.size(w) - WORDS[kind])
    return F.transform(F.sequence(F.lit(0), last), lambda i: _run_hash(w, i, kind))


def _text_keys(text: Column, kinds: set[str]) -> Column:
    """Every anchor of the wanted kinds that a text produces, without repeats."""

    def keys(w: Column) -> Column:
        parts = []
        for kind in (RUN, STRETCH):
            if kind in kinds:
                parts.append(_all_runs(w, kind))
        if INNER in kinds:
            parts.append(F.transform(w, lambda x: _tagged("word", x)))
        if AFFIXES in kinds:
            big = F.filter(w, lambda x: F.length(x) >= AFFIX)
            parts.append(F.transform(big, lambda x: _tagged("tail", F.right(x, F.lit(AFFIX)))))
            parts.append(F.transform(big, lambda x: _tagged("head", F.left(x, F.lit(AFFIX)))))
        if LONG in kinds:
            grams = F.transform(
                F.filter(w, lambda x: F.length(x) >= GRAM),
                lambda x: F.transform(
                    F.sequence(F.lit(1), F.length(x) - GRAM + 1), lambda i: _tagged("gram", x.substr(i, F.lit(GRAM)))
                ),
            )
            parts.append(F.flatten(grams))
        return F.array_distinct(F.concat(*parts))

    return let(F.split(text, " "), keys)


def _meet(anchors: DataFrame, docs: DataFrame, doc_id: str, text: str, keys: Column, strategy: str) -> DataFrame:
    """Pairs of anchor rows and documents with an equal key, document text attached."""
    if strategy == "broadcast":
        # The keys are a column of their own, so that explode and probe compile
        # into one loop: a text is written out for a hit, not for every key.
        keyed = docs.select(doc_id, text, keys.alias("_keys"))
        exploded = keyed.select(doc_id, text, F.explode_outer("_keys").alias("_anchor"))
        return exploded.join(F.broadcast(anchors), "_anchor")
    anchors = stage(anchors)
    size = anchors.count()
    held = _holds(_bit_map(anchors, size), size)

    def meeting(texts: DataFrame) -> DataFrame:
        keyed = texts.select(doc_id, keys.alias("_keys"))
        return keyed.select(doc_id, F.explode_outer("_keys").alias("_anchor")).where(held)

    # hot keys are looked for in a share of the texts, chosen by the id, so that the others are not normalised for that
    share = meeting(docs.where(F.pmod(F.xxhash64(doc_id), F.lit(int(1 / LOOK_AT))) == 0))
    pairs = salted_join(meeting(docs), anchors, ["_anchor"], [doc_id], "inner", count_on=share, drawn=True)
    return pairs.join(docs.select(doc_id, text), doc_id)


def _bits_of(size: int) -> int:
    """Bits of the map of so many anchors: a power of two, bounded; a fuller map lets more keys pass, and the result stays the same."""
    return min(MOST_BITS, max(1 << 12, 1 << (ANCHOR_BITS * max(1, size) - 1).bit_length()))


def _bit_places(bits: int) -> list[Column]:
    """The bits of an anchor: its lower half and steps of its upper half, an odd number."""
    low, step = F.col("_anchor").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("_anchor", 32).bitwiseOR(F.lit(1))
    return [F.pmod(low + step * k if k else low, F.lit(bits)) for k in range(PROBES)]


def _bit_map(anchors: DataFrame, size: int) -> Column:
    """The places of the anchors as an array of 64-bit words, at most ``MOST_BITS`` / 8 bytes."""
    bits = _bits_of(size)
    places = anchors.select(F.explode(F.array(*_bit_places(bits))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = places.select(F.floor(F.col("place") / 64).cast("long").alias("id"), one.alias("word")).groupBy("id").agg(F.bit_or("word").alias("word"))
    every = anchors.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return stage(every.agg(F.sort_array(F.collect_list(F.struct("id", "word")))["word"].alias("words"))).scalar()


def _holds(words: Column, size: int) -> Column:
    bit = lambda place: F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1
    return reduce(lambda a, b: a & b, [bit(place) for place in _bit_places(_bits_of(size))])


def _bytes(frag: str) -> Column:
    """Size of a set of fragments: the text, an identifier that may repeat it, and the row."""
    return F.sum(2 * F.octet_length(frag) + ROW_BYTES)


def _strategy(size: int, limit: int) -> str:
    return "broadcast" if size <= limit else "shuffle"


def occurrences(text: Column, probe: Column) -> Column:
    """How often a probe starts in a text, overlaps counted."""
    return F.regexp_count(text, F.concat(F.lit(r"(?=\Q"), probe, F.lit(r"\E)")))


def _placed(anchored: DataFrame, frag_id: str, frag: str) -> DataFrame:
    """(frag_id, _kind, _anchor, _frag, _ahead, _words): a fragment, its words ahead of the one its anchor begins in, and its words."""

    def place(w: Column) -> Column:
        def of_run(kind: str) -> Column:
            hashes = F.transform(_inner_runs(w, kind), lambda r: r["h"])
            return F.array_position(hashes, F.col("_anchor"))  # the first of them begins at the second word

        inner = F.transform(F.slice(w, F.lit(2), F.greatest(F.lit(0), F.size(w) - 2)), lambda x: _tagged("word", x))
        near = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 2)), lambda i: _near_hash(w, i))
        head = F.col("_anchor") != _tagged("tail", F.right(_word(w, 0), F.lit(AFFIX)))
        kind = F.col("_kind")
        ahead = (
            F.when(kind == RUN, of_run(RUN)).when(kind == STRETCH, of_run(STRETCH)).when(kind == NEAR, F.array_position(near, F.col("_anchor")))
            .when(kind == INNER, F.array_position(inner, F.col("_anchor"))).when(kind == AFFIXES, head.cast("long")).otherwise(F.lit(0).cast("long"))
        )
        return F.struct(ahead.cast("int").alias("ahead"), F.size(w).alias("words"))

    made = anchored.where(F.col("_anchor").isNotNull()).withColumn("_c", F.explode(F.array(let(F.split(frag, " "), place))))
    return made.select(frag_id, "_kind", "_anchor", F.col(frag).alias("_frag"), F.col("_c.ahead").alias("_ahead"), F.col("_c.words").alias("_words"))


def _keyed(docs: DataFrame, doc_id: str, text: str, kinds: set[str]) -> DataFrame:
    """(doc_id, _w, _i, _k, _anchor): every key of the wanted kinds, and where its word stands among the words of the text.

    A word is a row where its keys are made, so that keys are hashed and tested in one compiled loop. Lambdas are kept out of it: Spark
    does not compile them, and would write a row with all words of the text for each word. So is what makes it longer than the JVM compiles.
    For a run of letters inside a word ``_w`` is the rest of the word, and ``_k`` counts on from 1.
    """
    w = docs.select(doc_id, F.split(text, " ").alias("_w"))
    each = w.select(doc_id, "_w", F.posexplode_outer("_w").alias("_i", "_x"))
    x, whole = F.col("_x"), F.length("_x") >= AFFIX
    keys = [F.when(F.col("_i") + WORDS[k] <= F.size("_w"), _run_hash(F.col("_w"), F.col("_i"), k)) for k in (RUN, STRETCH) if k in kinds]
    if INNER in kinds:
        keys.append(_tagged("word", x))
    if NEAR in kinds:
        keys.append(_near_hash(F.col("_w"), F.col("_i")))
    if AFFIXES in kinds:
        keys += [F.when(whole, _tagged("tail", F.right(x, F.lit(AFFIX)))), F.when(whole, _tagged("head", F.left(x, F.lit(AFFIX))))]
    found = []
    if keys:
        found.append(each.select(doc_id, "_w", "_i", F.explode_outer(F.array(*keys)).alias("_anchor")).withColumn("_k", F.lit(0)))
    if LONG in kinds:
        grams = F.transform(F.sequence(F.lit(1), F.length(x) - GRAM + 1), lambda i: _tagged("gram", x.substr(i, F.lit(GRAM))))
        long = each.where(F.length(x) >= GRAM).select(doc_id, "_i", "_x").select(doc_id, "_x", F.posexplode_outer(grams).alias("_j", "_anchor"))
        found.append(long.select(doc_id, F.array(x.substr(F.col("_j") + 1, F.length(x))).alias("_w"), F.lit(0).alias("_i"), "_anchor", (F.col("_j") + 1).alias("_k")))
    return union_all([f.select(doc_id, "_w", "_i", "_k", "_anchor") for f in found])


def _stands(w: Column, i: Column, k: Column) -> Column:
    """Does a fragment stand where its anchor's word is the i-th? As many words as it has can hold it in one way only."""
    cut = F.array_join(F.slice(w, F.greatest(i - F.col("_ahead"), F.lit(0)) + 1, F.col("_words")), " ")
    # of the rest of a word it is the beginning
    return (i >= F.col("_ahead")) & F.contains(cut, F.col("_frag")) & ((k == 0) | F.startswith(cut, F.col("_frag")))


def _places(placed: DataFrame, docs: DataFrame, doc_id: str, text: str, frag_id: str, kinds: list[str], common: DataFrame | None, limit: int) -> DataFrame:
    """(frag_id, doc_id), a row for every place of a text where the fragment stands.

    Without ``common`` all fragments are broadcast. With it those at the commonest anchors are, up to ``limit`` bytes, and are verified
    where a text is read: what the many texts that hold these anchors would send on is not sent on. The others are joined by their anchors.
    """
    kinds = set(kinds)
    w, i, k = F.col("_w"), F.col("_i"), F.col("_k")
    anchors = placed.select(frag_id, "_anchor", "_frag", "_ahead", "_words")
    if common is None:
        return _keyed(docs, doc_id, text, kinds).join(F.broadcast(anchors), "_anchor").where(_stands(w, i, k)).select(frag_id, doc_id)
    size = anchors.count()
    held = _holds(_bit_map(anchors, size), size)
    met = anchors.join(F.broadcast(common.select(F.col("h").alias("_anchor"), "texts")), "_anchor", "left")
    # few fragments of many words would widen what is sent on for all: their anchors count as the commonest
    wide = F.when(F.max("_words").over(Window.partitionBy("_anchor")) > WIDE_WORDS, F.lit(63)).otherwise(F.floor(F.log2("texts")))
    met = stage(met.withColumn("_often", F.coalesce(wide, F.lit(0)).cast("int")).drop("texts"))
    often, total = 64, 0
    for r in met.where("_often > 0").groupBy("_often").agg(_bytes("_frag")).orderBy(F.desc("_often")).collect():  # a row a power of two
        total += r[1]
        if total > limit:
            break
        often = r[0]
    hot = met.where(F.col("_often") >= often).select(F.col(frag_id).alias("_hot"), "_anchor", "_frag", "_ahead", "_words")
    back, on = met.where(F.col("_often") < often).agg(F.max("_ahead"), F.max(F.col("_words") - F.col("_ahead"))).first()
    back, on = back or 0, on or 0
    cold = F.col("_hot").isNull()
    sent = _keyed(docs, doc_id, text, kinds).where(held).join(F.broadcast(hot), "_anchor", "left").where(cold | _stands(w, i, k))
    # the words ahead of the key's own and from it on, as many as a fragment can reach
    near = F.array_join(F.slice(w, F.greatest(i - back, F.lit(0)) + 1, F.lit(back + on)), " ")
    sent = stage(sent.select(doc_id, "_hot", "_i", "_k", "_anchor", F.when(cold, near).alias("_near")))
    rare = sent.where("_hot IS NULL").select(doc_id, "_i", "_k", "_anchor", "_near")
    pairs = salted_join(rare, met.where(F.col("_often") < often).drop("_often"), ["_anchor"], [doc_id, "_i"], "inner")
    pairs = pairs.where(_stands(F.split("_near", " "), F.least(i, F.lit(back)), k)).select(frag_id, doc_id)
    return pairs.unionByName(sent.where("_hot IS NOT NULL").select(F.col("_hot").alias(frag_id), doc_id))


def located(
    frags: DataFrame, docs: DataFrame, *, frag_id: str, frag: str, doc_id: str, text: str, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """(frag_id, doc_id, n): how often every document that holds the fragment holds it, overlaps counted.

    No text is shuffled: what leaves a task is the letters around a key that some fragment has. A number as ``frag_id`` keeps the counts small.
    """
    # a text that cannot be null keeps the optimizer from testing, and so computing, it twice
    docs = docs.select(doc_id, F.coalesce(text, F.lit("")).alias(text))
    # a null or empty fragment is in no text
    asked = frags.select(frag_id, frag).filter(F.length(frag) > 0)
    anchored = with_anchor(asked, frag)
    sizes = dict(anchored.groupBy("_kind").agg(_bytes(frag)).collect())  # a row a kind
    found, common = [], None
    if set(sizes) - {BARE}:
        if _strategy(sum(n for kind, n in sizes.items() if kind != BARE), limit) == "shuffle":
            anchored = stage(with_anchor(asked, frag, stretches=True))
            looked = stage(drawn_texts(docs, doc_id))
            runs = []
            for kind in sorted({r[0] for r in anchored.select("_kind").distinct().collect()} - {BARE}):  # a row a kind
                # the texts are drawn already
                runs.append(common_runs(looked, doc_id, text, sample=1 << 62, kinds=frozenset({kind})))
                if kind in WORDS:
                    anchored = rarest_anchor(anchored, runs[-1], frag_id, frag, kind)
            common = union_all(runs)
        placed = stage(_placed(anchored, frag_id, frag))
        band = F.greatest(F.lit(0), F.ceil(F.log(F.col("_words") / F.lit(BAND_WORDS)) / F.log(F.lit(float(BAND_GROWTH))))).cast("int")
        reaches = placed.groupBy(band.alias("band")).agg(F.collect_set("_kind")).collect()
        found = [_places(placed.where(band == r[0]), docs, doc_id, text, frag_id, r[1], common, limit) for r in reaches]
    counted = [union_all(found).groupBy(frag_id, doc_id).agg(F.count(F.lit(1)).alias("n"))] if found else []
    if BARE in sizes or not found:
        # under fifteen letters and without a whole inner word: nothing to key on
        bare = anchored.filter(F.col("_kind") == BARE).select(frag_id, frag)
        rest = _nested(docs, bare, sizes.get(BARE, 0), max(limit, 1 << 20), text, frag)
        counted.append(rest.select(frag_id, doc_id, occurrences(F.col(text), F.col(frag)).cast("long").alias("n")))
    return union_all(counted)


def contained(
    frags: DataFrame,
    docs: DataFrame,
    *,
    frag_id: str,
    frag: str,
    doc_id: str,
    text: str,
    extra: dict[str, Column] | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """(frag_id, doc_id, *extra) for every document whose text holds the fragment as a substring.

    ``extra`` maps names to columns over ``frag`` and ``text`` that are
    evaluated on the verified pairs; only for them texts are fetched.
    """
    if not extra:
        return located(frags, docs, frag_id=frag_id, frag=frag, doc_id=doc_id, text=text, limit=limit).drop("n")
    # a text that cannot be null keeps the optimizer from testing, and so computing, it twice
    docs = docs.select(doc_id, F.coalesce(text, F.lit("")).alias(text))
    # a null or empty fragment is in no text
    anchored = with_anchor(frags.select(frag_id, frag).filter(F.length(frag) > 0), frag)
    sizes = dict(anchored.groupBy("_kind").agg(_bytes(frag)).collect())  # at most five rows
    found = []
    keyed = set(sizes) - {BARE}
    if keyed:
        many = sum(n for kind, n in sizes.items() if kind != BARE)
        strategy = _strategy(many, limit)
        if RUN in keyed and strategy == "shuffle":
            anchored = stage(with_anchor(frags.select(frag_id, frag).filter(F.length(frag) > 0), frag, stretches=True))
            keyed = {r[0] for r in anchored.select("_kind").distinct().collect()} - {BARE}  # at most six rows
            for kind in sorted(keyed & set(WORDS)):
                anchored = rarest_anchor(anchored, common_runs(docs, doc_id, text, kinds=frozenset({kind})), frag_id, frag, kind)
        anchors = anchored.filter(F.col("_anchor").isNotNull()).drop("_kind").select(frag_id, frag, "_anchor")
        found.append(_meet(anchors, docs, doc_id, text, _text_keys(F.col(text), keyed), strategy))
    if BARE in sizes or not found:
        # under fifteen letters and without a whole inner word: nothing to key on
        bare = anchored.filter(F.col("_kind") == BARE).select(frag_id, frag)
        found.append(_nested(docs.select(doc_id, text), bare, sizes.get(BARE, 0), max(limit, 1 << 20), text, frag))
    pairs = union_all([f.select(frag_id, frag, doc_id, text) for f in found])
    verified = pairs.filter(F.contains(F.col(text), F.col(frag)))
    return verified.select(frag_id, doc_id, *[c.alias(n) for n, c in extra.items()])


def contained_gapless(
    frags: DataFrame,
    docs: DataFrame,
    *,
    frag_id: str,
    frag: str,
    doc_id: str,
    text: str,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Like :func:`contained` on texts and fragments without their spaces.

    Word boundaries are gone, so the anchor is the first eight letters and a
    text offers every run of eight letters.
    """
    bare = frags.select(frag_id, F.translate(frag, " ", "").alias("_f"))
    solid = docs.select(doc_id, F.coalesce(F.translate(text, " ", ""), F.lit("")).alias("_t"))
    anchors = bare.withColumn("_anchor", F.xxhash64(F.left("_f", F.lit(GAPLESS_GRAM)))).filter(
        F.length("_f") >= GAPLESS_GRAM
    )
    size = anchors.agg(_bytes("_f")).first()[0] or 0
    runs = F.regexp_extract_all("_t", F.lit(rf"(?=(.{{{GAPLESS_GRAM}}}))"), F.lit(1))  # overlapping, in linear time
    keys = F.array_distinct(F.transform(runs, lambda g: F.xxhash64(g)))
    pairs = _meet(anchors, solid, doc_id, "_t", keys, _strategy(size, limit)).select(frag_id, "_f", doc_id, "_t")
    short = bare.filter(F.length("_f") < GAPLESS_GRAM)
    rest = _nested(solid, short, short.agg(_bytes("_f")).first()[0] or 0, max(limit, 1 << 20), "_t", "_f").select(frag_id, "_f", doc_id, "_t")
    return (
        pairs.filter(F.contains(F.col("_t"), F.col("_f"))).unionByName(rest).select(frag_id, doc_id)
    )
