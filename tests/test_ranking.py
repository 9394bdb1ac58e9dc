"""Max-score ranking against all sums, with parties, lists, ties and blocks of queries."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from plumbline.operators import ranking as G

WORDS = [f"w{i}" for i in range(60)]


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, [1 / (1 + i) for i in range(60)], k=r.randint(0, 25))) for _ in range(n)]


def expected(docs, asked, k):
    tf = {d: Counter(t.split()) for d, t, _, _ in docs}
    df = Counter(w for c in tf.values() for w in c)
    n = len(docs)
    idf = {w: math.log((1 + n) / (1 + v)) + 1 for w, v in df.items() if 3 <= v <= n / 2}

    def unit(c):
        raw = {w: (1 + math.log(v)) * idf[w] for w, v in c.items() if w in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    vectors, out = {d: unit(c) for d, c in tf.items()}, []
    for q, text, party in asked:
        u = unit(Counter(text.split()))
        sims = {d: round(sum(x * v.get(w, 0) for w, x in u.items()), 9) for d, v in vectors.items()}
        for name in ("all", "old"):
            fits = sorted((-s, d) for d, _, held, lists in docs if name in lists and not (party and party in held.lower()) for s in [sims[d]] if s > 0)
            out += [(name, q, d, i, -s) for i, (s, d) in enumerate(fits[:k], 1)]
    return sorted(out)


def test_equal_to_all_sums(spark):
    body = texts(150, 1)
    body += body[:30]  # equal texts tie
    docs = [(i, t, f"Name{i % 7} Co", ["all", "old"] if i % 3 == 0 else ["all"]) for i, t in enumerate(body)]
    asked = [(i, t, p) for i, (t, p) in enumerate(zip(texts(12, 2), ["name3", None, "", "co", "x"] * 3))]
    d = spark.createDataFrame(docs, "doc long, text string, name string, lists array<string>")
    q = spark.createDataFrame(asked, "query long, text string, party string")
    for block in (1 << 18, 20):
        got = G.top_by_cosine(d, q, k=5, stop=[], block_terms=block)
        assert sorted(map(tuple, got.collect())) == expected(docs, asked, 5)
    assert G.top_by_cosine(d, q.limit(0), k=5).collect() == []
    assert G.top_by_cosine(d.limit(0), q, k=5).collect() == []


def test_low_texts_are_passed_over():
    """With a full list, texts that only hold light terms are not scored."""
    rows = 400
    terms = [["heavy", "light"] if i < 10 else ["light"] for i in range(rows)]
    weight = [[0.9, 0.1] if i < 10 else [0.2] for i in range(rows)]
    batch = pa.RecordBatch.from_pydict({"doc": range(rows), "name": ["n"] * rows, "lists": [["all"]] * rows, "terms": terms, "weights": weight})
    p = G.Postings(batch, {"heavy": 0, "light": 1})
    tops = G.Tops(1, 10)
    p.meet(0, np.array([1, 0]), np.array([0.3, 0.9]), None, tops)
    seen = []
    sums = p.sums
    p.sums = lambda t, w: seen.append(list(t)) or sums(t, w)
    p.meet(0, np.array([1, 0]), np.array([0.3, 0.9]), None, tops)
    assert seen[0] == [0]  # the heavy term alone can lift a text into the list
    assert tops.rows([0]).num_rows == 10


def test_words_are_counted_where_their_text_is(spark):
    import io
    from contextlib import redirect_stdout

    from plumbline.operators.retrieval import term_counts

    docs = spark.createDataFrame([(1, "tax law tax"), (2, "law"), (1, "tax")], "doc long, text string")
    counts = term_counts(docs, "doc", "text", ["of"])
    out = io.StringIO()
    with redirect_stdout(out):
        counts.explain()
    assert "hashpartitioning(doc" in out.getvalue() and "term#" not in "".join(x for x in out.getvalue().splitlines() if "hashpartitioning" in x)
    assert sorted(map(tuple, counts.collect())) == [(1, "law", 1), (1, "tax", 3), (2, "law", 1)]
