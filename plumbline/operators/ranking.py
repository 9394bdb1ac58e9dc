"""TF-IDF cosine ranking of many texts against a stated set of queries, without the product of texts and queries.

Texts become narrow rows of those weighted terms that some query asks for. Each task keeps postings of the texts
at hand in order of impact, and a top list for each query; a term bounds what it can add by its largest
weight, and texts that cannot enter a list are not scored (max-score). Tasks send on their top lists
only, which are merged by rank: queries x lists x k rows a task at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.retrieval import QUERY_STOP, TOP, idf, term_counts, weights
from plumbline.operators.skew import salted_join
from plumbline.session import spread, stage

# Weighted terms of queries that a task holds at once (some 20 MB); further queries go in further blocks.
BLOCK_TERMS = 1 << 18
SLACK = 1e-8
DIGITS = 9  # equal texts must tie exactly, whatever the order of the sum
RANKED = "list string, query long, doc long, sim double"


def text_vectors(counts: DataFrame, table: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, terms, weights): the asked terms of each text, with their share of the text's unit vector."""
    marked = table.join(asked.withColumn("_asked", F.lit(True)), "term", "left")
    raw = salted_join(counts, marked, ["term"], ["doc"], "inner").select("doc", "term", "_asked", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    kept = F.collect_list(F.when(F.col("_asked"), F.struct("term", "raw")))
    sums = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), kept.alias("kept")).where(F.size("kept") > 0)
    return sums.select("doc", F.col("kept.term").alias("terms"), F.transform("kept.raw", lambda x: x / F.col("norm")).alias("weights"))


class Queries:
    """A block of queries with terms as numbers."""

    def __init__(self, rows: list):
        self.ids, self.parties = [r.query for r in rows], [r.party for r in rows]
        self.terms = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.terms}))}
        self.of = [(np.array([self.terms[t] for t in r.terms], np.int64), np.array(r.weights)) for r in rows]


class Tops:
    """The best k texts of each list of each query, as far as a task has seen."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.best: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(n)]

    def least(self, q: int, name: str) -> float:
        sims = self.best[q].get(name, ((), ()))[0]
        return float(sims[-1]) if len(sims) == self.k else 0.0

    def offer(self, q: int, name: str, sims: np.ndarray, docs: np.ndarray) -> None:
        old = self.best[q].get(name, (np.zeros(0), np.zeros(0, np.int64)))
        sims, docs = np.concatenate((old[0], sims)), np.concatenate((old[1], docs))
        order = np.lexsort((docs, -sims))[: self.k]
        self.best[q][name] = (sims[order], docs[order])

    def rows(self, ids: list[int]) -> pa.RecordBatch:
        found = [(name, i, d, s) for i, lists in zip(ids, self.best) for name, (sims, docs) in lists.items() for s, d in zip(sims.tolist(), docs.tolist())]
        columns = list(zip(*found)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["list", "query", "doc", "sim"])


class Postings:
    """The asked terms of a batch of texts: by term, the largest weight first."""

    def __init__(self, batch: pa.RecordBatch, terms: dict[str, int]):
        words = batch.column("terms")
        encoded = words.flatten().dictionary_encode()
        number = np.array([terms.get(t, -1) for t in encoded.dictionary.to_pylist()] or [0], np.int64)[encoded.indices.to_numpy()]
        text = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets.to_numpy()))
        weight = batch.column("weights").flatten().to_numpy()
        here = number >= 0
        number, text, weight = number[here], text[here], weight[here]
        order = np.lexsort((-weight, number))
        self.text, self.weight = text[order], weight[order]
        self.first = np.searchsorted(number[order], np.arange(len(terms) + 1))
        self.rows = batch.num_rows
        self.docs = batch.column("doc").to_numpy()
        names = batch.column("name").dictionary_encode()
        self.names, self.name = [(n or "").lower() for n in names.dictionary.to_pylist()], names.indices.fill_null(-1).to_numpy()
        lists = batch.column("lists")
        member, owner = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        self.lists = {n: np.bincount(owner[member.to_numpy(zero_copy_only=False) == n], minlength=self.rows) > 0 for n in member.unique().to_pylist()}
        self.barred: dict[str, np.ndarray] = {}

    def open_to(self, party: str | None) -> np.ndarray:
        """Texts whose name does not hold the party."""
        if party not in self.barred:
            held = np.array([bool(party) and party in n for n in self.names] + [False])
            self.barred[party] = ~held[self.name]
        return self.barred[party]

    def sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the terms add to each text."""
        at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in terms]) if len(terms) else np.zeros(0, np.int64)
        scale = np.repeat(weights, self.first[terms + 1] - self.first[terms])
        return np.bincount(self.text[at], self.weight[at] * scale, self.rows)

    def meet(self, q: int, terms: np.ndarray, weights: np.ndarray, party: str | None, tops: Tops) -> None:
        least = {n: tops.least(q, n) for n in self.lists}
        low = min(least.values(), default=0.0) - SLACK
        some = self.first[terms + 1] > self.first[terms]
        terms, weights = terms[some], weights[some]
        bounds = weights * self.weight[self.first[terms]] if len(terms) else weights
        order = np.argsort(-bounds, kind="stable")
        terms, weights = terms[order], weights[order]
        rest = np.cumsum(bounds[order][::-1])[::-1]  # what this term and those after it can add
        needed = int((rest >= low).sum())  # a text with none of these terms stays below
        if not needed:
            return
        sims = self.sums(terms[:needed], weights[:needed])
        after = rest[needed] if needed < len(rest) else 0.0
        open_to = (sims > 0) & (sims + after >= low) & self.open_to(party)
        if not open_to.any():
            return
        if needed < len(terms):
            sims += self.sums(terms[needed:], weights[needed:])
        sims = np.round(sims, DIGITS)
        for name, members in self.lists.items():
            fits = np.flatnonzero(open_to & members & (sims >= least[name]))
            if len(fits):
                tops.offer(q, name, sims[fits], self.docs[fits])


def _rank(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        tops = Tops(len(queries.ids), k)
        for batch in batches:
            if batch.num_rows:
                postings = Postings(batch, queries.terms)
                for q, (terms, weight) in enumerate(queries.of):
                    postings.meet(q, terms, weight, queries.parties[q], tops)
        yield tops.rows(queries.ids)

    return run


def top_by_cosine(
    docs: DataFrame, queries: DataFrame, *, k: int = TOP, min_df: int = 3, max_df: float = 0.5, stop: list[str] = QUERY_STOP, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(list, query, doc, rank, sim): the k texts of each list nearest to each query.

    ``docs``: doc (long), text, name, lists (the lists a text may enter); ``queries``: query (long), text, party. A text
    whose name holds the query's party is passed over, and takes no place. The vocabulary is fitted on the texts.
    """
    counts = stage(term_counts(docs, "doc", "text", stop))  # tokenised once; three branches read it
    table = stage(idf(counts, docs.agg(F.count(F.lit(1)).alias("n")), min_df, max_df))
    asked = stage(
        weights(stage(term_counts(queries, "query", "text", stop)), table, "query")
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t")).join(queries.select("query", "party"), "query")
        .select("query", "party", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))
    )
    vectors = text_vectors(counts, table, asked.select(F.explode("terms").alias("term")).distinct())
    rows = stage(vectors.join(docs.select("doc", "name", "lists"), "doc"))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block_terms)
    found = None
    for b in range(blocks):
        block = Queries(asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).orderBy("query").collect())  # about block_terms terms
        part = spread(rows).mapInArrow(_rank(rows.sparkSession.sparkContext.broadcast(block), k), RANKED)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], RANKED)
    order = Window.partitionBy("list", "query").orderBy(F.desc("sim"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("list", "query", "doc", F.col("rank").cast("long").alias("rank"), "sim")
