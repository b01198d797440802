"""Ranked lexical search over a clustered index with exact stopping.

Index. One pass over whole texts counts each document's terms. Documents are dealt evenly to blocks of bounded size;
within a block, recursive graph bisection reorders them: a node's documents are halved, and pairs are swapped between the
halves as long as that makes the terms' lists cheaper to code (the gain of moving a document is summed over its terms).
Runs of ``CLUSTER`` documents in that order are the clusters. A cluster holds its postings by term, and for each term how
many documents have it and the highest impact that it has in any of them. All documents and terms are indexed.

Search. Queries come in blocks of bounded size, whose terms every task has. A cluster's bound for a query is the sum of
its terms' highest impacts, weighted: no document of it scores more. Each query first visits its few clusters of the
highest bounds anywhere; its tenth score is the threshold of the second pass, where each task visits clusters by
descending bound and stops at the first whose bound is under the threshold, which the task's own finds raise. A cluster
whose bound equals the threshold is visited, since a smaller doc_id wins a tie. So the answer is that of scoring all.

Terms are compared by 64-bit hashes: in a corpus of 10**9 distinct terms, a wrong match of any of 10**5 query terms has a
probability of 5e-6. Scores are exact integers.

Nulls: a null or empty text, or one without terms, is no document and no query; a document without a doc_id comes after
others of equal score. Rows of one doc_id are documents of their own, rows of one item_id queries of their own. Other
columns are ignored. Empty tables give no rows. Tables that the result reads stay in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.common import Words, discard, materialize, small_batches, sub_batches

#: Documents of a cluster, and documents and postings of a block that a task reorders.
CLUSTER, BLOCK_DOCS, BLOCK_POSTINGS = 256, 4096, 1 << 19
#: Rounds of swaps in a node.
SWAPS = 6
#: Clusters that a query visits first, and distinct terms of a block of queries.
FIRST, QUERY_TERMS = 4, 1 << 18
TOP = 10
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Sums of doubles are exact below this.
EXACT = 1 << 53
CLUSTERS = "cluster long, terms array<long>, dfs array<int>, best array<int>, doc_ids array<long>, lengths array<long>, places array<int>, tfs array<int>"
LAST = np.iinfo(np.int64).max


def _list(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _one(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def counted(docs: DataFrame, key: str) -> DataFrame:
    """(key, n, terms, tfs): each text's terms with repeats, and its distinct ones, by hash, with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", encoders=False):
            w = Words(batch.column("text"), lower=True, outside=_OUTSIDE)
            h = w.hashes().view(np.int64)
            order = np.lexsort((h, w.doc))
            h, d = h[order], w.doc[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))) if len(h) else np.zeros(0, np.int64)
            tfs = np.diff(np.append(first, len(h)))
            at = np.searchsorted(d[first], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(w.counts.astype(np.int64)), _list(h[first], at), _list(tfs.astype(np.int32), at)], [key, "n", "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(count, f"{key} {kind}, n long, terms array<long>, tfs array<int>")


def bisect(doc: np.ndarray, term: np.ndarray, n: int, leaf: int = CLUSTER, swaps: int = SWAPS) -> tuple[np.ndarray, np.ndarray]:
    """An order of n documents by recursive graph bisection, and the cuts of its leaves of at most ``leaf`` documents.

    ``doc``, ``term``: the postings. All nodes of a level are halved at once. Terms of one document, or of more than half
    of them, say nothing about the order and are left out.
    """
    depth = max(0, (-(-n // leaf) - 1).bit_length())
    cut = lambda level: (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level
    order = np.arange(n)
    _, term, df = np.unique(term, return_inverse=True, return_counts=True)
    told = ((df > 1) & (2 * df <= n))[term]
    doc, term = doc[told], term[told]
    for level in range(depth):
        halves = cut(level + 1)
        half = np.empty(n, np.int64)
        half[order] = np.repeat(np.arange(len(halves) - 1), np.diff(halves))
        node = half[doc] >> 1
        keys, key = np.unique(node * (len(df) + 1) + term, return_inverse=True)
        size = np.diff(halves)
        nl, nr = size[2 * (keys // (len(df) + 1))].astype(float), size[2 * (keys // (len(df) + 1)) + 1].astype(float)
        cost = lambda d, m: d * np.log2(m / (d + 1))
        # each place of a left half has a partner in the right one
        left = np.concatenate([np.arange(halves[k], halves[k] + min(size[k], size[k + 1])) for k in range(0, len(size), 2)])
        right = np.concatenate([np.arange(halves[k + 1], halves[k + 1] + min(size[k], size[k + 1])) for k in range(0, len(size), 2)])
        for _ in range(swaps):
            odd = (half[doc] & 1).astype(bool)
            dr = np.bincount(key[odd], minlength=len(keys)).astype(float)
            dl = np.bincount(key[~odd], minlength=len(keys)).astype(float)
            now = cost(dl, nl) + cost(dr, nr)
            to_right = now - cost(np.maximum(dl - 1, 0), nl) - cost(dr + 1, nr)
            to_left = now - cost(dl + 1, nl) - cost(np.maximum(dr - 1, 0), nr)
            gain = np.bincount(doc, weights=np.where(odd, to_left[key], to_right[key]), minlength=n)
            order = np.lexsort((-gain, half))
            better = gain[order[left]] + gain[order[right]] > 1e-9
            if not better.any():
                break
            a, b = left[better], right[better]
            order[a], order[b] = order[b], order[a]
            half[order] = np.repeat(np.arange(len(halves) - 1), size)
    return order, cut(depth)


@dataclass
class Index:
    """``clusters`` (``CLUSTERS``), the number of documents with terms, and all their terms with repeats."""

    clusters: DataFrame
    documents: int
    terms: int


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What an occurrence counts: integers under a million, more for more of the term and for a shorter text."""
    m = 25 + (75 * length * documents) // max(1, terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def build_index(docs: DataFrame, cluster: int = CLUSTER, block_docs: int = BLOCK_DOCS) -> Index:
    """The clustered index of all rows of ``docs`` (doc_id, text) that have terms."""
    forward = materialize(counted(docs, "doc_id").where("n > 0"), "terms")
    documents, terms, postings = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-documents // block_docs), -(-postings // BLOCK_POSTINGS))

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        del held
        lists = t["terms"].combine_chunks()
        term, tf = lists.flatten().to_numpy(), t["tfs"].combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        length = t["n"].to_numpy()
        ids = t["doc_id"].to_pylist()
        order, cuts = bisect(doc, term, t.num_rows, cluster)
        place = np.empty(t.num_rows, np.int64)
        place[order] = np.arange(t.num_rows)
        at = place[doc]
        number = np.searchsorted(cuts, at, "right") - 1
        by = np.lexsort((at, term, number))
        term, tf, at, number, impact = term[by], tf[by], at[by], number[by], impacts(tf.astype(np.int64), length[doc], documents, terms)[by]
        ends = np.searchsorted(number, np.arange(len(cuts)))
        base = TaskContext.get().partitionId() << 24
        for k in range(len(cuts) - 1):
            a, b = ends[k], ends[k + 1]
            if a == b:
                continue
            first = np.flatnonzero(np.append(True, term[a + 1 : b] != term[a : b - 1]))
            own = order[cuts[k] : cuts[k + 1]]
            columns = [
                pa.array([base + k], pa.int64()),
                _one(term[a:b][first], pa.int64()),
                _one(np.diff(np.append(first, b - a)).astype(np.int32), pa.int32()),
                _one(np.maximum.reduceat(impact[a:b], first).astype(np.int32), pa.int32()),
                _one([ids[i] for i in own], pa.int64()),
                _one(length[own], pa.int64()),
                _one((at[a:b] - cuts[k]).astype(np.int32), pa.int32()),
                _one(tf[a:b], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CLUSTERS.split(", ")])

    clusters = materialize(forward.repartition(blocks).mapInArrow(arrange, CLUSTERS), "clusters")
    discard(forward)
    return Index(clusters, documents, terms)


class Queries:
    """A block of queries: their numbers, their distinct terms in one sorted vocabulary, and how often each has them."""

    def __init__(self, rows: list):
        self.numbers = np.array([r["q"] for r in rows], np.int64)
        self.at = np.concatenate(([0], np.cumsum([len(r["terms"]) for r in rows]))).astype(np.int64)
        flat = np.array([t for r in rows for t in r["terms"]], np.int64)
        self.vocabulary, self.term = np.unique(flat, return_inverse=True)
        self.count = np.array([c for r in rows for c in r["tfs"]], np.int64)
        self.weight = np.zeros(len(self.vocabulary), np.int64)

    def __len__(self) -> int:
        return len(self.numbers)

    def where(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term of the vocabulary among a cluster's sorted ones, or -1."""
        p = np.minimum(np.searchsorted(terms, self.vocabulary), len(terms) - 1)
        return np.where(terms[p] == self.vocabulary, p, -1)

    def bounds(self, place: np.ndarray, best: np.ndarray) -> np.ndarray:
        """What no document of the cluster exceeds, for each query."""
        most = np.where(place >= 0, best[place].astype(np.int64), 0) * self.weight
        return np.add.reduceat(most[self.term] * self.count, self.at[:-1])


def _values(batch: pa.RecordBatch, column: str, r: int) -> np.ndarray:
    return batch.column(column)[r].values.to_numpy(zero_copy_only=False)


class Cluster:
    """One cluster with its postings, ready to score."""

    def __init__(self, batch: pa.RecordBatch, r: int, place: np.ndarray, documents: int, terms: int):
        self.place, self.dfs = place, _values(batch, "dfs", r).astype(np.int64)
        self.ptr = np.cumsum(self.dfs) - self.dfs
        self.docs = _values(batch, "places", r)
        self.impact = impacts(_values(batch, "tfs", r).astype(np.int64), _values(batch, "lengths", r)[self.docs], documents, terms)
        self.ids = batch.column("doc_ids")[r].values.fill_null(LAST).to_numpy()

    def top(self, queries: Queries, i: int, bound: int, least: int, k: int) -> list[tuple[int, int]]:
        """(-score, doc_id) of the query's best k documents here, of those that score ``least`` or more."""
        span = slice(queries.at[i], queries.at[i + 1])
        term = queries.term[span]
        p = self.place[term]
        here = p >= 0
        p, weight = p[here], (queries.weight[term] * queries.count[span])[here]
        n = self.dfs[p]
        upto = np.cumsum(n)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.ptr[p] - (upto - n), n)
        parts, docs = np.repeat(weight, n) * self.impact[at], self.docs[at]
        if bound < EXACT:
            scores = np.bincount(docs, weights=parts, minlength=len(self.ids)).astype(np.int64)
        else:
            scores = np.zeros(len(self.ids), np.int64)
            np.add.at(scores, docs, parts)
        some = np.flatnonzero(scores >= max(1, least))
        some = some[np.lexsort((self.ids[some], -scores[some]))[:k]]
        return list(zip((-scores[some]).tolist(), self.ids[some].tolist(), strict=True))


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    q, score, doc = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([None if d == LAST else d for d in doc], pa.int64()), pa.array([-s for s in score], pa.int64())], ["q", "doc_id", "score"])


def _search_block(index: Index, queries: Queries, k: int, first: int) -> DataFrame:
    """(q, doc_id, score) of candidates of each query, the best k among them."""
    spark = index.clusters.sparkSession
    send = spark.sparkContext.broadcast
    documents, terms, head = index.documents, index.terms, index.clusters.select("cluster", "terms", "dfs", "best")
    held = send(queries)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value.vocabulary), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                place = held.value.where(_values(batch, "terms", r))
                total += np.where(place >= 0, _values(batch, "dfs", r)[place], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "df"])

    df = np.zeros(len(queries.vocabulary), np.int64)
    for r in head.select("terms", "dfs").mapInArrow(frequencies, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r["t"]] = r["df"]
    queries.weight = np.where(df > 0, np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))), 0).astype(np.int64)
    held = send(queries)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        bound, cluster = np.zeros((0, len(own)), np.int64), np.zeros((0, len(own)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.array([own.bounds(own.where(_values(batch, "terms", r)), _values(batch, "best", r)) for r in range(batch.num_rows)])
            bound = np.concatenate((bound, more))
            cluster = np.concatenate((cluster, np.repeat(batch.column("cluster").to_numpy()[:, None], len(own), 1)))
            keep = np.argsort(-bound, axis=0, kind="stable")[:first]
            bound, cluster = np.take_along_axis(bound, keep, 0), np.take_along_axis(cluster, keep, 0)
        at, q = np.nonzero(bound)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cluster[at, q]), pa.array(bound[at, q])], ["i", "cluster", "bound"])

    best = Window.partitionBy("i").orderBy(F.desc("bound"), "cluster")
    ranked = head.select("cluster", "terms", "best").mapInArrow(highest, "i long, cluster long, bound long").withColumn("r", F.row_number().over(best)).where(F.col("r") <= first)
    picks: dict[int, list[int]] = {}
    for r in ranked.select("i", "cluster").collect():
        picks.setdefault(r["cluster"], []).append(r["i"])
    chosen, thresholds = send(picks), send(np.zeros(len(queries), np.int64))

    def visit(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, early, least = held.value, chosen.value, thresholds.value.copy()
            kept: dict[int, list[tuple[int, int]]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                number = batch.column("cluster").to_pylist()
                places = [own.where(_values(batch, "terms", r)) for r in range(batch.num_rows)]
                bound = np.array([own.bounds(p, _values(batch, "best", r)) for r, p in enumerate(places)])
                done = np.zeros(bound.shape, bool)
                for r, c in enumerate(number):
                    done[r, early.get(c, [])] = True
                bound[done == later] = 0
                ready: dict[int, Cluster] = {}
                for i in np.flatnonzero((bound >= np.maximum(least, 1)).any(axis=0)).tolist():
                    for r in np.argsort(-bound[:, i], kind="stable").tolist():
                        if bound[r, i] < max(1, least[i]):
                            break
                        if r not in ready:
                            ready[r] = Cluster(batch, r, places[r], documents, terms)
                        got = sorted(kept.get(i, []) + ready[r].top(own, i, int(bound[r, i]), int(least[i]), k))[:k]
                        kept[i] = got
                        if len(got) == k:
                            least[i] = max(least[i], -got[-1][0])
            yield _found([(int(own.numbers[i]), s, d) for i, got in kept.items() for s, d in got])

        return run

    chosen_rows = spark.createDataFrame([(c,) for c in picks], "cluster long")
    early = materialize(index.clusters.join(F.broadcast(chosen_rows), "cluster", "left_semi").mapInArrow(visit(False), "q long, doc_id long, score long"), "early")
    place = {int(q): i for i, q in enumerate(queries.numbers)}
    least = np.zeros(len(queries), np.int64)
    last = Window.partitionBy("q").orderBy(F.desc("score"))
    for r in early.withColumn("r", F.row_number().over(last)).where(F.col("r") == k).select("q", "score").collect():
        least[place[r["q"]]] = r["score"]
    thresholds = send(least)
    return early.union(materialize(index.clusters.mapInArrow(visit(True), "q long, doc_id long, score long"), "late"))


def search(index: Index, items: DataFrame, k: int = TOP, first: int = FIRST, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of ``items`` (item_id, text), scores above 0.

    Queries are sent to the tasks in as many blocks as their distinct terms need, so that a block's size is bounded.
    """
    spark = index.clusters.sparkSession
    numbered = materialize(items.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"), "items")
    rows, names = materialize(counted(numbered, "q").where("n > 0"), "queries"), numbered.select("q", "item_id")
    blocks = max(1, -(-(rows.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0) // query_terms))
    found = None
    with small_batches(spark):
        for b in range(blocks):
            own = rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
            if own:
                block = _search_block(index, Queries(own), k, first)
                found = block if found is None else found.union(block)
    if found is None:
        return names.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(names, "q").select("item_id", "rank", "doc_id", "score")


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``documents`` and ``benchmark``: every document is scored."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, {terms} AS terms FROM documents WHERE text IS NOT NULL),
own AS (SELECT id, doc_id, len(terms)::BIGINT AS n, terms FROM docs WHERE len(terms) > 0),
every AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM own),
tf AS (SELECT id, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT id, doc_id, n, unnest(terms) AS term FROM own) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w FROM df, every),
asked AS (SELECT q, item_id, term, count(*)::BIGINT AS c FROM (SELECT row_number() OVER () AS q, item_id, unnest({terms}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
scored AS (SELECT q, item_id, id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), every GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
