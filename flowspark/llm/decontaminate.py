"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased. A document that shares a seed (five tokens in a row) with a
benchmark item is tiled against it: the longest common unmarked runs are found by running Karp-Rabin over falling
lengths, marked in both, and searched again until none of five tokens is left. Tiles may come in any order, so a passage
with its sentences moved is caught. The share of the item's tokens under tiles is its coverage.

Seeds that a tile could be made of bound the coverage from above; pairs below the threshold by that bound aren't tiled.
The benchmark is broadcast where its measured size allows; beyond, seeds are joined by a shuffle, with the same result.

Nulls: a null text has no tokens, an item of fewer than five tokens matches nothing. Null doc_ids and item_ids are
carried. Rows of one doc_id are one document each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import Words, doc_windows, free_name, materialize, sub_batches, window_hashes

SEED = 5
COVERAGE = 0.5
BROADCAST_BYTES = 16 << 20
PAIRS = "doc_id long, item_id long, item_tokens int, matched int, tiles int, longest int, coverage double"
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


class _Tokens(Words):
    """Words of lower-cased texts; ASCII punctuation parts them."""

    def __init__(self, texts: pa.Array):
        lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        blank = lowered.cast(pa.large_binary())
        offsets = np.frombuffer(blank.buffers()[1], np.int64)[blank.offset : blank.offset + len(blank) + 1]
        data = np.frombuffer(blank.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].copy()
        data[_PUNCTUATION[data]] = 32
        super().__init__(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(blank), [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(data)]))


def tile(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (at in item, at in text, length) of greedy string tiling by running Karp-Rabin."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(len(item), 20))
    while True:
        found = _matches(item, text, free_i, free_t, length)
        longest = found[0][2] if found else 0
        if longest > 2 * length:
            length = longest
            continue
        for i, t, n in found:
            if free_i[i : i + n].all() and free_t[t : t + n].all():
                free_i[i : i + n] = free_t[t : t + n] = False
                tiles.append((i, t, n))
        if found:  # what these tiles left of shorter ones is found again
            continue
        if length == least:
            return tiles
        length = length // 2 if length > 2 * least else least


def _runs(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of runs of ``length`` unmarked tokens."""
    sums = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(sums[length:] - sums[:-length] == length) if len(free) >= length else np.zeros(0, np.int64)


def _left(at: np.ndarray, tokens: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each place, and whether there is an unmarked one."""
    some = (at > 0) & free[at - 1]
    return np.where(some, tokens[at - 1], 0), some


def _matches(item, text, free_i, free_t, length) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches of at least ``length`` tokens, longest first, then by place.

    Only pairs that begin a match are made: those whose tokens before differ, so that a word repeated in both takes no
    more than their two lengths.
    """
    at_i, at_t = _runs(free_i, length), _runs(free_t, length)
    if not len(at_i) or not len(at_t):
        return []
    h_i, h_t = window_hashes(item, length)[at_i], window_hashes(text, length)[at_t]
    (left_i, some_i), (left_t, some_t) = _left(at_i, item, free_i), _left(at_t, text, free_t)
    order = np.lexsort((left_i, some_i, h_i))
    at_i, h_i, left_i, some_i = at_i[order], h_i[order], left_i[order], some_i[order]
    begin, end = np.searchsorted(h_i, h_t, "left"), np.searchsorted(h_i, h_t, "right")
    out = []
    for k in np.flatnonzero(end > begin):
        a, b, t = int(begin[k]), int(end[k]), int(at_t[k])
        starts = at_i[a:b]
        if some_t[k]:
            first = a + int(np.searchsorted(some_i[a:b], True))  # those with a token before come last, by that token
            lo, hi = (first + int(np.searchsorted(left_i[first:b], left_t[k], side)) for side in ("left", "right"))
            if hi - lo == b - a:
                continue
            starts = np.concatenate((at_i[a:lo], at_i[hi:b]))
        for i in starts.tolist():
            n = min(len(item) - i, len(text) - t)
            unlike = np.flatnonzero((item[i + length : i + n] != text[t + length : t + n]) | ~free_i[i + length : i + n] | ~free_t[t + length : t + n])
            out.append((i, t, length + int(unlike[0]) if len(unlike) else n))
    return sorted(out, key=lambda m: (-m[2], m[0], m[1]))


class Benchmark:
    """Items' tokens and seeds, small enough to send to every task."""

    def __init__(self, ids: list, texts: list, seed: int):
        w = _Tokens(pa.array(texts, pa.large_string()))
        h = w.hashes()
        self.ids, self.seed = ids, seed
        self.tokens = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        hashes, at = doc_windows(w, h, seed)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item = hashes[order], w.doc[at][order]
        self.place = (at - w.first[w.doc[at]])[order]
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.hashes >> np.uint64(46)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each window with a seed, and index of that seed, for all of its items."""
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(46)).astype(np.int64)])
        left, right = np.searchsorted(self.hashes, hashes[some], "left"), np.searchsorted(self.hashes, hashes[some], "right")
        n = right - left
        ends = np.cumsum(n)
        return np.repeat(some, n), np.repeat(left, n) + np.arange(n.sum()) - np.repeat(ends - n, n)

    def reach(self, seeds: np.ndarray, item: int) -> int:
        """Tokens of an item that lie under any of these seeds."""
        under = np.zeros(len(self.tokens[item]) + 1, np.int64)
        at = np.unique(self.place[seeds])
        under[at] += 1
        under[np.minimum(at + self.seed, len(under) - 1)] -= 1
        return int((np.cumsum(under[:-1]) > 0).sum())

    def leaks(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, int, list]]:
        """(index of the text, item_id, tokens of the item, tiles) of each pair of at least ``coverage``."""
        w = _Tokens(texts)
        h = w.hashes()
        hashes, at = doc_windows(w, h, self.seed)
        window, found = self.hits(hashes)
        doc, item = w.doc[at[window]], self.item[found]
        order = np.lexsort((item, doc))
        doc, item, found = doc[order], item[order], found[order]
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1 if len(doc) else []
        for a, b in zip([0, *cuts], [*cuts, len(doc)], strict=True):
            if b > a:
                i, d = int(item[a]), int(doc[a])
                tokens = self.tokens[i]
                if self.reach(found[a:b], i) >= coverage * len(tokens):
                    tiles = tile(tokens, h[w.first[d] : w.first[d + 1]], self.seed)
                    if sum(n for _, _, n in tiles) >= coverage * len(tokens):
                        yield d, self.ids[i], len(tokens), tiles


def _row(doc, item, tokens: int, tiles: list[tuple[int, int, int]]) -> tuple:
    matched = sum(n for _, _, n in tiles)
    return doc, item, tokens, matched, len(tiles), max((n for _, _, n in tiles), default=0), matched / tokens


def _table(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    names = ("doc_id", "item_id", "item_tokens", "matched", "tiles", "longest", "coverage")
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def _held(benchmark: DataFrame, most: int):
    """The items as a broadcast variable, or None if they may take more than ``most`` bytes."""
    benchmark = benchmark.select("item_id", "text").where("text is not null")
    size = benchmark.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size[0] or 0) + 64 * size[1] > most:
        return None
    rows = benchmark.orderBy("item_id", "text").collect()
    return benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` (with a column text) without the rows that hold a benchmark item, all columns kept."""
    held = _held(benchmark, broadcast_bytes)
    if held is None:
        row = free_name(docs, "row")
        numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
        found = _joined(numbered.select(F.col(row).alias("k"), F.col(row).alias("doc_id"), "text"), benchmark, coverage, seed)
        return numbered.join(found.select(F.col("k").alias(row)).distinct(), row, "left_anti").drop(row)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*held.value, seed)
        for batch in sub_batches(batches, "text"):
            keep = np.ones(batch.num_rows, bool)
            keep[[d for d, *_ in bench.leaks(batch.column("text"), coverage)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(sift, docs.schema)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text) with at least ``coverage`` of the item tiled."""
    held = _held(benchmark, broadcast_bytes)
    if held is None:
        return _joined(docs.select(F.monotonically_increasing_id().alias("k"), "doc_id", "text"), benchmark, coverage, seed).drop("k")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*held.value, seed)
        for batch in sub_batches(batches, "text"):
            ids = batch.column("doc_id")
            yield _table([_row(ids[d].as_py(), *rest) for d, *rest in bench.leaks(batch.column("text"), coverage)])

    return docs.select("doc_id", "text").mapInArrow(search, PAIRS)


def _joined(docs: DataFrame, benchmark: DataFrame, coverage: float, seed: int) -> DataFrame:
    """k and the pairs by joins on seeds, for a benchmark too large to broadcast; k: a key of each row of ``docs``."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            w = _Tokens(batch.column("text"))
            hashes, at = doc_windows(w, w.hashes(), seed)
            pairs = np.unique(np.stack([w.doc[at].astype(np.uint64), hashes]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys[pairs[0].astype(np.int64)]), pa.array(pairs[1].view(np.int64))], ["k", "hash"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            w = _Tokens(batch.column("text"))
            hashes, at = doc_windows(w, w.hashes(), seed)
            pairs, c = np.unique(np.stack([w.doc[at].astype(np.uint64), hashes]), axis=1, return_counts=True) if len(at) else (np.zeros((2, 0), np.uint64), np.zeros(0, np.int64))
            item = pairs[0].astype(np.int64)
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys[item]), pa.array(pairs[1].view(np.int64)), pa.array(c.astype(np.int64)), pa.array(w.counts[item].astype(np.int64))], ["i", "hash", "c", "n"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            w, v = _Tokens(batch.column("text")), _Tokens(batch.column("item"))
            h, g = w.hashes(), v.hashes()
            out = []
            for d in range(batch.num_rows):
                tokens = g[v.first[d] : v.first[d + 1]]
                row = _row(batch.column("doc_id")[d].as_py(), batch.column("item_id")[d].as_py(), len(tokens), tile(tokens, h[w.first[d] : w.first[d + 1]], seed))
                if row[3] >= coverage * len(tokens):
                    out.append((batch.column("k")[d].as_py(), row))
            pairs = _table([row for _, row in out])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), *pairs.columns], ["k", *pairs.schema.names])

    own = materialize(docs, "documents")
    items = materialize(benchmark.where("text is not null").select(F.monotonically_increasing_id().alias("k"), "item_id", F.col("text").alias("item")), "items")
    theirs = items.select("k", F.col("item").alias("text")).mapInArrow(places, "i long, hash long, c long, n long")
    shared = own.select("k", "text").mapInArrow(seeds, "k long, hash long").join(theirs, "hash").groupBy("k", "i").agg(F.sum("c").alias("m"), F.max("n").alias("n"))
    # m places of shared seeds in an item of n tokens: each can cover seed tokens
    likely = shared.where(F.col("m") * seed >= F.lit(coverage) * F.col("n")).select("k", "i")
    both = likely.join(own, "k").join(items.withColumnRenamed("k", "i"), "i").select("k", "doc_id", "text", "item_id", "item")
    return both.mapInArrow(tiled, f"k long, {PAIRS}")
