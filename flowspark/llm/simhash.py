"""Near duplicates by SimHash: exact comparison of all fingerprints in tiles.

1. One pass over whole texts: words, lower-cased in A-Z, in shingles with repeats; each shingle's XXH64 votes on 64 bits.
2. Equal fingerprints form a class with its least doc_id; only distinct fingerprints go on, whatever the copies.
3. Fingerprints within the radius agree in one of radius + 1 blocks of bits at least, so that each block's equal values
   are compared apart and no link is lost. Within a bucket, fingerprints are sorted by population count and cut into
   tiles; two tiles whose population counts differ beyond the radius hold no link and are skipped. The others are
   compared in full, by numpy's exclusive or and bit counts. A bucket of more than ``TILE`` fingerprints is cut by
   population count and hash into tiles of about that size, and its pairs of tiles are dealt to the cluster.
4. A pair of tiles answers with a spanning forest of its links, not with each of them: components are the same, and a
   large group of near copies costs rows in proportion to its size.

Nulls: a null or empty text, or one without words, has fingerprint zero and is linked like any other. A row without a
doc_id has its fingerprint, a null component, and links nothing. Rows of one doc_id are one document with the links of
all. Other columns are ignored. An empty table gives no rows. Tables that the result reads stay in the shared folder.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import Words, doc_windows, materialize, sub_batches
from flowspark.llm.components import components
from flowspark.operators.folds import starts

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a bucket that one task compares; larger buckets are dealt in tiles of about this size.
TILE = 4096
#: Rows of a tile that are compared at once.
ROWS = 256
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16


def fingerprints(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text, as long."""
    w = Words(texts, lower=True)
    n = len(w.counts)
    # the words' bytes with one space after each: a shingle's words joined are a slice of it
    keep = np.zeros(len(w.data), bool)
    lengths = w.end - w.start
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    keep[inside] = True
    keep[w.end] = True
    packed = np.where(inside, w.data, 32)[keep].astype(np.uint8).tobytes()
    upto = np.cumsum(lengths + 1)
    start, end = upto - lengths - 1, upto - 1
    _, at = doc_windows(w, np.zeros(len(start), np.uint64), width)
    few = np.flatnonzero((w.counts > 0) & (w.counts < width))
    a = np.concatenate((start[at], start[w.first[few]]))
    b = np.concatenate((end[at + width - 1], end[w.first[few] + w.counts[few] - 1]))
    doc = np.concatenate((w.doc[at], few))
    order = np.argsort(doc, kind="stable")
    a, b, doc = a[order], b[order], doc[order]
    ones = np.zeros((n, 64), np.int64)
    for lo in range(0, len(doc), SHINGLES):
        part = doc[lo : lo + SHINGLES]
        spans = zip(a[lo : lo + SHINGLES].tolist(), b[lo : lo + SHINGLES].tolist(), strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(packed[i:j], SEED) for i, j in spans), np.uint64, len(part))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ones[part[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    votes = np.bincount(doc, minlength=n)[:, None]
    return np.packbits(2 * ones > votes, axis=1, bitorder="little").view("<i8").reshape(n).astype(np.int64)


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of n nodes' links: each node with the least one of its component."""
    if len(u) < n:
        return u, v
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def near(a: np.ndarray, b: np.ndarray | None, radius: int, lower: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between two tiles of fingerprints sorted by population count, or within one where ``b`` is None.

    Pairs that agree in one of the first ``lower`` blocks are left to those blocks. Slices of rows meet only columns
    whose population counts are within the radius. Places of ``b`` follow those of ``a``.
    """
    same = b is None
    b = a if same else b
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, shift = 0, 0 if same else len(a)
    for lo in range(0, len(a), ROWS):
        rows = a[lo : lo + ROWS]
        c0 = lo if same else int(np.searchsorted(pb, pa_[lo] - radius, "left"))
        c1 = int(np.searchsorted(pb, pa_[min(lo + ROWS, len(a)) - 1] + radius, "right"))
        if c0 >= c1:
            continue
        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ b[None, c0:c1]) <= radius)
        i, j = i + lo, j + c0
        keep = i < j if same else np.ones(len(i), bool)
        for _, mask in masks(radius)[:lower]:
            keep &= ((a[i] ^ b[j]) & np.uint64(mask)) != 0
        if keep.any():
            found.append((i[keep], j[keep] + shift))
            held += int(keep.sum())
            if held > 4 * (len(a) + len(b)):  # many links: go on with a forest of those so far
                found = [spanning(*(np.concatenate(x) for x in zip(*found, strict=True)), shift + len(b))]
                held = len(found[0][0])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning(*(np.concatenate(x) for x in zip(*found, strict=True)), shift + len(b))


def masks(radius: int) -> list[tuple[int, int]]:
    """(first bit, mask) of radius + 1 blocks that cover 64 bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, ((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in itertools.pairwise(cuts)]


def _blocks(radius: int) -> Column:
    """(block, value) of each of a fingerprint's blocks."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit(signed(mask >> a))).alias("value")) for k, (a, mask) in enumerate(masks(radius))]))


def _edges(doc: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(doc[i], doc[j])), pa.array(np.minimum(doc[i], doc[j]))], ["u", "v"])


def tiled_links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect all of ``classes`` (fp, rep: distinct values of each) within ``radius`` bits."""
    rows = classes.select("rep", "fp", _blocks(radius).alias("b")).select("b.block", "b.value", F.bit_count("fp").alias("pop"), "fp", "rep")
    pops = rows.groupBy("block", "value", "pop").agg(F.count("*").alias("c"))
    large = materialize(pops.groupBy("block", "value").agg(F.sum("c").alias("total"), F.collect_list(F.struct("pop", "c")).alias("pops")).where(F.col("total") > tile).select("block", "value", F.explode("pops").alias("p")).select("block", "value", "p.pop", (1 + F.floor((F.col("p.c") - 1) / tile)).alias("salts")), "large")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            parts = [t for t in (held, None if batch is None else pa.Table.from_batches([batch])) if t is not None and t.num_rows]
            if not parts:
                continue
            t = pa.concat_tables(parts).combine_chunks()
            cuts = [*starts(t, ["block", "value"]), t.num_rows]
            if batch is not None:
                held, cuts = t.slice(cuts[-2]), cuts[:-1]
            fp, doc, block = t["fp"].to_numpy().view(np.uint64), t["rep"].to_numpy(), t["block"].to_numpy()
            for x, y in itertools.pairwise(cuts):
                if y - x > 1:
                    i, j = near(fp[x:y], None, radius, int(block[x]))
                    if len(i):
                        yield _edges(doc[x:y], i, j)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                side = []
                for fps, reps in (("fa", "ra"), ("fb", "rb")):
                    fp, rep = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (fps, reps))
                    order = np.argsort(np.bitwise_count(fp.view(np.uint64)), kind="stable")
                    side.append((fp.view(np.uint64)[order], rep[order]))
                (a, ra), (b, rb) = side
                own = batch.column("one")[r].as_py()
                i, j = near(a, None if own else b, radius, batch.column("block")[r].as_py())
                if len(i):
                    yield _edges(ra if own else np.concatenate((ra, rb)), i, j)

    cold = rows.join(F.broadcast(large.select("block", "value").distinct()), ["block", "value"], "left_anti")
    found = cold.repartition("block", "value").sortWithinPartitions("block", "value", "pop").mapInArrow(small, "u long, v long")
    # large buckets: tiles by population count and hash, then their pairs
    salted = rows.join(F.broadcast(large), ["block", "value", "pop"]).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")))
    key = ["block", "value", "pop", "salt"]
    tiles = materialize(salted.groupBy(*key).agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps")), "tiles")
    names = tiles.select(*key)
    left = names.select("block", "value", F.col("pop").alias("p0"), F.col("salt").alias("s0"), F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)).alias("pop"))
    met = left.join(names, ["block", "value", "pop"]).where("pop > p0 or salt >= s0")
    one = tiles.select("block", "value", F.col("pop").alias("p0"), F.col("salt").alias("s0"), F.col("fps").alias("fa"), F.col("reps").alias("ra"))
    other = tiles.select(*key, F.col("fps").alias("fb"), F.col("reps").alias("rb"))
    both = met.join(one, ["block", "value", "p0", "s0"]).join(other, key).select("block", ((F.col("pop") == F.col("p0")) & (F.col("salt") == F.col("s0"))).alias("one"), "fa", "ra", "fb", "rb")
    return found.union(both.mapInArrow(pairs, "u long, v long"))


def link(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs`` (doc_id, text).

    ``component_id``: the least doc_id reachable over links of at most ``radius`` differing bits.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", encoders=False):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), width))], ["doc_id", "fp"])

    marks = materialize(docs.select("doc_id", "text").mapInArrow(mark, "doc_id long, fp long"), "fingerprints")
    classes = materialize(marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    # a doc_id of several fingerprints holds their classes together, and may stand for more than one
    several = marks.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("doc_id")
    held = marks.join(several, "doc_id").join(classes, "fp").where("rep != doc_id").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    joined = components(tiled_links(classes, radius, tile).union(held))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    found = marks.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    return found

