"""Removal of passages that occur before: Rabin-Karp hashes of every window of ``width`` words.

A window is removed if its word sequence also starts earlier: in a document of a smaller doc_id, or earlier in the same
document. Windows are judged on the input; the words that any removed window covers form the maximal removal intervals.

1. Each task hashes the windows of blocks of whole documents. A hash that a block holds many times is sent once, with
   the least doc_id there: a passage of a third of all documents costs a row per block, not per document.
2. Blocks' hashes are dealt by hash, packed in binary columns (8 bytes a hash), and sorted by portions of the hash: a
   task holds the hashes of one portion at a time, and there are as many portions as keep each to ``PORTION_BYTES`` of
   text, however large the input. The least doc_id of each hash wins; the other blocks get the hash back for the one
   document that they sent.
3. Blocks meet the answers, find their own repeats again, and cut their documents. A block has bounded size.

Steps 1 and 3 read ``docs`` twice and must see the same blocks: pass files or a materialized table. Answers carry the
block's signature, and an answer without its block raises. Windows are equal if their 64-bit hashes are: among n
windows about n * n / 2**65 pairs are taken for equal wrongly, one in 30 GB of text, some millions of 10**13 windows.

Nulls: a null text has no words. A null doc_id comes before all others. Rows of one doc_id don't remove each other's
words. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.common import Words, doc_windows, mix64, sub_batches

WIDTH = 20
BLOCK_BYTES = 4 << 20
PORTION_BYTES = 48 << 20
_LEAST = -(1 << 63)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers that Spark's hash partitioning deals to ``n`` different partitions."""
    rows = spark.range(n * (8 + n.bit_length() * 2)).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("to")).groupBy("to").agg(F.min("key").alias("key")).orderBy("to").collect()
    keys = {r["to"]: r["key"] for r in rows}
    return [keys.get(i, i) for i in range(n)]


def signature(batch: pa.RecordBatch) -> int:
    """Of a block: its doc_ids and texts' lengths, in any order."""
    ids = batch.column("doc_id").fill_null(_LEAST).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), -1).to_numpy(zero_copy_only=False)
    return int(mix64(mix64(ids.astype(np.uint64)) + sizes.astype(np.uint64)).sum() >> np.uint64(1))


class Block:
    """The windows of a batch of documents, in order of doc_id, and which of them the block itself removes."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, width: int):
        ids = batch.column("doc_id").fill_null(_LEAST).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.batch = batch.take(pa.array(order))
        self.ids = ids[order]
        text = self.batch.column("text")
        self.words = Words(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text)
        hashes = self.words.hashes()
        self.hashes, self.at = doc_windows(self.words, hashes, width)
        self.row = self.words.doc[self.at]
        self.sorted = np.argsort(self.hashes, kind="stable")
        h, r = self.hashes[self.sorted], self.row[self.sorted]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        self.first = self.sorted[new]  # of each distinct hash, the window of the least doc_id
        least = self.ids[r[new]][np.cumsum(new) - 1] if len(h) else h
        again = self.ids[r] > least
        again[1:] |= ~new[1:] & (r[1:] == r[:-1])
        self.removed = np.zeros(len(h), bool)
        self.removed[self.sorted] = again


def _send(docs: DataFrame, width: int, keys: list[int], portions: int) -> DataFrame:
    n = len(keys)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BLOCK_BYTES):
            b = Block(batch, width)
            h, r = b.hashes[b.first], b.row[b.first]
            to = ((h >> np.uint64(32)) % np.uint64(n * portions)).astype(np.int64)
            order = np.lexsort((r, to))
            h, r, to = h[order], r[order], to[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            rows, own_signature = [], signature(batch)
            for s, e in zip([0, *cuts], [*cuts, len(h)], strict=True):
                if e > s:
                    own, counts = np.unique(b.ids[r[s:e]], return_counts=True)
                    rows.append((keys[to[s] % n], int(to[s]) // n, own_signature, own.tobytes(), counts.astype(np.int32).tobytes(), h[s:e].tobytes()))
            if rows:
                types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "portion", "block", "ids", "counts", "hashes"])

    return docs.mapInArrow(send, "key int, portion int, block long, ids binary, counts binary, hashes binary")


def _answer(sent: DataFrame, n: int) -> DataFrame:
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, portion in itertools.groupby(rows, key=lambda row: row["portion"]):
            parts = [(row["block"], np.repeat(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int32)), np.frombuffer(row["hashes"], np.uint64)) for row in portion]
            h = np.concatenate([x[2] for x in parts])
            ids = np.concatenate([x[1] for x in parts])
            blocks = np.repeat(np.array([x[0] for x in parts], np.int64), [len(x[1]) for x in parts])
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            starts = np.flatnonzero(new)
            least = np.minimum.reduceat(ids[order], starts)
            late = order[ids[order] > least[np.cumsum(new) - 1]]
            late = late[np.argsort(blocks[late], kind="stable")]
            ids, h, blocks = ids[late], h[late], blocks[late]
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            if len(blocks):
                parts = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([int(blocks[a]) for a, _ in parts], pa.int64()), pa.array([ids[a:e].tobytes() for a, e in parts], pa.binary()), pa.array([h[a:e].tobytes() for a, e in parts], pa.binary())], ["block", "ids", "hashes"])

    return sent.repartition(n, "key").sortWithinPartitions("portion").mapInArrow(answer, "block long, ids binary, hashes binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text, removed]) of ``docs`` (doc_id, text).

    ``kept_text``: the kept words joined by a space; ``removed``: maximal intervals of removed words, end exclusive.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    answers = _answer(_send(docs, width, even_keys(spark, n), 1 + size // (n * portion_bytes)), n)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, signature(batch), np.int64)), *batch.columns], ["block", "doc_id", "text"])

    def cut(block: pa.Table, late: pa.Table) -> pa.Table:
        if not block.num_rows:
            raise RuntimeError("the documents came in other blocks when they were read again; materialize them first")
        b = Block(block.combine_chunks().select(["doc_id", "text"]), width)
        w, counts, flags = b.words, b.words.counts, b.removed
        if late.num_rows:
            h = np.frombuffer(b"".join(late.column("hashes").to_pylist()), np.uint64)
            ids = np.frombuffer(b"".join(late.column("ids").to_pylist()), np.int64)
            order = np.argsort(h)
            h, ids = h[order], ids[order]
            at = np.minimum(np.searchsorted(h, b.hashes), len(h) - 1)
            flags = flags | ((h[at] == b.hashes) & (ids[at] == b.ids[b.row]))
        at = b.at[flags]
        cover = np.bincount(at, minlength=len(w.start) + width + 1).astype(np.int64)
        cover[width:] -= np.bincount(at, minlength=len(w.start) + width + 1)[:-width]
        keep = np.cumsum(cover)[: len(w.start)] == 0
        removed = counts - np.diff(np.concatenate(([0], np.cumsum(keep)))[w.first])
        data = w.data.copy()
        data[w.end] = 32
        step = np.zeros(len(data) + 1, np.int8)
        step[w.start[keep]] += 1
        step[w.end[keep] + 1] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        kept = data[inside].tobytes()
        upto = np.concatenate(([0], np.cumsum(inside)))[w.ends + 1]
        texts = [kept[a : max(a, e - 1)] for a, e in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]
        out = [b.batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
        if with_text:
            out += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array([_intervals(~keep[a:e]) for a, e in zip(w.first[:-1], w.first[1:], strict=True)], pa.list_(pa.list_(pa.int64())))]
        return pa.Table.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text", "removed"] if with_text else ())])

    named = docs.mapInArrow(name, "block long, doc_id long, text string")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string, removed array<array<long>>" if with_text else "")
    return named.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)


def _intervals(gone: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()
