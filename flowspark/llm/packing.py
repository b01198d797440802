"""Best-fit packing of documents into sequences of a fixed number of tokens.

``token_pieces`` encodes whole texts and cuts only documents longer than a sequence. ``pack`` places the pieces by
best-fit decreasing: within a partition pieces come by falling length, and a segment tree over remaining capacities
finds the tightest open bin in logarithmic time. Partitions are groups of a hash of the piece's number in a written
table, so that no key and no repeated row can make one large; each holds tens of thousands of pieces, and only its last
few bins stay open. Only lengths travel, unless the pieces come with their ids, as ``sequences`` needs them.

Nulls: a null text is an empty document (its end id alone). A null doc_id is a value like others. Repeated rows are
documents of their own. Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import materialize

CAPACITY = 4096
END_ID = 1
PIECES_A_PARTITION = 60_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document of ``docs`` (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowspark.llm.tokens import encoded

        for batch, ids, counts in encoded(batches, path):
            ids = ids.astype("<u4")
            upto = np.cumsum(counts)
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), (upto - counts).tolist(), upto.tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id))
                for k, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity]
                    rows.append((doc, k, s, len(part), zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else ())))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if with_ids else ())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else ())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


class OpenBins:
    """Open bins by remaining capacity under a segment tree: node i counts the bins of its leaves."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def _count(self, room: int, change: int) -> None:
        i = self.leaves + room
        while i:
            self.tree[i] += change
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least ``need`` that a bin has, or -1."""
        i = self.leaves + need
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset there of a piece that fits a bin."""
        room = self.tightest(length) if length else self.tightest(0)
        if room < 0:
            number, room = self.opened, self.capacity
            self.opened += 1
        else:
            number = self.bins[room].pop()
            self._count(room, -1)
        if room > length:
            self.bins[room - length].append(number)
            self._count(room - length, 1)
        return number, self.capacity - room


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_a_partition: int = PIECES_A_PARTITION) -> DataFrame:
    """``pieces`` (with doc_id, piece, length at most ``capacity``) with sequence_id and offset of each."""
    names = list(pieces.columns)
    number = "_number"
    while number in names:
        number += "_"
    numbered = materialize(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // pieces_a_partition))
    dealt = numbered.repartition(groups, F.xxhash64(number)).sortWithinPartitions(F.desc("length"), number).drop(number)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, bins = TaskContext.get().partitionId() << 36, OpenBins(capacity)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(place, f"{out}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack`` of pieces with their ids. A sequence has bounded length."""
    return placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"))
