"""Token ids on disk: encode whole texts, write compressed frames, read them back.

A store is a Parquet table of frames (see ``token_codec``) in document order. Each row holds whole documents: their
ids in one self-contained, checksummed frame, their doc_ids and numbers of ids. Spark's committer writes it, so that a
lost executor leaves no half-written file, and any file system that Spark knows can hold it.

Nulls: a null text is an empty document (its end id alone). Null doc_ids come first, in order of their texts; so do
repeated rows. Other columns are ignored. An empty table gives an empty store and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.common import shared_folder, small_batches

END_ID = 2
#: Ids after which a frame ends with its document, as many as about 10 MB of text have.
FRAME_IDS = 3_300_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 24
STORE = "shard int, frame_no int, n_ids long, doc_ids array<long>, lengths array<long>, frame binary"


def write_store(docs: DataFrame, target: str, end_id: int = END_ID, path: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into a store at ``target``, in ascending order of doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from flowspark.llm import token_codec
        from flowspark.llm.tokens import encoded

        shard, number = TaskContext.get().partitionId(), 0
        names = ["shard", "frame_no", "n_ids", "doc_ids", "lengths", "frame"]
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        total = 0

        def frames(keep: int) -> Iterator[pa.RecordBatch]:
            """Frames of what is held, as even as may be at the end, while more than ``keep`` ids are."""
            nonlocal number, total
            docs_in, lengths, ids = pa.concat_arrays([d for d, _, _ in held]), np.concatenate([n for _, n, _ in held]), np.concatenate([i for _, _, i in held])
            while total > keep:
                upto = np.cumsum(lengths)
                n = 1 + int(np.searchsorted(upto, FRAME_IDS if keep else -(-total // -(-total // FRAME_IDS))))
                m = int(upto[n - 1])
                one = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([m], pa.int64())]
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (docs_in[:n], pa.array(lengths[:n], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*one, *lists, pa.array([token_codec.encode(ids[:m])], pa.binary())], names)
                docs_in, lengths, ids = docs_in[n:], lengths[n:], ids[m:]
                number, total = number + 1, total - m
            held[:] = [(docs_in, lengths, ids.copy())] if total else []

        for batch, ids, counts in encoded(batches, path, SLICE_BYTES):
            held.append((batch.column("doc_id").cast(pa.int64()), counts + 1, np.insert(ids, np.cumsum(counts), end_id)))
            total += int(counts.sum()) + len(counts)
            if total > 2 * FRAME_IDS:
                yield from frames(2 * FRAME_IDS)
        if held:
            yield from frames(0)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(encode, STORE).write.parquet(target)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the ids decoded from the frames at ``path``.

    ``start``: ids of all documents before. Frames' totals are summed within a shard, shards' totals over all shards.
    """
    store = spark.read.schema(STORE).parquet(path)
    shards = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("frame_no")
    frames = store.select("shard", "frame_no", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("frame_start")).join(before, "shard")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowspark.llm import token_codec

        for batch in batches:
            for row in batch.to_pylist():
                ids = token_codec.decode(row["frame"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                upto = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(upto - lengths, upto, strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["frame_no"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(upto - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["shard", "frame_no", "doc_id", "own_start", "n_tokens", "ids_crc32"])

    rows = store.mapInArrow(decode, "shard int, frame_no int, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    return rows.join(frames, ["shard", "frame_no"]).select("doc_id", (F.col("shard_start") + F.col("frame_start") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write a store in the shared folder and read it back."""
    target = f"{shared_folder(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"
    write_store(docs, target, end_id, path)
    return read_store(docs.sparkSession, target)
