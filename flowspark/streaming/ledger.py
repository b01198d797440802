"""A ledger of events with an index: what a batch reads is bounded by the batch, not by what came before.

Rows lie in buckets by a hash of their id, with a digest of their canonical content. Each bucket has a Bloom filter of its
ids, of fixed size. A batch looks its ids up in the filters of its own buckets, and reads ids and digests of only those
buckets where a filter says maybe. Filters are written before rows: one that knows more than its bucket costs a look, and
one that is missing counts as maybe, so that a batch that dies anywhere and runs again finds all that is there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.canonical import event_digest
from flowspark.sources.saved import saved
from flowspark.sources.sinks import exists
from flowspark.streaming.streams import ConflictError

#: Places that an id sets in a filter.
PLACES = 5


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of ``bits``: (ids, PLACES)."""
    u = h.view(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(PLACES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)).astype(np.int64)


class Ledger:
    """The ledger at ``path``: its rows, and filters beside it.

    ``buckets`` and ``bits`` (of a filter, a multiple of 8) stay as they were when it was begun. With a tenth of ``bits``
    ids in a bucket, one in a hundred lookups of a new id reads it for nothing.
    """

    def __init__(self, path: str, key: str = "event_id", evidence: str | None = None, buckets: int = 256, bits: int = 1 << 20):
        self.path, self.filters = path.rstrip("/"), f"{path.rstrip('/')}-filters"
        self.key, self.evidence, self.buckets, self.bits = key, evidence, buckets, bits

    def _hashed(self, batch: DataFrame) -> DataFrame:
        own = [c for c in batch.columns if c not in (self.key, self.evidence)]
        h = F.xxhash64(F.col(self.key).cast("string"))
        return batch.withColumns({"digest": event_digest(own, self.evidence), "_h": h, "bucket": F.pmod(h, F.lit(self.buckets)).cast("int")})

    def _filters_of(self, rows: DataFrame) -> DataFrame:
        """(bucket, bits) of the buckets that ``rows`` touch; only their files are read."""
        spark = rows.sparkSession
        if not exists(spark, self.filters):
            return spark.createDataFrame([], "bits binary, bucket int")
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        return spark.read.schema("bits binary, bucket int").parquet(self.filters).where(F.col("bucket").isin(touched))

    def maybe(self, rows: DataFrame) -> DataFrame:
        """(bucket, _h) of hashed rows whose ids the ledger may hold."""

        def look(key: tuple, own: pa.Table, filters: pa.Table) -> pa.Table:
            if filters.num_rows:
                held = np.unpackbits(np.frombuffer(filters["bits"][0].as_py(), np.uint8))
                own = own.filter(pa.array(held[_places(own["_h"].to_numpy(), self.bits)].all(axis=1)))
            return own.select(["bucket", "_h"])

        ids = rows.where(F.col(self.key).isNotNull()).select("bucket", "_h").distinct()
        return ids.groupBy("bucket").cogroup(self._filters_of(rows).groupBy("bucket")).applyInArrow(look, "bucket int, _h long")

    def _add_to_filters(self, rows: DataFrame) -> None:
        def add(key: tuple, own: pa.Table, filters: pa.Table) -> pa.Table:
            held = np.unpackbits(np.frombuffer(filters["bits"][0].as_py(), np.uint8)) if filters.num_rows else np.zeros(self.bits, np.uint8)
            if own.num_rows:
                held[_places(own["_h"].to_numpy(), self.bits)] = 1
            return pa.table([pa.array([np.packbits(held).tobytes()], pa.binary()), pa.array([key[0].as_py()], pa.int32())], names=["bits", "bucket"])

        ids = rows.where(F.col(self.key).isNotNull()).select("bucket", "_h").distinct()
        merged = saved(ids.groupBy("bucket").cogroup(self._filters_of(rows).groupBy("bucket")).applyInArrow(add, "bits binary, bucket int"))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.filters)

    def known(self, rows: DataFrame, number: int) -> DataFrame:
        """(key, digest) of the ledger's rows of other batches in the buckets that may hold ids of ``rows``."""
        spark = rows.sparkSession
        kind = rows.schema[self.key].dataType.simpleString()
        wanted = [] if not exists(spark, self.path) else [r[0] for r in self.maybe(rows).select("bucket").distinct().collect()]
        if not wanted:
            return spark.createDataFrame([], f"{self.key} {kind}, digest string")
        there = spark.read.schema(f"{self.key} {kind}, digest string, bucket int, batch long").parquet(self.path)
        return there.where(F.col("bucket").isin(wanted) & (F.col("batch") != number) & F.col(self.key).isNotNull()).select(self.key, "digest")

    def append(self, batch: DataFrame, number: int, conflicts: str | None = None) -> None:
        """A foreachBatch sink's work: rows of new ids are appended, as partition ``batch`` of their buckets.

        Ids come once; rows without an id are all appended. An id with other content than before, or in the same batch,
        raises before anything is written, or goes to the folder ``conflicts``, and the first content stays. The same
        batch again changes nothing.
        """
        rows = saved(self._hashed(batch))
        before = saved(self.known(rows, number))
        named = rows.where(F.col(self.key).isNotNull())
        cols = [c for c in rows.columns if c != self.key]
        once = named.groupBy(self.key).agg(F.min(F.struct("digest", *[c for c in cols if c != "digest"])).alias("_s")).select(self.key, "_s.*")
        fresh = once.join(before, self.key, "left_anti")
        first = before.select(self.key, F.col("digest").alias("_f")).unionByName(fresh.select(self.key, F.col("digest").alias("_f")))
        odd = named.join(first, self.key).where("digest != _f").select(*batch.columns, F.lit(number).alias("batch"))
        if conflicts is None:
            some = odd.select(self.key).limit(3).collect()
            if some:
                raise ConflictError(f"ids with other content than before, such as {[r[0] for r in some]}")
        else:
            odd.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(conflicts)
        self._add_to_filters(fresh)
        out = fresh.unionByName(rows.where(F.col(self.key).isNull())).drop("_h").withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)
