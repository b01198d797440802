"""Enrichment joins against small dimensions, with the bound on broadcasts checked."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowspark.functions.text import normalized

BROADCAST_ROWS = 100_000


def small(dim: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``dim`` with a broadcast hint if it has at most ``rows`` rows; else as it is, and Spark shuffles."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def or_else(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``rows``, or ``others`` where there are none; decided when the query runs."""
    some = rows.limit(1).agg(F.count("*").alias("_some"))
    return rows.unionByName(others.join(F.broadcast(some.where("_some = 0")), how="left_semi"))


def by_name(points: DataFrame, dim: DataFrame, name: str = "name") -> DataFrame:
    """Left join on names without spaces."""
    right = dim.withColumn("_key", normalized(F.col(name))).drop(name)
    return points.withColumn("_key", normalized(F.col(name))).join(small(right), "_key", "left").drop("_key")


def by_name_or_id(points: DataFrame, dim: DataFrame, key: str = "key", name: str = "name", identity: str = "id") -> DataFrame:
    """Left join on a key that is a name or an id of ``dim``; a name wins. Both are one equi-join."""
    cols = [c for c in dim.columns if c != key]
    index = dim.select(F.explode(F.array(F.struct(F.lit(0).alias("_o"), F.col(name).alias("_k")), F.struct(F.lit(1).alias("_o"), F.col(identity).cast("string").alias("_k")))).alias("_i"), *cols).select("_i.*", *cols).where("_k is not null and _k != ''")
    first = index.groupBy("_k").agg(F.min_by(F.struct(*cols), F.struct("_o", F.col(identity).cast("string"))).alias("_s")).select("_k", "_s.*")
    return points.join(small(first), F.col(key) == F.col("_k"), "left").drop("_k")


def nearest(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The region with the least squared distance; the first by ordinal of equal ones. ``regions`` are few: one array."""
    listed = regions.agg(F.sort_array(F.collect_list(F.struct("ordinal", "region", "center_x", "center_y"))).alias("_regions"))
    away = F.transform("_regions", lambda r: F.struct(((F.col("longitude") - r["center_x"]) ** 2 + (F.col("latitude") - r["center_y"]) ** 2).alias("d"), r["ordinal"].alias("ordinal"), r["region"].alias("nearest")))
    best = F.array_min(away)
    return points.join(F.broadcast(listed)).withColumn("_b", best).withColumns({"nearest": F.col("_b.nearest"), "distance2": F.col("_b.d")}).drop("_regions", "_b")


def longest_contained(points: DataFrame, names: DataFrame, name: str = "name", found: str = "short", least: int = 1, most: int = BROADCAST_ROWS) -> DataFrame:
    """The longest of ``names`` (column ``found``) that each point's name contains, or null; of equal ones the least.

    Up to ``most`` names are sent to the tasks, which look for all of them in one pass over each text, by an automaton
    built once a task. More are joined: a text's substrings of the lengths that names have, by equality.
    """
    listed = names.select(F.col(found).alias("_short")).where(F.length("_short") >= max(1, least)).distinct()
    points = points.drop(found)
    some = [r[0] for r in listed.limit(most + 1).collect()]
    if len(some) > most:
        lengths = listed.select(F.length("_short").alias("_l")).distinct().agg(F.array_sort(F.collect_list("_l")).alias("_lengths"))
        texts = points.select(F.col(name).alias("_text")).where("_text is not null").distinct().join(F.broadcast(lengths))
        starts = lambda n: F.when(F.length("_text") >= n, F.transform(F.sequence(F.lit(1), F.length("_text") - n + 1), lambda i: F.substring(F.col("_text"), i, n))).otherwise(F.array().cast("array<string>"))
        parts = texts.select("_text", F.explode(F.array_distinct(F.flatten(F.transform("_lengths", starts)))).alias("_short"))
        best = parts.join(listed, "_short").groupBy("_text").agg(F.min_by("_short", F.struct(-F.length("_short"), "_short")).alias(found))
        return points.join(best, F.col(name) == F.col("_text"), "left").drop("_text")
    held = points.sparkSession.sparkContext.broadcast(some)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for s in held.value:
            automaton.add_word(s, (-len(s), s))
        automaton.make_automaton()

        def best(text: str | None) -> str | None:
            return min((v for _, v in automaton.iter(text)), default=(0, None))[1] if text and held.value else None

        for batch in batches:
            texts = batch.column(name).dictionary_encode()
            hits = pa.array([best(t) for t in texts.dictionary.to_pylist()], pa.string()).take(texts.indices)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], [*batch.schema.names, found])

    schema = StructType([*points.schema.fields, StructField(found, StringType())])
    return points.mapInArrow(mark, schema)


def _prefixes(key: str) -> Column:
    """All prefixes of a text, for an equi-join in place of a starts-with product."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda n: F.substring(F.col(key), F.lit(1), n)))


def unique_prefix(short: DataFrame, dim: DataFrame, key: str = "key", full: str = "full") -> DataFrame:
    """Exact name of ``dim``, else the only one that starts with the key, else null."""
    starts = dim.select(full, _prefixes(full).alias(key)).groupBy(key).agg(F.count("*").alias("_n"), F.min(full).alias("_only"), F.max(F.col(full) == F.col(key)).alias("_exact"))
    return short.join(starts, key, "left").withColumn(full, F.when(F.col("_exact"), F.col(key)).when(F.col("_n") == 1, F.col("_only"))).drop("_n", "_only", "_exact")


def longest_prefix(long: DataFrame, dim: DataFrame, key: str = "key", alias: str = "alias") -> DataFrame:
    """The longest alias that the key starts with; null if two of that length fit. ``dim``: (alias, id).

    Aliases that are equal without spaces are counted first: a key meets each of its prefixes once, however many share it.
    """
    rows = long.select(key).distinct().select(key, _prefixes(key).alias("_p"))
    known = dim.groupBy(normalized(F.col(alias)).alias("_p")).agg(F.count("*").alias("_n"), F.min(alias).alias(alias))
    best = rows.join(known, "_p").groupBy(key).agg(F.max(F.struct(F.length("_p").alias("_l"), "_n", alias)).alias("_b"))
    return long.join(best.select(key, F.when(F.col("_b._n") == 1, F.col(f"_b.{alias}")).alias(alias)), key, "left")


def gate_region(points: DataFrame, dim: DataFrame, gate: Column, value: str = "region") -> DataFrame:
    """Value of the points of the same gate, adopted only if they agree."""
    per_gate = dim.select(gate.alias("_gate"), value).where(f"_gate != '' and {value} is not null and trim({value}) != ''").groupBy("_gate").agg(F.count_distinct(value).alias("_n"), F.min(value).alias(f"gate_{value}"))
    return points.withColumn("_gate", gate).join(small(per_gate.where("_n = 1").drop("_n")), "_gate", "left").drop("_gate")


def with_counters(devices: DataFrame, counters: DataFrame, latest: DataFrame, key: str = "device_id") -> DataFrame:
    """Devices with their counters and last report; counters that are missing are 0."""
    numbers = [f.name for f in counters.schema if f.name != key]
    return devices.join(counters, key, "left").join(latest, key, "left").fillna(0, numbers)


def stitched(starts: DataFrame, ends: DataFrame, gap_s: float = 0.48, jump: float = 2.0, cosine: float = 0.5) -> DataFrame:
    """Pairs of a vanished track and the new one that continues it, on one device and of one class.

    ``ends``: (device_id, track_id, class_name, t, x, y, vx, vy); ``starts``: the same without speed, with ``diag``.
    Time is cut into slices a little longer than the gap: an equi-join on the slice, not a product. Each side is used
    once: a pair is kept if it is the best of both. Gaps are compared to a billionth of a second; distances are plain
    roots of squares, so that pairs that tie in SQL tie here.
    """
    slice_ = lambda t: F.floor(t / (gap_s * 1.001))
    norm = lambda a, b: F.sqrt(a * a + b * b)
    old = ends.select("device_id", "class_name", F.col("track_id").alias("old_id"), F.col("t").alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"), "vx", "vy").withColumn("slice", F.explode(F.array(slice_(F.col("t0")), slice_(F.col("t0")) + 1)))
    new = starts.select("device_id", "class_name", F.col("track_id").alias("new_id"), "t", "x", "y", "diag").withColumn("slice", slice_(F.col("t")))
    dt = F.col("t") - F.col("t0")
    gap = F.round(dt, 9)
    error = norm(F.col("x0") + F.col("vx") * dt - F.col("x"), F.col("y0") + F.col("vy") * dt - F.col("y"))
    gx, gy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    lengths = norm(gx, gy) * norm(F.col("vx"), F.col("vy"))
    near = old.join(new, ["device_id", "class_name", "slice"]).where("old_id != new_id").where((gap > 0) & (gap <= gap_s) & (error <= jump * F.col("diag")) & (lengths > 1e-12)).where((gx * F.col("vx") + gy * F.col("vy")) / lengths >= cosine).withColumn("error", error)
    for side in ("new_id", "old_id"):
        other = "old_id" if side == "new_id" else "new_id"
        w = Window.partitionBy("device_id", side).orderBy("error", other)
        near = near.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return near.select("device_id", "old_id", "new_id", "error")
