"""Streams: event ingest, windowed counters, crossings with state, cooldowns, heartbeat timers, sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowspark.functions.canonical import event_digest
from flowspark.operators import crossing
from flowspark.operators.counters import four_counts
from flowspark.operators.events import EVENT_TYPES
from flowspark.sources.sinks import exists, merge_hours


def read(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; load is bounded by files a trigger, and nothing is dropped."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly counts of each device, emitted when the watermark has passed the hour."""
    timed = events.where(F.col("event_type").isin(*EVENT_TYPES)).withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("device_id", F.window("at", "1 hour").alias("w")).agg(*four_counts()).select("device_id", F.date_format("w.start", "yyyy-MM-dd").alias("stat_date"), F.hour("w.start").alias("hour"), "vehicle_in", "vehicle_out", "person_in", "person_out")


def first_within(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first arrival of each id within the watermark: bounded state. For all time, use ``append_new``."""
    return events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


class ConflictError(ValueError):
    """An id came with other content than before."""


def append_new(path: str, key: str = "event_id", conflicts: str | None = None, evidence: str | None = None):
    """A foreachBatch sink that appends rows of new ids to a ledger at ``path``.

    Content is compared in its canonical form: the order of keys, also in ``evidence`` (a column of JSON text) and in
    nested columns, makes no conflict.

    The batch's number names a partition that is overwritten, so that a batch that runs again changes nothing. Ids
    come once in a batch, and are anti-joined with the ledger of other batches; rows without an id are all appended.
    An id with other content than in the ledger or in the same batch raises before anything is written, or, where
    ``conflicts`` names a folder, its row goes there and the first content stays.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c != key]
        content = event_digest([c for c in cols if c != evidence], evidence).alias("_d")
        known = batch.where(F.col(key).isNotNull())
        once = known.groupBy(key).agg(F.min(F.struct(*cols)).alias("_s")).select(key, "_s.*").select(*batch.columns)
        first = once.select(key, content)
        if exists(spark, path):
            ledger = spark.read.parquet(path).where(F.col("batch") != number)
            first = ledger.where(F.col(key).isNotNull()).select(key, content).unionByName(first.join(ledger.select(key), key, "left_anti"))
            once = once.join(ledger.select(key), key, "left_anti")
        odd = known.withColumn("_d", content).join(first.withColumnRenamed("_d", "_f"), key).where("_d != _f").drop("_d", "_f")
        if conflicts is None:
            some = odd.select(key).limit(3).collect()
            if some:
                raise ConflictError(f"ids with other content than before, such as {[r[0] for r in some]}")
        else:
            odd.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(conflicts)
        rows = once.unionByName(batch.where(F.col(key).isNull())).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return sink


def replace_partitions(path: str, column: str = "stat_date"):
    """A foreachBatch sink that replaces whole partitions: the same rows again change nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)

    return sink


def recompute_hours(facts_path: str, archive_path: str):
    """A foreachBatch sink for late events: the dates that they touch are counted again from the facts."""

    def sink(batch: DataFrame, number: int) -> None:
        from flowspark.operators.counters import hourly as counts

        dates = batch.select(F.date_format("occurred_at", "yyyy-MM-dd").alias("d")).distinct()
        facts = batch.sparkSession.read.parquet(facts_path).withColumn("d", F.date_format("occurred_at", "yyyy-MM-dd")).join(F.broadcast(dates), "d", "left_semi")
        counts(facts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stat_date").parquet(archive_path)

    return sink


def archive_again(facts_path: str, late_path: str, done_path: str, archive_path: str):
    """A foreachBatch sink of late events: hours whose version isn't acknowledged are archived, then acknowledged.

    The batch's late events are kept under its number. An hour's version is the number of its late events that are among
    the facts that it is counted from: one that the ledger hasn't taken yet raises the version when it is there, and the
    next batch, also an empty one, archives the hour again. A round that dies before the acknowledgement does so too.
    """
    from flowspark.operators.counters import archived_again, late_marks, present, unacknowledged

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        late = batch.select("event_id", "device_id", "occurred_at").withColumn("batch", F.lit(number))
        late.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(late_path)
        facts = spark.read.parquet(facts_path)  # the files there are now: versions and counts are of the same facts
        marks = late_marks(present(spark.read.parquet(late_path), facts))
        if exists(spark, done_path):
            marks = unacknowledged(marks, spark.read.schema(marks.schema).parquet(done_path))
        staged = f"{late_path.rstrip('/')}-marks"
        marks.write.mode("overwrite").parquet(staged)
        marks = spark.read.schema(marks.schema).parquet(staged)
        merge_hours(archived_again(facts, marks).drop("version"), archive_path)
        marks.write.mode("append").parquet(done_path)

    return sink


def crossings(observations: DataFrame, lines: dict[str, crossing.Line], rules: crossing.Rules = crossing.Rules()) -> DataFrame:
    """Crossing events with each device's state between micro-batches. Late frames of a device are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dev = crossing.Device.loads(state.get[0]) if state.exists else crossing.Device()
        rows = pd.concat(list(batches), ignore_index=True)
        events, _ = crossing.run_device(dev, rows, lines[key[0]], rules)
        state.update((dev.dumps(),))
        yield pd.DataFrame(events, columns=[c.split()[0] for c in crossing.EVENTS.split(", ")])

    some = observations.where(F.col("device_id").isin(*lines))
    return some.groupBy("device_id").applyInPandasWithState(run, crossing.EVENTS, "state string", "append", GroupStateTimeout.NoTimeout)


GEOMETRY = "device_id string, since double, version long, line array<array<double>>, anchor array<double>, width int, height int, ring array<array<double>>, count_only string"


def crossings_of_versions(observations: DataFrame, geometry: DataFrame, rules: crossing.Rules = crossing.Rules()) -> DataFrame:
    """Crossing events where devices' lines may change while the query runs, with the ``version`` that each was judged by.

    ``geometry`` (GEOMETRY) is a stream too: a version holds from ``since`` on, or from when it comes, if that is later. A
    device's state is its geometry and what the tracks did under it; another version begins with no tracks, and an older
    or equal one changes nothing. Frames of a device before its first version, and late ones, are left out.
    """
    facts = observations.select(*crossing.OBSERVED)
    told = geometry.select("device_id", F.col("since").alias("t_mono"), F.to_json(F.struct("version", "line", "anchor", "width", "height", "ring", "count_only")).alias("_geometry"))
    both = facts.unionByName(told, allowMissingColumns=True)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, dump = state.get if state.exists else (None, None)
        dev = crossing.Device.loads(dump) if dump else crossing.Device()
        rows = pd.concat(list(batches), ignore_index=True)
        changes = rows[rows["_geometry"].notna()].sort_values("t_mono", kind="stable")
        seen = rows[rows["_geometry"].isna()]
        out = []

        def judge(some: pd.DataFrame) -> None:
            if now is not None and len(some):
                g = json.loads(now)
                line = crossing.Line(g["line"], g["anchor"], g["width"], g["height"], g.get("ring"), g.get("count_only"))
                out.extend((*e, g["version"]) for e in crossing.run_device(dev, some, line, rules)[0])

        for since, change in zip(changes["t_mono"], changes["_geometry"], strict=True):
            judge(seen[seen["t_mono"] < since])
            seen = seen[~(seen["t_mono"] < since)]
            if now is None or json.loads(change)["version"] > json.loads(now)["version"]:
                now, dev = change, crossing.Device(clock=dev.clock)
        judge(seen)
        if now is not None:
            state.update((now, dev.dumps()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in f"{crossing.EVENTS}, version long".split(", ")])

    return both.where("device_id is not null").groupBy("device_id").applyInPandasWithState(run, f"{crossing.EVENTS}, version long", "geometry string, state string", "append", GroupStateTimeout.NoTimeout)


def suppressed(alerts: DataFrame, seconds: int = 300) -> DataFrame:
    """Alerts (rule_id, us) that are ``seconds`` after the last one emitted of their rule; those without a time are all emitted."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)["us"]
        out = [(key[0], None)] * int(rows.isna().sum())
        for us in sorted(rows.dropna().astype("int64")):
            if last is None or us - last >= seconds * 1_000_000:
                last = us
                out.append((key[0], int(us)))
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame(out, columns=["rule_id", "us"]).astype({"us": "Int64"})

    return alerts.groupBy("rule_id").applyInPandasWithState(run, "rule_id string, us long", "last long", "append", GroupStateTimeout.NoTimeout)


def heartbeats(beats: DataFrame, limit_ms: int = 90_000) -> DataFrame:
    """Offline and online changes of devices by a processing-time timer that each beat winds up again."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.update(("offline",))
            yield pd.DataFrame([(key[0], "offline")], columns=["device_id", "status"])
            return
        for _ in batches:
            pass
        back = state.exists and state.get[0] == "offline"
        state.update(("online",))
        state.setTimeoutDuration(limit_ms)
        yield pd.DataFrame([(key[0], "online")] if back else [], columns=["device_id", "status"])

    return beats.groupBy("device_id").applyInPandasWithState(run, "device_id string, status string", "status string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def flow_windows(events: DataFrame, length: str = "60 seconds", slide: str = "2 seconds", late: str = "2 minutes") -> DataFrame:
    """Sliding flow of each device and type, one row a slide."""
    timed = events.withColumn("at", F.col("occurred_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("device_id", "event_type", F.window("at", length, slide).alias("w")).agg(F.count("*").alias("flow")).select("device_id", "event_type", "w.end", "flow")


def latest(path: str, key: str, order: str):
    """A foreachBatch sink that keeps the last row of each key in a small table: two folders, read one, write the other."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = batch.unionByName(spark.read.parquet(f"{path}/{(number + 1) % 2}"))
        cols = [c for c in batch.columns if c not in (key, order)]
        rows.groupBy(key).agg(F.max(F.struct(order, *cols)).alias("_s")).select(key, "_s.*").write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return sink
