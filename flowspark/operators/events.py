"""Ingest: validation, identity, deduplication, late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.arrays import sorted_json

EVENT_TYPES = ("VehicleEnter", "VehicleExit", "PersonEnter", "PersonExit")
PERSON_CLASSES, VEHICLE_CLASSES = ("person", "bicycle", "motorcycle"), ("car", "truck", "bus")


def known_types(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*EVENT_TYPES))


def rejected(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)))


def problem(event_id: Column, occurred_at: Column, event_type: Column) -> Column:
    """Why a version-2 event (all strings) is refused, or null."""
    zoned = occurred_at.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    return (
        F.when(event_id.isNull() | (F.trim(event_id) == ""), "missing id")
        .when(event_id != F.trim(event_id), "untrimmed id")
        .when(F.length(event_id) > 128, "long id")
        .when(~F.coalesce(event_type.isin(*EVENT_TYPES), F.lit(False)), "unknown type")
        .when(F.try_to_timestamp(occurred_at).isNull(), "bad time")
        .when(~zoned, "no zone")
    )


def deltas(events: DataFrame) -> DataFrame:
    """Change of the current count, and the fields of day and interval that each event adds to."""
    enter = F.col("event_type").endswith("Enter")
    stream = F.when(F.col("event_type").startswith("Vehicle"), "vehicle").otherwise("person")
    way = F.when(enter, "in").otherwise("out")
    return events.withColumns({"stream": stream, "delta": F.when(enter, 1).otherwise(-1), "day_field": F.concat(F.lit("day_"), stream, F.lit("_"), way), "interval_field": F.concat(stream, F.lit("_"), way)})


def stream_of(class_name: Column) -> Column:
    """Vehicle, Person, or null for a class that can't be counted."""
    return F.when(class_name.isin(*PERSON_CLASSES), "Person").when(class_name.isin(*VEHICLE_CLASSES), "Vehicle")


def class_of(coco_id: Column) -> Column:
    """Class of a detector's id; null for others."""
    ids = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
    out = None
    for k, v in ids.items():
        out = F.when(coco_id == k, v) if out is None else out.when(coco_id == k, v)
    return out


def for_camera(tracks: DataFrame, camera_type: Column) -> DataFrame:
    """Tracks of the classes that a camera type looks at; other types look at all."""
    c = F.col("class_name")
    return tracks.where(F.when(camera_type == "vehicle", c.isin(*VEHICLE_CLASSES)).when(camera_type == "person", c.isin(*PERSON_CLASSES)).otherwise(True))


def first_by_id(events: DataFrame, key: str = "event_id", *order: str) -> DataFrame:
    """The first arrival of each id; rows without an id are all kept.

    The struct minimum combines on the map side, so that a hot id costs a row per task.
    """
    cols = [c for c in events.columns if c not in (key, *order)]
    first = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *cols)).alias("_s")).select(key, "_s.*")
    return first.select(*events.columns).unionByName(events.where(F.col(key).isNull()))


def conflicts(events: DataFrame, digest: Column, key: str = "event_id") -> DataFrame:
    """Ids that came with different content."""
    return events.groupBy(key).agg(F.min(digest).alias("a"), F.max(digest).alias("b"), F.count("*").alias("n")).where("a != b").select(key, "n")


def content_digest(*columns: str) -> Column:
    """SHA-256 of the columns as compact JSON with sorted names; nulls are written as such."""
    return F.sha2(sorted_json(*columns), 256)


def identity_digest(device: str, kind: str, iso: Column) -> Column:
    """SHA-256 of the three as a compact JSON array; nulls are written as such."""
    return F.sha2(F.to_json(F.array(F.col(device), F.col(kind), iso), {"ignoreNullFields": "false"}), 256)


def head_of_queue(pending: DataFrame, key: str, order: str, due: Column) -> DataFrame:
    """The oldest pending row of each key, if it is due: a head that waits blocks its queue."""
    oldest = pending.groupBy(key).agg(F.min_by(F.struct(*[c for c in pending.columns if c != key]), order).alias("_s")).select(key, "_s.*")
    return oldest.where(due)


def split_late(events: DataFrame, hour: Column, now_hour: Column, oldest_hour: Column) -> DataFrame:
    """``route``: on_time, late (its hour is computed again) or quarantine (its hour is beyond retention)."""
    return events.withColumn("route", F.when(hour >= now_hour, "on_time").when(hour >= oldest_hour, "late").otherwise("quarantine"))


def apply_late(late: DataFrame, buckets: DataFrame, quarantined: DataFrame, now_us: Column) -> DataFrame:
    """``late`` events (device_id, hour_us, ...) with ``route``: ``apply`` only where their hour is provably intact.

    ``buckets``: hourly counts that are there, (device_id, hour_us, expires_us), and those of all devices together with a
    null device_id. ``quarantined``: (device_id, hour_us) given up before. Both counts must be there and not expired at
    ``now_us``, a column of ``late``; else the event goes to ``quarantine``, with the ``reason``, and its hour with it: part
    of an hour's events must not replace its archive. The hours to add are the distinct ones of that route.
    """
    at = ["device_id", "hour_us"]
    own = buckets.where("device_id is not null").groupBy(*at).agg(F.max("expires_us").alias("_own"))
    all_ = buckets.where("device_id is null").groupBy("hour_us").agg(F.max("expires_us").alias("_all"))
    given_up = quarantined.select(*at, F.lit(True).alias("_gone")).distinct()
    joined = late.join(own, at, "left").join(all_, "hour_us", "left").join(given_up, at, "left")
    missing, until = F.col("_own").isNull() | F.col("_all").isNull(), F.least("_own", "_all")
    reason = F.when(F.coalesce("_gone", F.lit(False)), "quarantined before").when(missing, "no bucket").when(until <= now_us, "expired")
    return joined.withColumn("reason", reason).withColumn("route", F.when(F.col("reason").isNull(), "apply").otherwise("quarantine")).select(*late.columns, "route", "reason")


def consecutive(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Edges of a flag along each key: onset where it turns true, recovery where it turns false."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.lag(flag).over(w), F.lit(False))
    return df.withColumn("transition", F.when(flag & ~before, "onset").when(~flag & before, "recovery")).where("transition is not null")
