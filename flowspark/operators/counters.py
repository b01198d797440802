"""Counters as views of the event facts: current, daily, interval, hourly, and their archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.timing import minute_floor
from flowspark.operators.events import deltas

MEASURES = {"vehicle_in": "VehicleEnter", "vehicle_out": "VehicleExit", "person_in": "PersonEnter", "person_out": "PersonExit"}


def four_counts() -> list[Column]:
    return [F.count_if(F.col("event_type") == t).cast("long").alias(m) for m, t in MEASURES.items()]


#: Microseconds of a block, in which one task orders a stream's events.
BLOCK = 60_000_000


def _blocks(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with their running sum inside a block, and per block the sum and lowest prefix of all blocks before."""
    inside = Window.partitionBy("stream", "block").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    run = deltas(events).withColumn("block", F.floor(F.col("us") / BLOCK)).withColumn("s", F.sum("delta").over(inside)).withColumn("low", F.min("s").over(inside))
    sums = run.groupBy("stream", "block").agg(F.sum("delta").alias("total"), F.min("s").alias("lowest"))
    w = Window.partitionBy("stream").orderBy("block")
    chained = sums.withColumn("base", F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("below", F.coalesce(F.min(F.col("base") + F.col("lowest")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return run, chained


def floored_current(events: DataFrame) -> DataFrame:
    """Running count of each stream, never below 0 after any event, in order of time and id.

    S minus its lowest prefix below 0 equals clamping after each step. Minutes are summed apart and chained by one row
    each, so that no task holds a whole stream, or all devices' events of an hour.
    """
    run, blocks = _blocks(events)
    joined = run.join(blocks.select("stream", "block", "base", "below"), ["stream", "block"])
    current = F.col("base") + F.col("s") - F.least(F.lit(0), F.col("below"), F.col("base") + F.col("low"))
    return joined.withColumn("current", current.cast("long")).drop("block", "s", "low", "base", "below")


def floored_total(events: DataFrame) -> DataFrame:
    """The last value of ``floored_current`` for each stream."""
    _, blocks = _blocks(events)
    final = F.max_by(F.col("base") + F.col("total"), "block") - F.least(F.lit(0), F.min(F.col("base") + F.col("lowest")))
    return blocks.groupBy("stream").agg(final.cast("long").alias("current"))


def device_current(events: DataFrame) -> DataFrame:
    """Sum of changes of each device and stream, shown as 0 where negative."""
    return deltas(events).groupBy("device_id").pivot("stream", ["vehicle", "person"]).agg(F.sum("delta")).select("device_id", *[F.greatest(F.lit(0), F.coalesce(F.col(s), F.lit(0))).cast("long").alias(f"current_{s}s") for s in ("vehicle", "person")])


def totals(events: DataFrame, *keys: Column) -> DataFrame:
    return events.groupBy(*keys).agg(*four_counts())


def daily(events: DataFrame, by_device: bool = False) -> DataFrame:
    return totals(events, *([F.col("device_id")] if by_device else []), F.date_format("occurred_at", "yyyy-MM-dd").alias("stat_date"))


def interval(events: DataFrame, minutes: int) -> DataFrame:
    return totals(events, minute_floor("occurred_at", minutes).alias("bucket"))


def hourly(events: DataFrame, by_device: bool = True) -> DataFrame:
    return totals(events, *([F.col("device_id")] if by_device else []), F.date_format("occurred_at", "yyyy-MM-dd").alias("stat_date"), F.hour("occurred_at").alias("hour"))


def levels(hours: DataFrame) -> DataFrame:
    """All levels of the archive in one pass: device and hour, hour, day, all."""
    sums = [F.sum(m).cast("long").alias(m) for m in MEASURES]
    return hours.rollup("stat_date", "hour", "device_id").agg(F.grouping_id().cast("int").alias("level"), *sums)


def in_range(hours: DataFrame, start: tuple[str, int], end: tuple[str, int], devices: list[str] | None = None) -> DataFrame:
    """Hours of a closed range of (date, hour); an empty list of devices gives no rows."""
    d, h = F.col("stat_date"), F.col("hour")
    inside = ((d > start[0]) | (d == start[0]) & (h >= start[1])) & ((d < end[0]) | (d == end[0]) & (h <= end[1]))
    out = hours.where(d.between(start[0], end[0]) & inside)
    return out if devices is None else out.where(F.col("device_id").isin(devices) if devices else F.lit(False))


def history(hours: DataFrame) -> DataFrame:
    return hours.groupBy("stat_date", "hour").agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES]).orderBy("stat_date", "hour")


def reset_current(events: DataFrame, resets: DataFrame) -> DataFrame:
    """Current counts since the last reset of each device; flows are untouched."""
    last = resets.groupBy("device_id").agg(F.max("us").alias("reset_us"))
    return device_current(events.join(last, "device_id", "left").where("reset_us is null or us > reset_us"))


def passage_index(scores: DataFrame, score: str = "score") -> DataFrame:
    """100 less the mean score in hundredths, rounded half up and kept in 0 to 100, with its level."""
    index = F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 - 100 * F.avg(score)).cast("int")))
    return scores.agg(index.alias("passage_index")).withColumn("level", F.when(F.col("passage_index") > 85, "smooth").when(F.col("passage_index") > 70, "slow").otherwise("congested"))


def present(late: DataFrame, facts: DataFrame) -> DataFrame:
    """Late events, once each, whose ids are among the facts; those without an id are taken as they come.

    Facts are looked up within the dates of the late events only.
    """
    day = F.date_format("occurred_at", "yyyy-MM-dd")
    known = late.where("event_id is not null").dropDuplicates(["event_id"]).withColumn("_day", day)
    there = facts.select("event_id", day.alias("_day")).join(F.broadcast(known.select("_day").distinct()), "_day", "left_semi")
    return known.join(there, ["event_id", "_day"], "left_semi").drop("_day").unionByName(late.where("event_id is null"))


def late_marks(late: DataFrame) -> DataFrame:
    """Hours that late events touched, with a version that every further late event raises."""
    hours = late.select("device_id", F.date_format("occurred_at", "yyyy-MM-dd").alias("stat_date"), F.hour("occurred_at").alias("hour"))
    return hours.groupBy("device_id", "stat_date", "hour").agg(F.count("*").alias("version"))


def unacknowledged(marks: DataFrame, done: DataFrame) -> DataFrame:
    """Marks whose version no acknowledgement in ``done`` (of the marks' columns) names.

    An hour that was archived while another late event came in keeps its mark: only the version archived is cleared.
    """
    return marks.join(done.select(*marks.columns).distinct(), marks.columns, "left_anti")


def archived_again(facts: DataFrame, marks: DataFrame) -> DataFrame:
    """The marked hours counted again from all facts, with the version that the counts hold and acknowledge."""
    at = {"stat_date": F.date_format("occurred_at", "yyyy-MM-dd"), "hour": F.hour("occurred_at")}
    touched = facts.withColumns(at).join(marks, ["device_id", "stat_date", "hour"])
    return touched.groupBy("device_id", "stat_date", "hour", "version").agg(*four_counts())
