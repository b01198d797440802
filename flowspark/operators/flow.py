"""Sliding flows and per-track motion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: a slice of time in intervals; one in so many rows is copied
SLICE = 64


def _sliced(rows: DataFrame, keys: list[str], seconds: int) -> tuple[DataFrame, Window]:
    """``rows`` dealt by key and slice of time, and the window of the trailing interval within a slice.

    Rows within ``seconds`` of a slice's end come to the next slice too, as copies, so that no task orders a key's
    whole history. Leave copies (``_copy`` = 1) out of the result.
    """
    reach = seconds * 1_000_000
    at = F.pmod(F.col("us"), F.lit(SLICE * reach))
    copies = F.explode(F.when(at >= SLICE * reach - reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    start = F.col("us") - at + F.col("_copy") * F.lit(SLICE * reach)
    dealt = rows.select("*", copies.alias("_copy")).withColumn("_slice", start)
    return dealt, Window.partitionBy(*keys, "_slice").orderBy("us").rangeBetween(-reach, 0)


def trailing(events: DataFrame, keys: list[str], seconds: int = 60, most: int = 4096) -> DataFrame:
    """Events of each key within the closed interval [t - seconds, t] of each event."""
    rows, w = _sliced(events, keys, seconds)
    return rows.withColumn("flow", F.least(F.lit(most), F.count("*").over(w)).cast("long")).where("_copy = 0").drop("_copy", "_slice")


def directional(events: DataFrame, seconds: int = 60) -> DataFrame:
    """The four directions' counts in the trailing interval, per minute."""
    rows, w = _sliced(events.select("event_id", "device_id", "event_type", "us"), ["device_id"], seconds)
    names = {"v_in": "VehicleEnter", "v_out": "VehicleExit", "p_in": "PersonEnter", "p_out": "PersonExit"}
    counted = rows.select("event_id", "device_id", "_copy", *[(F.count_if(F.col("event_type") == t).over(w) * 60.0 / seconds).alias(n) for n, t in names.items()])
    return counted.where("_copy = 0").drop("_copy")


def at_reports(events: DataFrame, reports: DataFrame, seconds: int = 60) -> DataFrame:
    """Events of a device in the closed interval before each of its reports.

    Events and reports are one ordered stream for a range window: no join, no product.
    """
    both = events.select("device_id", "us", F.lit(1).alias("is_event"), F.lit(None).cast("long").alias("report_id")).union(reports.select("device_id", "us", F.lit(0), "report_id"))
    rows, w = _sliced(both, ["device_id"], seconds)
    return rows.withColumn("flow", F.sum("is_event").over(w).cast("long")).where("report_id is not null and _copy = 0").select("report_id", "device_id", "flow")


def _track(order: str = "n"):
    return Window.partitionBy("device_id", "track_id").orderBy(order)


def motion(obs: DataFrame) -> DataFrame:
    """Step velocity (mean of the last two moves), velocity a second over the last three points, direction cosine."""
    w = _track()
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    moved = obs.withColumns({"dx": dx, "dy": dy, "dt": F.col("t") - F.lag("t").over(w)})
    two, three = w.rowsBetween(-1, 0), w.rowsBetween(-2, 0)
    span = F.col("t") - F.first("t").over(three)
    px, py = F.lag("dx").over(w), F.lag("dy").over(w)
    norm = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) * F.sqrt(px**2 + py**2)
    return moved.withColumns(
        {
            "step_vx": F.avg("dx").over(two),
            "step_vy": F.avg("dy").over(two),
            "vx": F.when(span > 0, (F.col("x") - F.first("x").over(three)) / span),
            "vy": F.when(span > 0, (F.col("y") - F.first("y").over(three)) / span),
            "cosine": F.when(norm > 1e-12, (F.col("dx") * px + F.col("dy") * py) / norm),
        }
    )


def past_speed(obs: DataFrame, window: int = 30) -> DataFrame:
    """Mean speed (moves a 25th of a second) of all but the last step of the bounded history."""
    w = _track()
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2) / ((F.col("t") - F.lag("t").over(w)) * 25)
    return obs.withColumn("step", step).withColumn("past_speed", F.avg("step").over(w.rowsBetween(2 - window, -1)))


def recent_points(obs: DataFrame, n: int = 30) -> DataFrame:
    return obs.withColumn("history", F.collect_list(F.struct("x", "y")).over(_track().rowsBetween(1 - n, 0)))


def moving_average(values: DataFrame, keys: list[str], order: str, value: str, keep: float = 0.9) -> DataFrame:
    """Exponential moving average of each key at its last row: a weighted sum, so that tasks add up parts of a key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) - 1
    ranked = values.select(*keys, F.col(value).cast("double").alias("_v"), last.alias("_age"), (F.count("*").over(Window.partitionBy(*keys)) - 1).alias("_oldest"))
    weight = F.when(F.col("_age") == F.col("_oldest"), F.pow(F.lit(keep), "_age")).otherwise((1 - keep) * F.pow(F.lit(keep), "_age"))
    return ranked.groupBy(*keys).agg(F.sum(F.col("_v") * weight).alias("average"))


def counter_steps(samples: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Increase of a counter between samples; a counter that fell has restarted and counts from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(column) - F.coalesce(F.lag(column).over(w), F.lit(0))
    return samples.withColumn("step", F.when(step < 0, F.col(column)).otherwise(step))


def busy_percent(samples: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Busy share between successive samples of (idle, total), in hundredths."""
    w = Window.partitionBy(*keys).orderBy(order)
    total, idle = F.col("total") - F.lag("total").over(w), F.col("idle") - F.lag("idle").over(w)
    return samples.withColumn("busy", F.when(total > 0, 100.0 * (total - idle) / total))


def filled(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def largest_gap(samples: DataFrame, keys: list[str], order: str = "us", now_us: int | None = None) -> DataFrame:
    """Largest time between samples of each key, the open one up to ``now_us`` included."""
    w = Window.partitionBy(*keys).orderBy(order)
    gaps = samples.withColumn("gap", F.col(order) - F.lag(order).over(w))
    largest = F.max("gap")
    if now_us is not None:
        largest = F.greatest(largest, F.lit(now_us) - F.max(order))
    return gaps.groupBy(*keys).agg(largest.cast("long").alias("max_gap_us"))
