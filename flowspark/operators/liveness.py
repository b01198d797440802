"""Heartbeats, coverage gaps, clock jumps, pipeline health, confirmed anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.quantiles import quantiles

HEALTHY_FPS = 5


def heartbeat_status(devices: DataFrame, now_us: int, limit_s: int = 90) -> DataFrame:
    """Status of devices (status, last_us) at ``now_us``; a device without any heartbeat keeps its status."""
    age = (F.lit(now_us) - F.col("last_us")) / 1_000_000
    status = F.when(F.col("last_us").isNull(), F.col("status")).when(age > limit_s, "offline").when(F.col("status") == "offline", "online").otherwise(F.col("status"))
    return devices.withColumns({"new_status": status, "alert": F.coalesce((age > limit_s) & (F.col("status") != "offline"), F.lit(False))})


def timeouts(beats: DataFrame, limit_s: int = 90, now_us: int | None = None) -> DataFrame:
    """Times without a heartbeat for more than the limit: (device_id, offline_us, recovered_us or null)."""
    w = Window.partitionBy("device_id").orderBy("us")
    nxt = F.lead("us").over(w)
    gone = beats.withColumn("next", nxt).where(F.coalesce("next", F.lit(now_us)) - F.col("us") > limit_s * 1_000_000)
    return gone.select("device_id", (F.col("us") + limit_s * 1_000_000).alias("offline_us"), F.col("next").alias("recovered_us"))


def coverage_gaps(samples: DataFrame) -> DataFrame:
    """Gaps of coverage from samples (device_id, stream_epoch, state, observed).

    A gap opens at a sample that isn't processing, or whose stream epoch is new, from the sample before; it closes at
    the next processing sample. Islands: a gap's samples share the number of processing samples before them.
    """
    w = Window.partitionBy("device_id").orderBy("observed")
    ok = F.col("state") == "processing"
    before = samples.withColumns({"prev": F.lag("observed").over(w), "prev_epoch": F.lag("stream_epoch").over(w), "prev_ok": F.lag(ok).over(w)})
    changed = F.col("prev_epoch").isNotNull() & (F.col("prev_epoch") != F.col("stream_epoch"))
    gap_open = ~F.coalesce("prev_ok", F.lit(True))
    opens = ~gap_open & (~ok | changed)
    marked = before.withColumns({"opens": opens, "inside": opens | gap_open}).where("inside")
    numbered = marked.withColumn("gap", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reason = F.when(~ok, F.col("state")).otherwise("stream_epoch_changed_or_restart")
    return numbered.groupBy("device_id", "gap").agg(
        F.min_by("stream_epoch", "observed").alias("stream_epoch"),
        F.min_by(F.least(F.coalesce("prev", "observed"), F.col("observed")), "observed").alias("start"),
        F.max(F.when(ok, F.col("observed"))).alias("end"),
        F.min_by(reason, "observed").alias("reason"),
    )


def sessions(frames: DataFrame, jump_s: float = 2.0) -> DataFrame:
    """Session number of frames (device_id, t_mono, t_wall): a wall clock that jumps or stands starts a new one."""
    w = Window.partitionBy("device_id").orderBy("t_mono")
    wall, mono = F.col("t_wall") - F.lag("t_wall").over(w), F.col("t_mono") - F.lag("t_mono").over(w)
    jump = F.coalesce((F.abs(wall - mono) > jump_s) | (wall <= 0), F.lit(False))
    return frames.withColumn("jump", jump).withColumn("session", F.sum(F.col("jump").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def health(rows: DataFrame, stall_s: float = 15.0) -> DataFrame:
    """State of a pipeline in fixed priority: running, persist_age, packet_age, success_age, start_age, anomaly, fps."""
    limit = max(1.0, stall_s)
    state = (
        F.when(~F.col("running"), "stopped")
        .when(F.col("persist_age") >= 5.0, "event_persist_blocked")
        .when(F.col("packet_age").isNull(), F.when(F.col("start_age") < limit, "waiting_first_frame").otherwise("no_frames"))
        .when(F.col("packet_age") >= limit, "no_recent_frame")
        .when(F.col("success_age").isNull() | (F.col("success_age") >= limit), "no_recent_inference")
        .when(F.col("anomaly").isin("black_screen", "flower_screen"), F.col("anomaly"))
        .when((F.col("start_age") >= 30.0) & (F.col("fps") < HEALTHY_FPS), "low_fps")
        .otherwise("processing")
    )
    return rows.withColumn("state", state)


def confirmed(samples: DataFrame, confirm: int = 3) -> DataFrame:
    """Onsets and recoveries from samples (device_id, n, anomaly or null): an onset takes ``confirm`` bad ones in a row.

    The run counts bad samples of any type; a change of type after that is an onset of its own.
    """
    w = Window.partitionBy("device_id").orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("anomaly").isNull()
    runs = samples.withColumn("run", F.sum(good.cast("int")).over(upto))
    in_run = Window.partitionBy("device_id", "run").orderBy("n")
    bad = runs.withColumn("length", F.count("anomaly").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    state = F.when(good, None).when(F.col("length") >= confirm, F.col("anomaly"))
    held = bad.withColumn("state", state).withColumn("before", F.lag("state").over(w))
    event = F.when(F.col("state").isNotNull() & ~F.coalesce(F.col("state") == F.col("before"), F.lit(False)), "onset").when(good & F.col("before").isNotNull(), "recovery")
    return held.withColumn("phase", event).where("phase is not null").select("device_id", "n", F.coalesce("state", "before").alias("type"), "phase")


def percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank 95th and 99th hundredths of a value."""
    return quantiles(rows, keys, value, {"p95": 0.95, "p99": 0.99})
