"""Congestion: score, transitions, latest reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.events import consecutive


def _dimension(count: Column, flow: Column, most: Column, least_flow: Column) -> tuple[Column, Column, Column]:
    """Whether a dimension is configured, congested, and its score."""
    active = most > 0
    crowd = F.least(F.lit(1.0), count / F.when(active, most))
    speed = F.when(least_flow <= 0, 0.0).otherwise(F.least(F.lit(1.0), flow / F.when(least_flow > 0, least_flow)))
    slow = F.when(count == 0, 0.0).otherwise(1 - speed)
    return active, active & (count >= most) & (flow < least_flow), F.when(active, 0.5 * crowd + 0.5 * slow).otherwise(0.0)


def judge(reports: DataFrame, weights: tuple[float, float] = (0.5, 0.5), threshold: float = 0.7) -> DataFrame:
    """Score (not rounded) and verdict of reports with max_vehicles, min_v_flow, max_persons, min_p_flow."""
    v_on, v_bad, v = _dimension(F.col("roi_vehicles"), F.col("v_flow"), F.col("max_vehicles"), F.col("min_v_flow"))
    p_on, p_bad, p = _dimension(F.col("roi_persons"), F.col("p_flow"), F.col("max_persons"), F.col("min_p_flow"))
    total = sum(weights)
    wv, wp = (weights[0] / total, weights[1] / total) if total > 0 else (0.5, 0.5)
    both = v * wv + p * wp
    return reports.withColumns({"score": F.when(v_on & p_on, both).when(v_on, v).when(p_on, p).otherwise(0.0), "congested": F.coalesce(F.when(v_on & p_on, both >= threshold).when(v_on, v_bad).when(p_on, p_bad), F.lit(False))})


def transitions(judged: DataFrame) -> DataFrame:
    """Onset and recovery of congestion at each device."""
    return consecutive(judged, "device_id", ["us", "report_id"], F.col("congested"))


def latest(rows: DataFrame, key: str, order: list[str], now_us: int | None = None, ttl_s: int | None = None) -> DataFrame:
    """The last row of each key, if not older than its time to live. Combines on the map side."""
    cols = [c for c in rows.columns if c not in (key, *order)]
    last = rows.groupBy(key).agg(F.max(F.struct(*order, *cols)).alias("_s")).select(key, "_s.*").select(*rows.columns)
    return last if ttl_s is None else last.where(F.lit(now_us) - F.col("us") <= ttl_s * 1_000_000)
