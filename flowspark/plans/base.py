"""The queries' registry, and the test tables' domain views as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

INGEST = """ing AS (SELECT event_id, 'cam-' || (user_id % 32)::VARCHAR AS device_id,
  CASE event_type WHEN 'view' THEN 'VehicleEnter' WHEN 'click' THEN 'VehicleExit' WHEN 'signup' THEN 'PersonEnter' WHEN 'purchase' THEN 'PersonExit' ELSE 'Invalid' END AS event_type,
  ts AS occurred_at, epoch_us(ts) AS us FROM events),
val AS (SELECT *, CASE WHEN event_type LIKE 'Vehicle%' THEN 'vehicle' ELSE 'person' END AS stream,
  CASE WHEN event_type LIKE '%Enter' THEN 1 ELSE -1 END AS delta, strftime(occurred_at, '%Y-%m-%d') AS stat_date, hour(occurred_at)::INT AS hour FROM ing WHERE event_type <> 'Invalid')"""
FOUR = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}')::BIGINT AS {m}" for m, t in (("vehicle_in", "VehicleEnter"), ("vehicle_out", "VehicleExit"), ("person_in", "PersonEnter"), ("person_out", "PersonExit")))
SUMS = ", ".join(f"sum({m})::BIGINT AS {m}" for m in ("vehicle_in", "vehicle_out", "person_in", "person_out"))
HOURS = f"{INGEST}, hrs AS (SELECT device_id, stat_date, hour, {FOUR} FROM val GROUP BY ALL)"
REPORTS = """rep AS (SELECT event_id AS report_id, 'cam-' || (user_id % 32)::VARCHAR AS device_id, (json_extract(props, '$.k')::INT % 25) AS roi_vehicles,
  (json_extract(props, '$.k')::INT % 60) AS roi_persons, value AS v_flow, value / 2 AS p_flow, epoch_us(ts) AS us FROM events)"""
OBS = """obs AS (SELECT 'cam-' || (user_id % 32)::VARCHAR AS device_id, user_id AS track_id,
  ['person', 'bicycle', 'motorcycle', 'car', 'truck', 'bus'][user_id % 6 + 1] AS class_name,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 0.2::DOUBLE AS t, json_extract(props, '$.k')::INT / 100.0::DOUBLE AS x, (value % 100) / 100.0::DOUBLE AS y FROM events)"""
DEVICES = """dev AS (SELECT s_suppkey AS device_key, CASE WHEN s_suppkey % 7 = 0 THEN n_name || ' gate ' || s_suppkey::VARCHAR ELSE n_name || 'gate' || s_suppkey::VARCHAR END AS name,
  ['both-way lane', 'entry gate', 'exit gate', 'walkway', 'checkpoint'][s_suppkey % 5 + 1] AS category,
  (s_suppkey * 37 % 360 - 180) / 10.0::DOUBLE AS longitude, (s_suppkey * 53 % 180 - 90) / 10.0::DOUBLE AS latitude, n_name AS nation, r_name AS region, s_acctbal AS load
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
REGIONS = "reg AS (SELECT r_regionkey AS ordinal, r_name AS region, r_regionkey * 7.0::DOUBLE - 14.0 AS center_x, r_regionkey * 3.5::DOUBLE - 7.0 AS center_y, (r_regionkey * 2 + 3)::INT AS officers FROM region)"


def digest_number(*parts: str) -> str:
    """SQL of ``arrays.digest_number``."""
    return f"('0x' || left(md5(concat_ws('-', {', '.join(parts)})), 13))::BIGINT"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep
