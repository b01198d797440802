"""Queries on event facts: ingest, deduplication, counters, archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions import timing
from flowspark.functions.canonical import event_digest
from flowspark.operators import congestion, counters, events, flow
from flowspark.plans.base import FOUR, HOURS, INGEST, REPORTS, SUMS, query
from flowspark.sources import tables

RANGE = (("2024-01-03", 5), ("2024-01-20", 17))
IN_RANGE = "(stat_date > '2024-01-03' OR (stat_date = '2024-01-03' AND hour >= 5)) AND (stat_date < '2024-01-20' OR (stat_date = '2024-01-20' AND hour <= 17))"


@query("src01_ingest_valid", f"WITH {INGEST} SELECT event_id, device_id, event_type FROM val")
def src01(spark, sf):
    return tables.valid(spark, sf).select("event_id", "device_id", "event_type")


@query("flt08_rejected_types", f"WITH {INGEST} SELECT event_id, device_id, event_type FROM ing WHERE event_type = 'Invalid'")
def flt08(spark, sf):
    return events.rejected(tables.ingest(spark, sf)).select("event_id", "device_id", "event_type")


_V2 = f"""WITH {INGEST}, v AS (SELECT event_id AS n, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ' x' WHEN event_id % 17 = 0 THEN repeat('x', 129) ELSE 'e' || event_id::VARCHAR END AS id, event_type,
  strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 3 = 0 THEN '' ELSE '+08:00' END AS stamp FROM ing)
SELECT n AS event_id, CASE WHEN id IS NULL OR trim(id) = '' THEN 'missing id' WHEN id <> trim(id) THEN 'untrimmed id' WHEN length(id) > 128 THEN 'long id' WHEN event_type = 'Invalid' THEN 'unknown type' WHEN NOT regexp_matches(stamp, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN 'no zone' END AS problem FROM v"""


@query("src02_validate_v2", _V2)
def src02(spark, sf):
    n = F.col("event_id")
    ident = F.when(n % 11 == 0, F.lit(None).cast("string")).when(n % 13 == 0, " x").when(n % 17 == 0, F.repeat(F.lit("x"), 129)).otherwise(F.concat(F.lit("e"), n.cast("string")))
    at = F.concat(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 3 == 0, "").otherwise("+08:00"))
    return tables.ingest(spark, sf).select("event_id", events.problem(ident, at, F.col("event_type")).alias("problem"))


_DUPS = f"""{INGEST}, dup AS (SELECT event_id, device_id, event_type, us, 0 AS arrival FROM ing UNION ALL
  SELECT event_id, device_id, CASE WHEN event_id % 50 = 0 THEN 'PersonExit' ELSE event_type END, us, 1 FROM ing WHERE event_id % 10 = 0)"""


@query("str02_dedup_first_arrival", f"WITH {_DUPS} SELECT event_id, device_id, event_type FROM dup QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival) = 1")
def str02(spark, sf):
    return events.first_by_id(tables.duplicated(spark, sf).select("event_id", "arrival", "device_id", "event_type"), "event_id", "arrival").select("event_id", "device_id", "event_type")


@query("set03_digest_conflicts", f"WITH {_DUPS} SELECT event_id, count(*) AS n FROM dup GROUP BY event_id HAVING count(DISTINCT device_id || '|' || event_type) > 1")
def set03(spark, sf):
    return events.conflicts(tables.duplicated(spark, sf), events.content_digest("device_id", "event_type"))


@query("prj01_content_digest", f"""WITH {INGEST} SELECT event_id, sha256('{{"device_id":"' || device_id || '","event_type":' || CASE WHEN event_id % 9 = 0 THEN 'null' ELSE '"' || event_type || '"' END || '}}') AS digest FROM ing""")
def prj01(spark, sf):
    rows = tables.ingest(spark, sf).withColumn("event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_type")))
    return rows.select("event_id", events.content_digest("event_type", "device_id").alias("digest"))


_NESTED = """'{"event":{"device_id":"' || device_id || '","event_id":' || event_id::VARCHAR || ',"event_type":"' || event_type || '"},"evidence":{"a":[1,{"b":null,"c":"é"}],"track":{"k":' || (event_id % 97)::VARCHAR || ',"z":' || CASE event_id % 2 WHEN 0 THEN 'true' ELSE '0.5' END || '}}}'"""


@query("prj01_canonical_digest", f"""WITH {INGEST} SELECT event_id, sha256({_NESTED}) AS digest FROM ing""")
def prj01_nested(spark, sf):
    """Evidence as devices send it, in two orders of keys and with white space; one digest for the same content."""
    n, z = (F.col("event_id") % 97).cast("string"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("0.50")
    one = F.concat(F.lit('{"track": {"z": '), z, F.lit(', "k": '), n, F.lit('}, "a": [1, {"c": "é", "b": null}]}'))
    other = F.concat(F.lit('{"a":[1,{"b":null,"c":"\\u00e9"}],"track":{"k":'), n, F.lit(',"z":'), z, F.lit("}}"))
    rows = tables.ingest(spark, sf).withColumn("evidence", F.when(F.col("event_id") % 3 == 0, one).otherwise(other))
    return rows.select("event_id", event_digest(["event_type", "device_id", "event_id"], "evidence").alias("digest"))


@query("prj02_identity_digest", f"""WITH {INGEST} SELECT event_id, sha256('["' || device_id || '",' || CASE WHEN event_id % 9 = 0 THEN 'null' ELSE '"' || event_type || '"' END || ',"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || '"]') AS digest FROM ing""")
def prj02(spark, sf):
    rows = tables.ingest(spark, sf).withColumn("event_type", F.when(F.col("event_id") % 9 != 0, F.col("event_type")))
    return rows.select("event_id", events.identity_digest("device_id", "event_type", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("digest"))


@query("prj03_deltas", f"WITH {INGEST} SELECT event_id, stream, delta, 'day_' || stream || CASE WHEN delta = 1 THEN '_in' ELSE '_out' END AS day_field, stream || CASE WHEN delta = 1 THEN '_in' ELSE '_out' END AS interval_field FROM val")
def prj03(spark, sf):
    return events.deltas(tables.valid(spark, sf)).select("event_id", "stream", "delta", "day_field", "interval_field")


@query("prj06_blank_to_null", "SELECT event_id, TRY_CAST(nullif(trim(CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'x' ELSE (event_id % 1000)::VARCHAR END), '') AS INT) AS v FROM events")
def prj06(spark, sf):
    from flowspark.functions.arrays import blank_to_null

    n = F.col("event_id")
    return tables.table(spark, sf, "events").select("event_id", blank_to_null(F.when(n % 4 == 0, "").when(n % 4 == 1, " ").when(n % 4 == 2, "x").otherwise((n % 1000).cast("string"))).alias("v"))


_FLOOR = f"""WITH {INGEST}, s AS (SELECT *, sum(delta) OVER w AS s FROM val WINDOW w AS (PARTITION BY stream ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, stream, (s - least(0, min(s) OVER (PARTITION BY stream ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS current FROM s"""


@query("win01_floored_current", _FLOOR)
def win01(spark, sf):
    return counters.floored_current(tables.valid(spark, sf)).select("event_id", "stream", "current")


@query("agg02_global_current", f"SELECT stream, arg_max(current, event_id) AS current FROM (SELECT v.stream, v.event_id, f.current FROM ({_FLOOR}) f JOIN (WITH {INGEST} SELECT stream, event_id FROM val QUALIFY row_number() OVER (PARTITION BY stream ORDER BY us DESC, event_id DESC) = 1) v USING (event_id)) GROUP BY stream")
def agg02(spark, sf):
    return counters.floored_total(tables.valid(spark, sf))


@query("agg03_device_current", f"WITH {INGEST} SELECT device_id, greatest(0, coalesce(sum(delta) FILTER (WHERE stream = 'vehicle'), 0))::BIGINT AS current_vehicles, greatest(0, coalesce(sum(delta) FILTER (WHERE stream = 'person'), 0))::BIGINT AS current_persons FROM val GROUP BY device_id")
def agg03(spark, sf):
    return counters.device_current(tables.valid(spark, sf))


@query("agg04_daily", f"WITH {INGEST} SELECT stat_date, {FOUR} FROM val GROUP BY ALL")
def agg04(spark, sf):
    return counters.daily(tables.valid(spark, sf))


@query("agg05_daily_device", f"WITH {INGEST} SELECT device_id, stat_date, {FOUR} FROM val GROUP BY ALL")
def agg05(spark, sf):
    return counters.daily(tables.valid(spark, sf), by_device=True)


@query("agg06_interval_7min", f"WITH {INGEST} SELECT strftime(occurred_at, '%Y-%m-%d %H') || ':' || lpad((minute(occurred_at) // 7 * 7)::VARCHAR, 2, '0') AS bucket, {FOUR} FROM val GROUP BY ALL")
def agg06(spark, sf):
    return counters.interval(tables.valid(spark, sf), 7)


@query("agg07_hourly_device", f"WITH {INGEST} SELECT device_id, stat_date, hour, {FOUR} FROM val GROUP BY ALL")
def agg07(spark, sf):
    return counters.hourly(tables.valid(spark, sf))


@query("agg08_hourly_all", f"WITH {INGEST} SELECT stat_date, hour, {FOUR} FROM val GROUP BY ALL")
def agg08(spark, sf):
    return counters.hourly(tables.valid(spark, sf), by_device=False)


@query("agg01_apply_events", f"WITH {_DUPS}, one AS (SELECT * FROM dup QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival) = 1) SELECT device_id, {FOUR} FROM one WHERE event_type <> 'Invalid' GROUP BY ALL")
def agg01(spark, sf):
    once = events.first_by_id(tables.duplicated(spark, sf).select("event_id", "arrival", "device_id", "event_type"), "event_id", "arrival")
    return counters.totals(events.known_types(once), F.col("device_id"))


@query("agg09_history_range", f"WITH {HOURS} SELECT stat_date, hour, {SUMS} FROM hrs WHERE {IN_RANGE} GROUP BY ALL")
def agg09(spark, sf):
    return counters.history(counters.in_range(counters.hourly(tables.valid(spark, sf)), *RANGE))


@query("agg10_range_total", f"WITH {HOURS} SELECT {SUMS}, count(*) AS records FROM hrs WHERE {IN_RANGE}")
def agg10(spark, sf):
    hours = counters.in_range(counters.hourly(tables.valid(spark, sf)), *RANGE)
    return hours.agg(*[F.sum(m).alias(m) for m in counters.MEASURES], F.count("*").alias("records"))


@query("agg11_daily_trend", f"WITH {HOURS} SELECT stat_date, {SUMS} FROM hrs GROUP BY ALL")
def agg11(spark, sf):
    return counters.hourly(tables.valid(spark, sf)).groupBy("stat_date").agg(*[F.sum(m).alias(m) for m in counters.MEASURES])


@query("agg07_levels_rollup", f"WITH {HOURS} SELECT stat_date, hour, device_id, GROUPING(stat_date, hour, device_id)::INT AS level, {SUMS} FROM hrs GROUP BY ROLLUP (stat_date, hour, device_id)")
def levels(spark, sf):
    return counters.levels(counters.hourly(tables.valid(spark, sf)))


@query("flt05_device_list", f"WITH {HOURS} SELECT device_id, stat_date, hour, vehicle_in FROM hrs WHERE device_id IN ('cam-1', 'cam-7') AND {IN_RANGE}")
def flt05(spark, sf):
    return counters.in_range(counters.hourly(tables.valid(spark, sf)), *RANGE, ["cam-1", "cam-7"]).select("device_id", "stat_date", "hour", "vehicle_in")


@query("flt05_empty_list", f"WITH {HOURS} SELECT device_id, stat_date, hour, vehicle_in FROM hrs WHERE false")
def flt05_empty(spark, sf):
    return counters.in_range(counters.hourly(tables.valid(spark, sf)), *RANGE, []).select("device_id", "stat_date", "hour", "vehicle_in")


@query("flt03_hour_range", f"WITH {HOURS} SELECT device_id, stat_date, hour FROM hrs WHERE {IN_RANGE}")
def flt03(spark, sf):
    start, end = timing.range_bound("2024-01-03:05", False), timing.range_bound("2024-01-20:17", True)
    return counters.in_range(counters.hourly(tables.valid(spark, sf)), start, end).select("device_id", "stat_date", "hour")


@query("sort01_recent_events", f"WITH {INGEST} SELECT event_id, device_id, event_type FROM val ORDER BY event_id DESC LIMIT 50")
def sort01(spark, sf):
    return tables.valid(spark, sf).orderBy(F.desc("event_id")).limit(50).select("event_id", "device_id", "event_type")


@query("win07_head_of_queue", f"WITH {INGEST}, q AS (SELECT *, event_id % 5 AS wait FROM val WHERE event_id % 3 = 0) SELECT device_id, event_id FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_id) = 1) WHERE wait <= 2")
def win07(spark, sf):
    pending = tables.valid(spark, sf).where("event_id % 3 = 0").select("device_id", "event_id", (F.col("event_id") % 5).alias("wait"))
    return events.head_of_queue(pending, "device_id", "event_id", F.col("wait") <= 2).select("device_id", "event_id")


@query(
    "str03_intact_buckets",
    f"""WITH {INGEST}, v AS (SELECT *, us // 3600000000 * 3600000000 AS h FROM val), m AS (SELECT max(us) AS now FROM v),
own AS (SELECT device_id, h, h + 864000000000 AS e FROM v WHERE event_id % 5 > 0 GROUP BY device_id, h), every AS (SELECT DISTINCT h FROM own), q AS (SELECT DISTINCT device_id, h FROM v WHERE event_id % 97 = 0)
SELECT v.event_id, CASE WHEN q.h IS NOT NULL THEN 'quarantined before' WHEN own.h IS NULL OR every.h IS NULL THEN 'no bucket' WHEN e <= now THEN 'expired' END AS reason
FROM v CROSS JOIN m LEFT JOIN q ON q.device_id = v.device_id AND q.h = v.h LEFT JOIN own ON own.device_id = v.device_id AND own.h = v.h LEFT JOIN every ON every.h = v.h WHERE v.event_id % 5 = 0""",
)
def intact_buckets(spark, sf):
    """Every fifth event came late; the others made the hours' buckets, which last ten days. Some hours were given up."""
    rows = tables.valid(spark, sf).withColumn("hour_us", F.floor(F.col("us") / 3_600_000_000) * 3_600_000_000)
    own = rows.where("event_id % 5 > 0").select("device_id", "hour_us", (F.col("hour_us") + 864_000_000_000).alias("expires_us")).distinct()
    buckets = own.unionByName(own.withColumn("device_id", F.lit(None).cast("string")).distinct())
    gone = rows.where("event_id % 97 = 0").select("device_id", "hour_us")
    late = rows.where("event_id % 5 = 0").join(F.broadcast(rows.agg(F.max("us").alias("now"))))
    return events.apply_late(late, buckets, gone, F.col("now")).select("event_id", "reason")


@query("str03_late_routes", f"WITH {INGEST}, m AS (SELECT max(us) // 3600000000 AS h FROM val) SELECT CASE WHEN us // 3600000000 >= h - 24 THEN 'on_time' WHEN us // 3600000000 >= h - 240 THEN 'late' ELSE 'quarantine' END AS route, count(*) AS n FROM val, m GROUP BY route")
def str03(spark, sf):
    rows = tables.valid(spark, sf)
    now = rows.agg(F.floor(F.max("us") / 3_600_000_000).alias("h"))
    routed = events.split_late(rows.join(F.broadcast(now)), F.floor(F.col("us") / 3_600_000_000), F.col("h") - 24, F.col("h") - 240)
    return routed.groupBy("route").agg(F.count("*").alias("n"))


@query("str06_bucket_expiry", f"WITH {HOURS} SELECT DISTINCT stat_date, hour, strftime((stat_date || ' ' || lpad(hour::VARCHAR, 2, '0') || ':00:00')::TIMESTAMP + INTERVAL 30 DAY + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS expires FROM hrs")
def str06(spark, sf):
    hours = counters.hourly(tables.valid(spark, sf), by_device=False).select("stat_date", "hour")
    return hours.withColumn("expires", timing.expires(F.concat_ws(" ", "stat_date", F.lpad(F.col("hour").cast("string"), 2, "0"))))


@query("str04_completed_hours", f"WITH {HOURS}, m AS (SELECT max(us) // 3600000000 AS h FROM val) SELECT device_id, stat_date, hour, vehicle_in FROM hrs, m WHERE epoch_us((stat_date || ' ' || lpad(hour::VARCHAR, 2, '0') || ':00:00')::TIMESTAMP) // 3600000000 BETWEEN h - 168 AND h - 1")
def str04(spark, sf):
    rows = tables.valid(spark, sf)
    now = rows.agg(F.floor(F.max("us") / 3_600_000_000).alias("h"))
    done = rows.join(F.broadcast(now)).where(F.floor(F.col("us") / 3_600_000_000).between(F.col("h") - 168, F.col("h") - 1))
    return counters.hourly(done).select("device_id", "stat_date", "hour", "vehicle_in")


@query("dt04_business_zone", f"WITH {INGEST} SELECT event_id, strftime(occurred_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS stat_date, hour(occurred_at + INTERVAL 8 HOUR)::INT AS hour FROM val")
def dt04(spark, sf):
    local = timing.in_zone("occurred_at", "Asia/Shanghai")
    return tables.valid(spark, sf).select("event_id", F.date_format(local, "yyyy-MM-dd").alias("stat_date"), F.hour(local).alias("hour"))


@query("dt01_bucket_keys", f"WITH {INGEST} SELECT event_id, strftime(occurred_at, '%Y%m%d') AS day_key, strftime(occurred_at, '%Y%m%d%H') AS hour_key, strftime(occurred_at, '%Y-%m-%d %H') || ':' || lpad((minute(occurred_at) // 15 * 15)::VARCHAR, 2, '0') AS minute_key FROM val")
def dt01(spark, sf):
    return tables.valid(spark, sf).select("event_id", F.date_format("occurred_at", "yyyyMMdd").alias("day_key"), F.date_format("occurred_at", "yyyyMMddHH").alias("hour_key"), timing.minute_floor("occurred_at", 15).alias("minute_key"))


@query("dt09_backfill_hours", f"WITH {HOURS}, g AS (SELECT h FROM range(0, 48) t(h)) SELECT h::INT AS hour_no, strftime(TIMESTAMP '2024-01-10' + to_hours(h), '%Y-%m-%d') AS stat_date, hour(TIMESTAMP '2024-01-10' + to_hours(h))::INT AS hour, coalesce(sum(vehicle_in), 0)::BIGINT AS vehicle_in FROM g LEFT JOIN hrs ON hrs.stat_date = strftime(TIMESTAMP '2024-01-10' + to_hours(h), '%Y-%m-%d') AND hrs.hour = hour(TIMESTAMP '2024-01-10' + to_hours(h)) GROUP BY ALL")
def dt09(spark, sf):
    at = F.expr("timestamp_ntz'2024-01-10 00:00:00' + make_interval(0, 0, 0, 0, hour_no)")
    spine = spark.range(48).select(F.col("id").cast("int").alias("hour_no")).select("hour_no", F.date_format(at, "yyyy-MM-dd").alias("stat_date"), F.hour(at).alias("hour"))
    hours = counters.hourly(tables.valid(spark, sf), by_device=False).select("stat_date", "hour", "vehicle_in")
    return spine.join(hours, ["stat_date", "hour"], "left").select("hour_no", "stat_date", "hour", F.coalesce("vehicle_in", F.lit(0)).cast("long").alias("vehicle_in"))


@query("mth05_backoff", "SELECT event_id, least(60, pow(2, least(event_id % 10, 6)))::INT AS wait FROM events")
def mth05(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", timing.backoff(F.col("event_id") % 10).alias("wait"))


@query("agg23_pending_age", f"WITH {INGEST} SELECT count(*) AS pending, min(us)::BIGINT AS oldest_us FROM val WHERE event_id % 3 = 0")
def agg23(spark, sf):
    return tables.valid(spark, sf).where("event_id % 3 = 0").agg(F.count("*").alias("pending"), F.min("us").alias("oldest_us"))


@query("agg24_quarantine_counts", f"WITH {_DUPS} SELECT count(*) FILTER (WHERE arrival = 1) AS dirty, count(*) FILTER (WHERE event_type = 'Invalid') AS quarantined FROM dup")
def agg24(spark, sf):
    return tables.duplicated(spark, sf).agg(F.count_if(F.col("arrival") == 1).alias("dirty"), F.count_if(F.col("event_type") == "Invalid").alias("quarantined"))


@query("agg20_latest_report", f"WITH {REPORTS}, m AS (SELECT max(us) AS now FROM rep) SELECT device_id, report_id, us::BIGINT AS us FROM (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY us DESC, report_id DESC) = 1), m WHERE now - us <= 86400 * 1000000::BIGINT")
def agg20(spark, sf):
    rows = tables.reports(spark, sf).select("device_id", "report_id", "us")
    now = rows.agg(F.max("us")).scalar()
    return congestion.latest(rows, "device_id", ["us", "report_id"], now, 86400)


@query("reset_current", f"WITH {INGEST}, r AS (SELECT device_id, max(us) AS reset_us FROM val WHERE event_id % 500 = 0 GROUP BY device_id), k AS (SELECT val.* FROM val LEFT JOIN r USING (device_id) WHERE reset_us IS NULL OR us > reset_us) SELECT device_id, greatest(0, coalesce(sum(delta) FILTER (WHERE stream = 'vehicle'), 0))::BIGINT AS current_vehicles, greatest(0, coalesce(sum(delta) FILTER (WHERE stream = 'person'), 0))::BIGINT AS current_persons FROM k GROUP BY device_id")
def reset(spark, sf):
    rows = tables.valid(spark, sf)
    return counters.reset_current(rows, rows.where("event_id % 500 = 0"))


@query("win02_trailing_flow", f"WITH {INGEST} SELECT event_id, least(4096, count(*) OVER (PARTITION BY device_id, event_type ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))::BIGINT AS flow FROM val")
def win02(spark, sf):
    return flow.trailing(tables.valid(spark, sf), ["device_id", "event_type"], 3600).select("event_id", "flow")


@query("win03_directional_flow", f"WITH {INGEST} SELECT event_id, device_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') OVER w * 60.0::DOUBLE / 3600 AS {n}" for n, t in (("v_in", "VehicleEnter"), ("v_out", "VehicleExit"), ("p_in", "PersonEnter"), ("p_out", "PersonExit"))) + " FROM val WINDOW w AS (PARTITION BY device_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)")
def win03(spark, sf):
    return flow.directional(tables.valid(spark, sf), 3600)


@query("str17_flow_at_reports", f"WITH {INGEST}, r AS (SELECT event_id AS report_id, device_id, us FROM val WHERE event_id % 4 = 0) SELECT report_id, r.device_id, count(v.event_id)::BIGINT AS flow FROM r LEFT JOIN val v ON v.device_id = r.device_id AND v.us BETWEEN r.us - 3600000000 AND r.us GROUP BY ALL")
def str17(spark, sf):
    rows = tables.valid(spark, sf)
    return flow.at_reports(rows, rows.where("event_id % 4 = 0").select("device_id", "us", F.col("event_id").alias("report_id")), 3600)
