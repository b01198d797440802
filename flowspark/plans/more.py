"""Further queries: functions, fallbacks, last-known positions, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions import arrays, text
from flowspark.operators import alerts, congestion, counters, delivery, enrich, events, liveness
from flowspark.plans.base import DEVICES, HOURS, INGEST, OBS, REGIONS, REPORTS, digest_number, query
from flowspark.plans.dims import PASSENGERS, SERIES, TARGETS
from flowspark.plans.motion import _SUPPRESSED
from flowspark.sources import sinks, tables


@query("src03_snapshot_scan", f"WITH {INGEST}, m AS (SELECT max(event_id) - 100 AS top FROM ing) SELECT event_id, device_id FROM ing, m WHERE event_id <= top")
def src03(spark, sf):
    rows = tables.ingest(spark, sf)
    top = rows.agg((F.max("event_id") - 100).alias("top"))
    return rows.join(F.broadcast(top)).where("event_id <= top").select("event_id", "device_id")


@query("src06_permissive_json", "SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN json_extract(props, '$.k')::INT END AS k, event_id % 6 = 0 AS corrupt FROM events")
def src06(spark, sf):
    raw = F.when(F.col("event_id") % 6 == 0, "{broken").otherwise(F.col("props"))
    parsed = F.from_json(raw, "k int, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return tables.table(spark, sf, "events").select("event_id", parsed.alias("p")).select("event_id", "p.k", F.col("p.corrupt").isNotNull().alias("corrupt"))


@query("join03_registry_fallback", f"WITH {DEVICES} SELECT 'empty' AS registry, device_key, name FROM dev UNION ALL SELECT 'filled', device_key, name FROM dev WHERE device_key % 3 = 0")
def join03(spark, sf):
    dev = tables.devices(spark, sf).select("device_key", "name")
    out = [enrich.or_else(dev.where(c), dev).select(F.lit(name).alias("registry"), "device_key", "name") for name, c in (("empty", "device_key < 0"), ("filled", "device_key % 3 = 0"))]
    return out[0].union(out[1])


@query("join11_contained_or_key", f"WITH {DEVICES}, n AS (SELECT DISTINCT nation AS short FROM dev WHERE length(nation) >= 3 AND nation <> 'NATION_3') SELECT device_key, coalesce(arg_max(short, length(short)), 'key-' || any_value(region)) AS card FROM dev LEFT JOIN n ON contains(name, short) GROUP BY device_key")
def join11(spark, sf):
    dev = tables.devices(spark, sf)
    names = dev.select(F.col("nation").alias("short")).where("nation != 'NATION_3'").distinct()
    return enrich.longest_contained(dev, names, least=3).select("device_key", F.coalesce("short", F.concat(F.lit("key-"), "region")).alias("card"))


@query("str01_tumbling_windows", f"WITH {INGEST} SELECT strftime(time_bucket(INTERVAL 15 MINUTE, occurred_at), '%Y-%m-%d %H:%M') AS bucket, count(*) AS n FROM val GROUP BY ALL")
def str01(spark, sf):
    return tables.valid(spark, sf).groupBy(F.window(F.col("occurred_at"), "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("bucket"), "n")


@query("str08_prediction_dedup", f"WITH RECURSIVE {REPORTS}, hit AS (SELECT 'all' AS device_id, 'predict' AS rule_id, us, report_id FROM rep WHERE roi_persons >= 50), {_SUPPRESSED.format(s=90000)} SELECT rule_id, report_id FROM f WHERE fired")
def str08(spark, sf):
    rows = tables.reports(spark, sf).where("roi_persons >= 50").select(F.lit("predict").alias("rule_id"), "us", "report_id")
    return alerts.suppressed(rows, ["rule_id"], 90000).select("rule_id", "report_id")


@query("str18_last_positions", f"WITH {INGEST}, m AS (SELECT max(us) AS now FROM ing), l AS (SELECT device_id, max(us) AS us, max(event_id) AS event_id FROM ing GROUP BY device_id) SELECT device_id, now - us < 1800000000 AS online FROM l, m WHERE now - us <= 7200000000")
def str18(spark, sf):
    rows = tables.ingest(spark, sf).select("device_id", "us", "event_id")
    now = rows.agg(F.max("us")).scalar()
    return congestion.latest(rows, "device_id", ["us", "event_id"], now, 7200).select("device_id", (F.lit(now) - F.col("us") < 1_800_000_000).alias("online"))


@query("str19_window_stats", f"WITH {REPORTS} SELECT device_id, us // 30000000 AS slot, count(*) AS frames, round(avg(v_flow), 6) AS mean_flow, max(roi_persons) AS most FROM rep GROUP BY ALL")
def str19(spark, sf):
    return tables.reports(spark, sf).groupBy("device_id", F.floor(F.col("us") / 30_000_000).alias("slot")).agg(F.count("*").alias("frames"), F.round(F.avg("v_flow"), 6).alias("mean_flow"), F.max("roi_persons").alias("most"))


@query("sort02_recent_alerts", f"WITH {REPORTS} SELECT report_id, device_id FROM rep WHERE roi_vehicles >= 22 ORDER BY us DESC, report_id DESC LIMIT 100")
def sort02(spark, sf):
    rows = tables.reports(spark, sf).where("roi_vehicles >= 22")
    return rows.orderBy(F.desc("us"), F.desc("report_id")).limit(100).select("report_id", "device_id")


@query("sort04_ordered_hours", f"WITH {HOURS} SELECT device_id, stat_date, hour FROM hrs ORDER BY stat_date, hour, device_id")
def sort04(spark, sf):
    return counters.hourly(tables.valid(spark, sf)).orderBy("stat_date", "hour", "device_id").select("device_id", "stat_date", "hour")


@query("sort05_regions_by_demand", f"WITH {DEVICES}, c AS (SELECT region, count(*) AS crowd FROM dev GROUP BY region) SELECT region, row_number() OVER (ORDER BY crowd DESC, region)::INT AS place FROM c")
def sort05(spark, sf):
    from pyspark.sql import Window

    crowd = tables.devices(spark, sf).groupBy("region").agg(F.count("*").alias("crowd"))
    return crowd.select("region", F.row_number().over(Window.orderBy(F.desc("crowd"), "region")).alias("place"))


@query("sort01_newest_rows", f"WITH {INGEST} SELECT event_id FROM ing ORDER BY event_id DESC LIMIT 20")
def newest(spark, sf):
    return sinks.newest(tables.ingest(spark, sf), "event_id", 20).select("event_id")


@query("snk11_dimension_upsert", f"WITH {DEVICES} SELECT device_key, CASE WHEN device_key % 10 = 0 THEN 'moved' ELSE region END AS region, nation FROM dev UNION ALL SELECT -1, 'new', NULL")
def snk11(spark, sf):
    dim = tables.devices(spark, sf).select("device_key", "region", "nation")
    changes = dim.where("device_key % 10 = 0").select("device_key", F.lit("moved").alias("region")).union(spark.createDataFrame([(-1, "new")], "device_key long, region string"))
    return sinks.upserted(dim, changes, "device_key")


@query("snk06_retention_filter", f"WITH {HOURS} SELECT device_id, stat_date, hour FROM hrs WHERE stat_date >= '2024-01-15'")
def snk06(spark, sf):
    return counters.hourly(tables.valid(spark, sf)).where("stat_date >= '2024-01-15'").select("device_id", "stat_date", "hour")


@query("dt06_crossing_time", f"WITH {OBS} SELECT track_id, n, round(1700000000 + t - 0.2 * (1 - x), 6) AS at FROM obs")
def dt06(spark, sf):
    return tables.observations(spark, sf).select("track_id", "n", F.round(1700000000 + F.col("t") - 0.2 * (1 - F.col("x")), 6).alias("at"))


@query("dt07_bad_times_skipped", "SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events WHERE event_id % 5 <> 0")
def dt07(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    from flowspark.functions.timing import micros

    t = F.try_to_timestamp(raw)
    return tables.table(spark, sf, "events").select("event_id", F.floor(micros(t) / 1_000_000).alias("s")).where("s is not null")


@query("dt08_epoch_to_iso", f"WITH {REPORTS} SELECT report_id, strftime(make_timestamp(us // 1000000 * 1000000) + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') AS iso FROM rep")
def dt08(spark, sf):
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 8, 0, us div 1000000)")
    return tables.reports(spark, sf).select("report_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+08:00'").alias("iso"))


@query("mth03_06_arithmetic", "SELECT event_id, ceil(value / 7)::BIGINT AS up, event_id // 7 AS part, event_id % 7 AS rest, greatest(0, least(100, round(value)))::BIGINT AS kept FROM events")
def mth03(spark, sf):
    n, v = F.col("event_id"), F.col("value")
    return tables.table(spark, sf, "events").select("event_id", F.ceil(v / 7).alias("up"), F.floor(n / 7).alias("part"), (n % 7).alias("rest"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(v))).cast("long").alias("kept"))


@query("mth02_half_even", "SELECT event_id, round_even(value / 7, 3) AS rounded FROM events")
def mth02(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", arrays.half_even(F.col("value") / 7, 3).alias("rounded"))


@query("agg16_offline_totals", f"WITH {REPORTS}, {INGEST} SELECT (SELECT count(*) FROM val WHERE event_type = 'VehicleEnter') AS vehicle_in, (SELECT count(*) FROM val WHERE event_type = 'PersonEnter') AS person_in, (SELECT count(*) FROM rep WHERE roi_vehicles >= 22) AS alarms")
def agg16(spark, sf):
    counts = tables.valid(spark, sf).agg(F.count_if(F.col("event_type") == "VehicleEnter").alias("vehicle_in"), F.count_if(F.col("event_type") == "PersonEnter").alias("person_in"))
    return counts.join(F.broadcast(tables.reports(spark, sf).agg(F.count_if(F.col("roi_vehicles") >= 22).alias("alarms"))))


@query("arr06_lane_ranges", f"WITH {DEVICES} SELECT device_key, '1-' || (2 + device_key % 3 // 2 * 0)::VARCHAR AS lanes_a, CASE WHEN device_key % 2 = 0 THEN '3-4' ELSE '3-5' END AS lanes_b FROM dev")
def arr06(spark, sf):
    none = F.array().cast("array<string>")
    some = F.array(F.lit("cam A"), F.lit(" cam A"), F.lit("cam B"), F.lit("cam B"))
    cams = F.when(F.col("device_key") % 2 == 0, some).otherwise(none)
    lanes = F.when(F.col("device_key") % 2 == 0, 4).otherwise(5)
    return tables.devices(spark, sf).select("device_key", arrays.lane_range(cams, "cam A", lanes).alias("lanes_a"), arrays.lane_range(cams, "cam B", lanes).alias("lanes_b"))


@query("arr05_slot_objects", f"WITH {DEVICES} SELECT device_key, unnest(['per0', 'vehA']) AS slot, unnest([name, region]) AS device, unnest(['per', 'veh']) AS kind FROM dev")
def arr05(spark, sf):
    slots = F.from_json(F.to_json(F.create_map(F.lit("per0"), "name", F.lit("vehA"), "region")), "map<string,string>")
    rows = tables.devices(spark, sf).select("device_key", F.explode(F.map_entries(slots)).alias("e"))
    return rows.select("device_key", F.col("e.key").alias("slot"), F.col("e.value").alias("device"), F.when(F.startswith("e.key", F.lit("per")), "per").otherwise("veh").alias("kind"))


@query("arr07_forecast_series", f"WITH {OBS} SELECT track_id, least(5, count(*))::INT + 1 AS points, 1.5::DOUBLE AS last FROM obs GROUP BY track_id")
def arr07(spark, sf):
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("track_id").orderBy("n"))
    rows = tables.observations(spark, sf).withColumn("r", first).where("r <= 5").groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]).alias("h"))
    past, ahead = arrays.with_forecast(F.col("h"), F.lit(1.5))
    return rows.select("track_id", F.size(past).alias("points"), F.element_at(ahead, -1).alias("last"))


@query("jsn03_sorted_json", """SELECT event_id, '{"event_id":' || event_id::VARCHAR || ',"event_type":"' || event_type || '","user_id":' || user_id::VARCHAR || '}' AS json FROM events""")
def jsn03(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", arrays.sorted_json("user_id", "event_type", "event_id").alias("json"))


@query("strf1_2_normalized", f"WITH {DEVICES} SELECT device_key, replace(name, ' ', '') AS key, trim(' ' || name || ' ') AS trimmed FROM dev")
def strf1(spark, sf):
    return tables.devices(spark, sf).select("device_key", text.normalized(F.col("name")).alias("key"), F.trim(F.concat(F.lit(" "), "name", F.lit(" "))).alias("trimmed"))


@query("strf8_play_urls", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://hls/' || page_id::VARCHAR || '/live/index.m3u8' ELSE url END AS play FROM pages")
def strf8(spark, sf):
    raw = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("rtsp://10.0.0.1:554/"), F.col("page_id").cast("string"), F.lit("/live"))).otherwise(F.col("url"))
    return tables.table(spark, sf, "pages").select("page_id", text.play_url(raw, "http://hls").alias("play"))


@query("strf9_messages", f"WITH {REPORTS} SELECT report_id, device_id || ': ' || roi_vehicles::VARCHAR || ' of 20' AS message FROM rep")
def strf9(spark, sf):
    return tables.reports(spark, sf).select("report_id", alerts.message("{device}: {value} of {most}", device=F.col("device_id"), value=F.col("roi_vehicles"), most=F.lit(20)).alias("message"))


@query("strf14_directions", f"WITH {DEVICES}, c AS (SELECT device_key, ['x入口', 'y出口', 'z', '入口出口'][device_key % 4 + 1] AS n FROM dev) SELECT device_key, CASE WHEN contains(n, '入口') THEN '入口' WHEN contains(n, '出口') THEN '出口' ELSE '其他' END AS direction FROM c")
def strf14(spark, sf):
    names = F.array(*[F.lit(n) for n in ("x入口", "y出口", "z", "入口出口")])
    return tables.devices(spark, sf).select("device_key", text.direction(F.get(names, (F.col("device_key") % 4).cast("int"))).alias("direction"))


@query("strf15_keyword_search", f"WITH {DEVICES} SELECT device_key FROM dev WHERE contains(lower(name || ' ' || category || ' ' || region), 'walkway asia')")
def strf15(spark, sf):
    return tables.devices(spark, sf).where(text.search("Walkway Asia", "name", "category", "region")).select("device_key")


@query("dst02_unique_urls", "SELECT count(DISTINCT sha256(regexp_replace(url, '[?#].*$', ''))) AS urls FROM pages")
def dst02(spark, sf):
    return tables.table(spark, sf, "pages").agg(F.count_distinct(F.sha2(F.regexp_replace("url", r"[?#].*$", ""), 256)).alias("urls"))


@query("set02_devices_and_aliases", f"WITH {DEVICES} SELECT replace(name, ' ', '') AS id FROM dev WHERE region = 'ASIA' UNION SELECT nation || 'gate' || device_key::VARCHAR FROM dev WHERE device_key % 3 = 0 AND region = 'ASIA'")
def set02(spark, sf):
    dev = tables.devices(spark, sf).where("region = 'ASIA'")
    aliases = dev.where("device_key % 3 = 0").select(F.concat("nation", F.lit("gate"), F.col("device_key").cast("string")))
    return dev.select(text.normalized(F.col("name")).alias("id")).union(aliases).distinct()


@query("set04_newly_alarming", f"WITH {REPORTS}, b AS (SELECT DISTINCT device_id, us // 86400000000 AS d FROM rep WHERE roi_vehicles >= 24) SELECT device_id, d FROM b EXCEPT SELECT device_id, d + 1 FROM b")
def set04(spark, sf):
    bad = tables.reports(spark, sf).where("roi_vehicles >= 24").select("device_id", F.floor(F.col("us") / 86_400_000_000).alias("d")).distinct()
    return bad.subtract(bad.select("device_id", (F.col("d") + 1).alias("d")))


@query("str11_offline_alerts", f"WITH {INGEST}, m AS (SELECT max(us) AS now FROM val), d AS (SELECT device_id, max(us) AS last_us FROM val GROUP BY device_id) SELECT device_id, 'device ' || device_id || ' offline' AS message FROM d, m WHERE now - last_us > 3600000000")
def str11(spark, sf):
    rows = tables.valid(spark, sf)
    now = rows.agg(F.max("us")).scalar()
    last = rows.groupBy("device_id").agg(F.max("us").alias("last_us")).withColumn("status", F.lit("online"))
    gone = liveness.heartbeat_status(last, now, 3600).where("alert")
    return gone.select("device_id", alerts.message("device {id} offline", id=F.col("device_id")).alias("message"))


@query("flt12_device_type", f"WITH {REGIONS}, {DEVICES} SELECT device_key FROM dev WHERE category IN ('walkway', 'checkpoint')")
def flt12(spark, sf):
    return tables.devices(spark, sf).where(F.col("category").isin("walkway", "checkpoint")).select("device_key")


_EPISODES = f"sl AS (SELECT i % 32 AS d, i // 32 AS p FROM range(0, 32 * 240) t(i)), st AS (SELECT d, p FROM sl WHERE {digest_number('d', 'p', '11')} / 4503599627370496.0::DOUBLE < (1 + (p % 24 % 12) / 4.0::DOUBLE) * 0.02::DOUBLE), sp AS (SELECT DISTINCT d, unnest(range(p, p + 2 + {digest_number('p', 'd')} % 4)) AS p FROM st)"


@query("src16_synthetic_episodes", f"WITH {_EPISODES} SELECT 'cam-' || sl.d::VARCHAR AS device_id, sl.p AS period, sp.d IS NOT NULL AS congested FROM sl LEFT JOIN sp ON sl.d = sp.d AND sl.p = sp.p")
def src16(spark, sf):
    return tables.synthetic_episodes(spark, 32, 240, [1 + (h % 12) / 4 for h in range(24)])


@query("join05_outbox_journal", f"WITH {INGEST}, o AS (SELECT event_id, event_id % 4 AS attempts FROM ing WHERE event_id % 6 = 0), j AS (SELECT event_id, device_id FROM ing WHERE event_id % 4 <> 2) SELECT event_id, device_id, attempts FROM o JOIN j USING (event_id)")
def join05(spark, sf):
    rows = tables.ingest(spark, sf)
    outbox = rows.where("event_id % 6 = 0").select("event_id", (F.col("event_id") % 4).alias("attempts"))
    return outbox.join(rows.where("event_id % 4 != 2").select("event_id", "device_id"), "event_id").select("event_id", "device_id", "attempts")


@query("sort03_latest_gaps", f"WITH {INGEST}, g AS (SELECT device_id, us, us - lag(us) OVER (PARTITION BY device_id ORDER BY us) AS gap FROM val) SELECT device_id, us::BIGINT AS us FROM g WHERE gap > 3600000000 ORDER BY us DESC, device_id LIMIT 25")
def sort03(spark, sf):
    gaps = liveness.timeouts(tables.valid(spark, sf), 3600, 0).where("recovered_us is not null")
    return gaps.select("device_id", F.col("recovered_us").alias("us")).orderBy(F.desc("us"), "device_id").limit(25)


@query("sort07_one_officer_each", f"WITH {DEVICES}, {REGIONS}, c AS (SELECT region, count(*) AS crowd FROM dev GROUP BY region), p AS (SELECT region, row_number() OVER (ORDER BY crowd DESC, ordinal) AS place FROM c JOIN reg USING (region)) SELECT region, (place <= 3)::INT AS target FROM p")
def sort07(spark, sf):
    from flowspark.operators import allocate

    crowd = tables.devices(spark, sf).groupBy("region").agg(F.count("*").cast("double").alias("demand"))
    return allocate.targets(tables.regions(spark, sf).join(crowd, "region").select("ordinal", "region", "demand"), 3).select("region", "target")


@query("sort09_least_loaded", f"WITH {DEVICES} SELECT region, arg_min(device_key, load * 1000000 + device_key) AS device_key FROM dev GROUP BY region")
def sort09(spark, sf):
    return tables.devices(spark, sf).groupBy("region").agg(F.min_by("device_key", F.struct("load", "device_key")).alias("device_key"))


@query("geo01_pixels", f"WITH {OBS} SELECT track_id, n, round(x * 1280, 6) AS px, round(y * 720, 6) AS py FROM obs")
def geo01(spark, sf):
    return tables.observations(spark, sf).select("track_id", "n", F.round(F.col("x") * 1280, 6).alias("px"), F.round(F.col("y") * 720, 6).alias("py"))


@query("geo14_endpoint_stagnation", f"WITH {OBS}, d AS (SELECT track_id, n, sqrt(pow(x - 0.1, 2) + pow(y - 0.5, 2)) AS a, sqrt(pow(x - 0.9, 2) + pow(y - 0.5, 2)) AS b FROM obs) SELECT track_id, n, NOT coalesce((round(a, 9) < 0.3 AND lag(round(a, 9)) OVER w < 0.3) OR (round(b, 9) < 0.3 AND lag(round(b, 9)) OVER w < 0.3), false) AS passes FROM d WINDOW w AS (PARTITION BY track_id ORDER BY n)")
def geo14(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("track_id").orderBy("n")
    near = lambda x: F.round(F.hypot(F.col("x") - x, F.col("y") - 0.5), 9) < 0.3
    stuck = (near(0.1) & F.lag(near(0.1)).over(w)) | (near(0.9) & F.lag(near(0.9)).over(w))
    return tables.observations(spark, sf).select("track_id", "n", (~F.coalesce(stuck, F.lit(False))).alias("passes"))


@query("mdl02_vehicle_passengers", f"WITH {INGEST}, {SERIES}, {PASSENGERS} SELECT i::INT AS slot, persons FROM pas")
def mdl02(spark, sf):
    from flowspark.operators import forecast

    rows = tables.valid(spark, sf)
    one = forecast.series(rows, rows.agg(F.max("us")).scalar(), kind="Vehicle")
    return one.select(F.posexplode(forecast.converted(F.col("history"))).alias("slot", "persons"))


@query("mdl10_next_officers", f"WITH {TARGETS} SELECT region, target AS officers FROM tar")
def mdl10(spark, sf):
    from flowspark.operators import allocate

    crowd = tables.devices(spark, sf).groupBy("region").agg(F.count("*").alias("crowd"))
    plan = allocate.targets(allocate.demand(tables.regions(spark, sf).join(crowd, "region"), 120.0).select("ordinal", "region", "officers", "demand"), 35)
    return allocate.next_round(plan).select("region", "officers")


@query("str05_rearchived_hours", f"""WITH {HOURS}, m AS (SELECT max(us) // 3600000000 AS h FROM val),
late AS (SELECT device_id, stat_date, hour, count(*) AS version FROM val, m WHERE us // 3600000000 < h - 24 AND us // 3600000000 >= h - 240 GROUP BY ALL),
done AS (SELECT device_id, stat_date, hour, version - (hour % 2) AS version FROM late WHERE hour % 3 > 0)
SELECT device_id, stat_date, hour, late.version, vehicle_in, vehicle_out, person_in, person_out FROM late JOIN hrs USING (device_id, stat_date, hour)
WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.device_id = late.device_id AND done.stat_date = late.stat_date AND done.hour = late.hour AND done.version = late.version)""")
def str05(spark, sf):
    """Late hours archived again: two hours of three are acknowledged, the odd ones of those in a version before."""
    rows = tables.valid(spark, sf)
    now = rows.agg(F.floor(F.max("us") / 3_600_000_000).alias("h"))
    late = events.split_late(rows.join(F.broadcast(now)), F.floor(F.col("us") / 3_600_000_000), F.col("h") - 24, F.col("h") - 240).where("route = 'late'")
    marks = counters.late_marks(late)
    done = marks.where("hour % 3 > 0").withColumn("version", F.expr("version - hour % 2"))
    return counters.archived_again(rows, counters.unacknowledged(marks, done))


@query("snk02_due_heads", f"""WITH {INGEST}, tried AS (SELECT event_id, device_id, us, event_id % 4 AS attempts, us + (event_id % 4) * 1000000 AS last_us FROM ing WHERE event_id % 7 > 0),
p AS (SELECT *, CASE WHEN attempts > 0 THEN last_us + least(60, pow(2, least(attempts, 6)))::BIGINT * 1000000 ELSE 0 END AS due_us, row_number() OVER (PARTITION BY device_id ORDER BY event_id) AS r FROM tried),
m AS (SELECT median(us) AS now FROM ing) SELECT device_id, event_id, attempts, due_us FROM p, m WHERE r = 1 AND due_us <= now""")
def snk02(spark, sf):
    """Heads of the devices' queues that are due; attempts follow from the id, and every seventh event has arrived."""
    rows = tables.ingest(spark, sf).select("event_id", "device_id", "us")
    n, arrived = F.col("event_id") % 4, F.col("event_id") % 7 == 0
    tries = F.transform(F.sequence(F.lit(1), F.greatest(n, arrived.cast("long"), F.lit(1))), lambda k: F.col("us") + k * 1_000_000)
    log = rows.where((n > 0) | arrived).select("event_id", F.explode(tries).alias("at_us"), arrived.alias("ok"))
    now = rows.agg(F.expr("percentile(us, 0.5)").alias("now"))
    heads = delivery.due_heads(rows.join(F.broadcast(now)), log, F.col("now"))
    return heads.select("device_id", "event_id", "attempts", "due_us")


@query("str14_frame_anomalies")
def str14(spark, sf):
    """Frames made of the reports: dark, noisy or plain by their counts."""
    from flowspark.operators import frames

    r = tables.reports(spark, sf)
    size = 32 * 24 * 3
    noise = F.unhex(F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size // 32)), lambda i: F.sha2(F.concat_ws("-", "report_id", i), 256)), ""), 1, 2 * size))
    plain = F.unhex(F.repeat(F.lit("7f7f7f"), size // 3))
    dark = F.unhex(F.repeat(F.lit("000000"), size // 3))
    pixels = F.when(F.col("roi_vehicles") < 6, dark).when(F.col("roi_vehicles") < 12, noise).otherwise(plain)
    return frames.anomalies(r.select("device_id", F.col("report_id").alias("n"), F.lit(32).alias("width"), F.lit(24).alias("height"), pixels.alias("pixels"))).groupBy("anomaly").agg(F.count("*").alias("n"))


@query("src05_prefix_scan", f"WITH {INGEST} SELECT event_id, device_id FROM ing WHERE device_id LIKE 'cam-1%'")
def src05(spark, sf):
    return tables.by_prefix(tables.ingest(spark, sf), "device_id", "cam-1").select("event_id", "device_id")


@query("map03_index_by_name_and_id", f"WITH {DEVICES}, k AS (SELECT device_key AS asked, CASE device_key % 3 WHEN 0 THEN name WHEN 1 THEN device_key::VARCHAR ELSE 'none-' || device_key::VARCHAR END AS key FROM dev) SELECT asked, device_key, category FROM k LEFT JOIN dev ON key = name OR key = device_key::VARCHAR")
def map03(spark, sf):
    dev = tables.devices(spark, sf).select("device_key", "name", "category")
    n = F.col("device_key")
    asked = dev.select(n.alias("asked"), F.when(n % 3 == 0, F.col("name")).when(n % 3 == 1, n.cast("string")).otherwise(F.concat(F.lit("none-"), n.cast("string"))).alias("key"))
    return enrich.by_name_or_id(asked, dev, identity="device_key").select("asked", "device_key", "category")


@query("jsn04_tolerant_style", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN (json_extract(props, '$.k'))::VARCHAR END AS k, event_id % 5 = 0 AS parsed FROM events""")
def jsn04(spark, sf):
    n = F.col("event_id") % 5
    raw = F.when(n == 0, F.col("props")).when(n == 1, "{broken").when(n == 2, "").when(n == 3, "[1, 2]")
    style = arrays.tolerant_style(raw)
    return tables.table(spark, sf, "events").select("event_id", style.alias("s")).select("event_id", F.element_at("s", "k").alias("k"), F.col("s").isNotNull().alias("parsed"))


@query("enr01_02_device_lookups", f"WITH {DEVICES}, {INGEST}, a AS (SELECT DISTINCT device_id, substr(device_id, 5)::BIGINT + 1 AS device_key FROM ing), n AS (SELECT a.device_id, replace(name, ' ', '') AS point FROM a JOIN dev USING (device_key)) SELECT device_id, category, longitude, latitude, coalesce(region, 'unknown') AS region FROM n LEFT JOIN (SELECT *, CASE WHEN device_key % 4 <> 0 THEN replace(name, ' ', '') END AS k FROM dev) d ON point = k")
def enr01_02(spark, sf):
    """Category, place and region of each device that sent events, by its point's name without spaces."""
    dev = tables.devices(spark, sf)
    seen = tables.ingest(spark, sf).select("device_id").distinct().withColumn("device_key", F.substring("device_id", 5, 20).cast("long") + 1)
    points = seen.join(enrich.small(dev.select("device_key", F.regexp_replace("name", " ", "").alias("name"))), "device_key").drop("device_key")
    known = dev.where("device_key % 4 != 0").select("name", "category", "longitude", "latitude", "region")
    return enrich.by_name(points, known).select("device_id", "category", "longitude", "latitude", F.coalesce("region", F.lit("unknown")).alias("region"))
