"""Queries on dimensions: enrichment, names, dashboards, forecast, allocation, reconciliation, log audit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.functions import arrays, text
from flowspark.functions.geometry import rounded
from flowspark.functions.timing import micros
from flowspark.operators import allocate, audit, enrich, forecast, reconcile
from flowspark.plans.base import DEVICES, INGEST, OBS, REGIONS, digest_number, query
from flowspark.sources import tables

_NORM = "replace(name, ' ', '')"


@query("join01_by_normalized_name", f"WITH {DEVICES}, p AS (SELECT device_key AS point_key, nation || ' gate' || (device_key - device_key % 2)::VARCHAR AS name FROM dev) SELECT point_key, device_key, category FROM p LEFT JOIN (SELECT {_NORM} AS k, device_key, category FROM dev) d ON {_NORM} = k")
def join01(spark, sf):
    dev = tables.devices(spark, sf)
    points = dev.select(F.col("device_key").alias("point_key"), F.concat("nation", F.lit(" gate"), (F.col("device_key") - F.col("device_key") % 2).cast("string")).alias("name"))
    return enrich.by_name(points, dev.select("name", "device_key", "category")).select("point_key", "device_key", "category")


@query("join02_device_stats", f"WITH {INGEST}, k AS (SELECT 'cam-' || i::VARCHAR AS device_id FROM range(0, 40) t(i)), c AS (SELECT device_id, count(*) AS n FROM val GROUP BY ALL), l AS (SELECT device_id, max(event_id) AS last_id FROM val GROUP BY ALL) SELECT device_id, coalesce(n, 0) AS n, last_id FROM k LEFT JOIN c USING (device_id) LEFT JOIN l USING (device_id)")
def join02(spark, sf):
    rows = tables.valid(spark, sf)
    known = spark.range(40).select(F.concat(F.lit("cam-"), F.col("id").cast("string")).alias("device_id"))
    counts = rows.groupBy("device_id").agg(F.count("*").alias("n"))
    last = rows.groupBy("device_id").agg(F.max("event_id").alias("last_id"))
    return enrich.with_counters(known, counts, last)


@query("join09_nearest_region", f"WITH {DEVICES}, {REGIONS} SELECT device_key, arg_min(reg.region, pow(longitude - center_x, 2) + pow(latitude - center_y, 2) + ordinal * 1e-9) AS nearest FROM dev, reg GROUP BY device_key")
def join09(spark, sf):
    return enrich.nearest(tables.devices(spark, sf), tables.regions(spark, sf)).select("device_key", "nearest")


@query("join10_longest_contained", f"WITH {DEVICES}, n AS (SELECT DISTINCT nation AS short FROM dev UNION SELECT 'NATION_' UNION SELECT 'gate') SELECT device_key, arg_max(short, length(short)) AS short FROM dev LEFT JOIN n ON contains(name, short) GROUP BY device_key")
def join10(spark, sf):
    dev = tables.devices(spark, sf)
    names = dev.select(F.col("nation").alias("short")).union(spark.createDataFrame([("NATION_",), ("gate",)], "short string")).distinct()
    return enrich.longest_contained(dev, names).select("device_key", "short")


_SHORT = f"{DEVICES}, s AS (SELECT device_key, CASE WHEN device_key % 3 = 0 THEN {_NORM} ELSE left({_NORM}, length({_NORM}) - 1) END AS key FROM dev), f AS (SELECT {_NORM} AS full_name FROM dev)"


@query("join12_unique_prefix", f"WITH {_SHORT} SELECT device_key, CASE WHEN bool_or(full_name = key) THEN any_value(key) WHEN count(full_name) = 1 THEN min(full_name) END AS full_name FROM s LEFT JOIN f ON starts_with(full_name, key) GROUP BY device_key")
def join12(spark, sf):
    dev = tables.devices(spark, sf).withColumn("full_name", text.normalized(F.col("name")))
    short = dev.select("device_key", F.when(F.col("device_key") % 3 == 0, F.col("full_name")).otherwise(F.expr("left(full_name, length(full_name) - 1)")).alias("key"))
    return enrich.unique_prefix(short, dev.select("full_name"), "key", "full_name").select("device_key", "full_name")


@query("join13_longest_prefix", f"WITH {DEVICES}, l AS (SELECT device_key, {_NORM} || '-tail' AS key FROM dev), a AS (SELECT {_NORM} AS alias FROM dev WHERE device_key % 2 = 0 UNION ALL SELECT nation || ' ' FROM dev WHERE device_key % 10 = 1), m AS (SELECT l.device_key, a.alias, length(replace(alias, ' ', '')) AS n, max(length(replace(alias, ' ', ''))) OVER (PARTITION BY l.device_key) AS best FROM l JOIN a ON starts_with(key, replace(alias, ' ', ''))) SELECT l.device_key, CASE WHEN count(alias) = 1 THEN min(alias) END AS alias FROM l LEFT JOIN (SELECT * FROM m WHERE n = best) b USING (device_key) GROUP BY l.device_key")
def join13(spark, sf):
    dev = tables.devices(spark, sf)
    names = dev.select("device_key", F.concat(text.normalized(F.col("name")), F.lit("-tail")).alias("key"))
    aliases = dev.where("device_key % 2 = 0").select(text.normalized(F.col("name")).alias("alias")).union(dev.where("device_key % 10 = 1").select(F.concat("nation", F.lit(" "))))
    return enrich.longest_prefix(names, aliases).select("device_key", "alias")


@query("join14_surplus_deficit", f"WITH {REGIONS}, t AS (SELECT *, officers - 7 AS spare FROM reg) SELECT a.region AS from_region, b.region AS to_region, least(a.spare, -b.spare) AS most, round(sqrt(pow(a.center_x - b.center_x, 2) + pow(a.center_y - b.center_y, 2)), 6) AS distance FROM t a, t b WHERE a.spare > 0 AND b.spare < 0")
def join14(spark, sf):
    t = tables.regions(spark, sf).withColumn("spare", F.col("officers") - 7)
    a, b = t.where("spare > 0").alias("a"), t.where("spare < 0").alias("b")
    return a.join(enrich.small(b)).select(F.col("a.region").alias("from_region"), F.col("b.region").alias("to_region"), F.least("a.spare", -F.col("b.spare")).alias("most"), F.round(F.hypot(F.col("a.center_x") - F.col("b.center_x"), F.col("a.center_y") - F.col("b.center_y")), 6).alias("distance"))


@query("join16_gate_cards", f"WITH {DEVICES}, c AS (SELECT 'NATION_' || i::VARCHAR AS gate FROM range(20, 30) t(i)), d AS (SELECT nation AS gate, count(*) AS devices FROM dev GROUP BY nation) SELECT coalesce(c.gate, d.gate) AS gate, c.gate IS NOT NULL AS configured, coalesce(devices, 0) AS devices FROM c FULL JOIN d ON c.gate = d.gate")
def join16(spark, sf):
    config = spark.range(20, 30).select(F.concat(F.lit("NATION_"), F.col("id").cast("string")).alias("gate"), F.lit(True).alias("configured"))
    groups = tables.devices(spark, sf).groupBy(F.col("nation").alias("gate")).agg(F.count("*").alias("devices"))
    return config.join(groups, "gate", "full_outer").select("gate", F.coalesce("configured", F.lit(False)).alias("configured"), F.coalesce("devices", F.lit(0)).cast("long").alias("devices"))


@query("join17_slot_devices", f"WITH {DEVICES}, s AS (SELECT device_key AS card, unnest([0, 1]) AS slot FROM dev WHERE device_key % 4 = 0), x AS (SELECT card, slot, CASE WHEN slot = 0 THEN card + 1 WHEN card % 8 = 0 THEN 100000000 END AS wanted, card + 2 AS inferred FROM s) SELECT card, slot, coalesce(d.device_key, inferred) AS device_key FROM x LEFT JOIN dev d ON wanted = d.device_key")
def join17(spark, sf):
    dev = tables.devices(spark, sf).select("device_key")
    c = F.col("device_key")
    wanted = F.array(c + 1, F.when(c % 8 == 0, F.lit(100000000).cast("long")))
    slots = dev.where("device_key % 4 = 0").select(c.alias("card"), F.posexplode(wanted).alias("slot", "wanted"))
    found = slots.join(enrich.small(dev), F.col("wanted") == F.col("device_key"), "left")
    return found.select("card", "slot", F.coalesce("device_key", F.col("card") + 2).alias("device_key"))


@query(
    "join19_track_stitching",
    f"""WITH {OBS}, l AS (SELECT device_id, class_name, track_id, max(n) AS m FROM obs GROUP BY ALL), e AS (SELECT o.device_id, o.class_name, o.track_id AS old_id, o.n * 0.01::DOUBLE AS t0, o.x AS x0, o.y AS y0, 0.3::DOUBLE AS vx, 0.1::DOUBLE AS vy FROM obs o WHERE o.n % 20 = 0),
s AS (SELECT device_id, class_name, track_id AS new_id, n * 0.01::DOUBLE AS t, x, y FROM obs WHERE n % 20 = 7),
j AS (SELECT e.device_id, old_id, new_id, t0, t, x0, y0, s.x, s.y, sqrt(pow(x0 + vx * (t - t0) - s.x, 2) + pow(y0 + vy * (t - t0) - s.y, 2)) AS error, sqrt(pow(s.x - x0, 2) + pow(s.y - y0, 2)) * sqrt(vx * vx + vy * vy) AS len, (s.x - x0) * vx + (s.y - y0) * vy AS dot FROM e JOIN s ON e.device_id = s.device_id AND e.class_name = s.class_name AND old_id <> new_id AND round(t - t0, 9) > 0 AND round(t - t0, 9) <= 0.48),
k AS (SELECT * FROM j WHERE error <= 0.2 AND len > 1e-12 AND dot / len >= 0.5),
a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY device_id, new_id ORDER BY error, old_id) = 1)
SELECT device_id, old_id, new_id, round(error, 6) AS error FROM a QUALIFY row_number() OVER (PARTITION BY device_id, old_id ORDER BY error, new_id) = 1""",
)
def join19(spark, sf):
    obs = tables.observations(spark, sf).withColumn("t", F.col("n") * 0.01)
    ends = obs.where("n % 20 = 0").withColumns({"vx": F.lit(0.3), "vy": F.lit(0.1)})
    starts = obs.where("n % 20 = 7").withColumn("diag", F.lit(0.1))
    return enrich.stitched(starts, ends).select("device_id", "old_id", "new_id", rounded("error", 6).alias("error"))


@query("enr03_gate_region", f"WITH {DEVICES}, g AS (SELECT nation AS gate, CASE WHEN count(DISTINCT CASE WHEN device_key % 6 = 0 THEN 'x' ELSE region END) = 1 THEN min(CASE WHEN device_key % 6 = 0 THEN 'x' ELSE region END) END AS r FROM dev GROUP BY nation) SELECT device_key, r AS gate_region FROM dev LEFT JOIN g ON nation = gate")
def enr03(spark, sf):
    dev = tables.devices(spark, sf)
    dim = dev.withColumn("region", F.when(F.col("device_key") % 6 == 0, "x").otherwise(F.col("region")))
    gate = F.regexp_extract("name", "NATION_[0-9]+(?=gate| gate)", 0)
    return enrich.gate_region(dev.select("device_key", "name"), dim, gate).select("device_key", "gate_region")


@query("flt06_name_search", f"WITH {DEVICES} SELECT device_key FROM dev WHERE contains(lower(name), 'gate1') AND region = 'ASIA'")
def flt06(spark, sf):
    return tables.devices(spark, sf).where(text.search("GATE1", "name") & (F.col("region") == "ASIA")).select("device_key")


@query("flt07_derived_region", f"WITH {DEVICES}, {REGIONS}, n AS (SELECT device_key, arg_min(reg.region, pow(longitude - center_x, 2) + pow(latitude - center_y, 2) + ordinal * 1e-9) AS nearest FROM dev, reg GROUP BY device_key) SELECT device_key FROM n WHERE nearest = 'ASIA'")
def flt07(spark, sf):
    return enrich.nearest(tables.devices(spark, sf), tables.regions(spark, sf)).where("nearest = 'ASIA'").select("device_key")


@query("flt09_offline_excluded", f"WITH {DEVICES} SELECT device_key FROM dev WHERE NOT (upper({_NORM}) LIKE 'NATION\\_1%' ESCAPE '\\' OR contains({_NORM}, '42'))")
def flt09(spark, sf):
    key = text.normalized(F.col("name"))
    return tables.devices(spark, sf).where(~(F.startswith(F.upper(key), F.lit("NATION_1")) | F.contains(key, F.lit("42")))).select("device_key")


@query("flt11_geo_valid", f"WITH {DEVICES} SELECT device_key FROM dev WHERE longitude <> 0 AND latitude <> 0 AND isfinite(longitude) AND isfinite(latitude)")
def flt11(spark, sf):
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) != 0)
    return tables.devices(spark, sf).where(ok("longitude") & ok("latitude")).select("device_key")


_KINDS = "CASE WHEN contains(category, 'both-way') THEN 'both-way' WHEN contains(category, 'entry') THEN 'entry' WHEN contains(category, 'exit') THEN 'exit' END"


@query("strf3_entrance_type", f"WITH {DEVICES} SELECT device_key, {_KINDS} AS entrance_type FROM dev")
def strf3(spark, sf):
    return tables.devices(spark, sf).select("device_key", text.entrance_type(F.col("category"), "both-way", "entry", "exit").alias("entrance_type"))


_CATEGORIES = "['广场出入口便道监控', '东门入口便道', '西门出口卡口', '车道', '人行', '其他', '北侧摄像头A', '南侧人流', '摄像头B'][device_key % 9 + 1]"


def _category():
    names = ("广场出入口便道监控", "东门入口便道", "西门出口卡口", "车道", "人行", "其他", "北侧摄像头A", "南侧人流", "摄像头B")
    return F.get(F.array(*[F.lit(c) for c in names]), (F.col("device_key") % 9).cast("int"))


@query("strf4_5_types", f"WITH {DEVICES}, c AS (SELECT device_key, {_CATEGORIES} AS c FROM dev) SELECT device_key, CASE WHEN contains(c, '出入口') THEN '出入口' WHEN contains(c, '入口') THEN '入口' WHEN contains(c, '出口') THEN '出口' END AS entrance, CASE WHEN contains(c, '便道') THEN '便道' WHEN contains(c, '卡口') THEN '车辆卡口' END AS point, CASE WHEN contains(c, '卡口') OR contains(c, '车') THEN 'vehicle' WHEN contains(c, '便道') OR contains(c, '人') THEN 'person' END AS camera, CASE WHEN contains(c, '入口') THEN '入口' WHEN contains(c, '出口') THEN '出口' ELSE '其他' END AS direction FROM c")
def strf45(spark, sf):
    c = F.col("c")
    return tables.devices(spark, sf).select("device_key", _category().alias("c")).select("device_key", text.entrance_type(c).alias("entrance"), text.point_type(c).alias("point"), text.camera_type(c).alias("camera"), text.direction(c).alias("direction"))


@query("strf13_slots", f"WITH {DEVICES}, c AS (SELECT device_key, {_CATEGORIES} AS c, CASE device_key % 4 WHEN 0 THEN 'vehicle' WHEN 1 THEN 'person' END AS cam FROM dev), s AS (SELECT *, CASE WHEN contains(c, '北侧') THEN '北' WHEN contains(c, '南侧') THEN '南' WHEN contains(c, '东侧') THEN '东' WHEN contains(c, '西侧') THEN '西' END AS side FROM c) SELECT device_key, CASE WHEN contains(c, '摄像头A') THEN 'vehA' WHEN contains(c, '摄像头B') THEN 'vehB' WHEN regexp_matches(c, '便道|人流') THEN CASE WHEN side IS NULL OR side = '北' THEN 'per0' ELSE 'per1' END WHEN cam = 'vehicle' OR (cam IS NULL AND regexp_matches(c, '摄像头|卡口|车道')) THEN CASE WHEN contains(c, '出口') THEN 'vehB' ELSE 'vehA' END WHEN side IS NULL OR side = '北' THEN 'per0' ELSE 'per1' END AS slot FROM s")
def strf13(spark, sf):
    k = F.col("device_key") % 4
    rows = tables.devices(spark, sf).select("device_key", _category().alias("c"), F.when(k == 0, "vehicle").when(k == 1, "person").alias("cam"))
    return rows.select("device_key", text.slot(F.lit(None).cast("string"), F.col("c"), F.col("cam"), F.lit("北")).alias("slot"))


@query("strf6_gate_key", f"WITH {DEVICES}, c AS (SELECT device_key, ['东湖 东门1口', 'AB-26长安南门出口路', '广武门', '无', 'ab平安北门x'][device_key % 5 + 1] AS name FROM dev) SELECT device_key, regexp_extract(replace(name, ' ', ''), '[一-龥]{{2}}(?:东|西|南|北|正|大)?门', 0) AS gate FROM c")
def strf6(spark, sf):
    names = F.array(*[F.lit(n) for n in ("东湖 东门1口", "AB-26长安南门出口路", "广武门", "无", "ab平安北门x")])
    return tables.devices(spark, sf).select("device_key", text.gate_key(F.get(names, (F.col("device_key") % 5).cast("int"))).alias("gate"))


@query("strf7_8_urls", "SELECT page_id, regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*', '\\1media.local:8080') AS swapped, sha256(url) AS url_sha256 FROM pages")
def strf7(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", text.swap_host(F.col("url"), "media.local:8080").alias("swapped"), F.sha2("url", 256).alias("url_sha256"))


@query("strf10_coordinates", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN round(value, 6) END AS x FROM events")
def strf10(spark, sf):
    n = F.col("event_id") % 4
    raw = F.concat_ws(",", F.col("value").cast("string"), F.when(n == 2, "b").otherwise("1.5"), F.when(n == 3, "2"))
    return tables.table(spark, sf, "events").select("event_id", F.round(F.get(text.coordinates(raw, 2), F.lit(0)), 6).alias("x"))


@query("jsn02_path_extract", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def jsn02(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("jsn01_skip_corrupt", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events WHERE event_id % 6 <> 0")
def jsn01(spark, sf):
    raw = F.when(F.col("event_id") % 6 == 0, "{broken").otherwise(F.col("props"))
    return tables.table(spark, sf, "events").select("event_id", arrays.tolerant_json(raw, "k int")["k"].alias("k")).where("k is not null")


@query("map01_merge_later_wins", "SELECT event_id, (event_id % 10)::BIGINT AS a, 2::BIGINT AS b, 3::BIGINT AS c FROM events")
def map01(spark, sf):
    base = F.create_map(F.lit("a"), F.col("event_id") % 10, F.lit("b"), F.lit(1).cast("long"))
    over = F.create_map(F.lit("b"), F.lit(2).cast("long"), F.lit("c"), F.lit(3).cast("long"))
    return tables.table(spark, sf, "events").select("event_id", arrays.merged_maps(base, over).alias("m")).select("event_id", *[F.element_at("m", k).alias(k) for k in "abc"])


@query("map02_counter_sums", "SELECT event_type AS reason, sum(event_id % 7)::BIGINT AS n FROM events GROUP BY event_type")
def map02(spark, sf):
    rows = tables.table(spark, sf, "events").select(F.create_map("event_type", F.col("event_id") % 7).alias("reject"))
    return audit.reject_totals(rows)


@query("arr01_03_series", f"WITH {INGEST}, h AS (SELECT device_id, stat_date, list(us // 1000000 % 10 ORDER BY us, event_id) AS a FROM val GROUP BY device_id, stat_date) SELECT device_id, stat_date, list_sum([x * 2 FOR x IN a])::BIGINT AS doubled, list_sum([a[i] FOR i IN range(1, len(a) + 1) IF (i - 1) % 3 = 0])::BIGINT AS third, a[-1]::BIGINT AS first_reversed FROM h")
def arr(spark, sf):
    v = (F.floor(F.col("us") / 1_000_000) % 10).alias("v")
    day = F.date_format("occurred_at", "yyyy-MM-dd").alias("stat_date")  # a series of a day each, however long the history
    rows = tables.valid(spark, sf).groupBy("device_id", day).agg(F.transform(F.sort_array(F.collect_list(F.struct("us", "event_id", v))), lambda s: s["v"]).alias("a"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.select("device_id", "stat_date", total(arrays.pairwise_sum(F.col("a"), F.col("a"))).alias("doubled"), total(arrays.every_third(F.col("a"))).alias("third"), F.get(F.reverse("a"), F.lit(0)).alias("first_reversed"))


@query("arr04_merged_intervals", f"WITH {OBS}, i AS (SELECT track_id, n, n * 1.0::DOUBLE AS a, n + CASE WHEN n % 4 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS b FROM obs), f AS (SELECT *, CASE WHEN a <= lag(b) OVER (PARTITION BY track_id ORDER BY n) + 1e-9 THEN 0 ELSE 1 END AS new FROM i) SELECT track_id, sum(new)::INT AS intervals FROM f GROUP BY track_id")
def arr04(spark, sf):
    n = F.col("n")
    rows = tables.observations(spark, sf).groupBy("track_id").agg(F.collect_list(F.struct((n * 1.0).alias("a"), (n + F.when(n % 4 == 0, 0.5).otherwise(1.0)).alias("b"))).alias("i"))
    return rows.select("track_id", F.size(arrays.merged_intervals(F.col("i"))).alias("intervals"))


@query("agg12_active_devices", f"WITH {DEVICES} SELECT count(*) FILTER (WHERE device_key % 4 IN (0, 1)) AS active FROM dev")
def agg12(spark, sf):
    k = F.col("device_key") % 4
    status = F.when(k == 0, "online").when(k == 1, "running").otherwise("offline")
    return tables.devices(spark, sf).agg(F.count_if(status.isin("online", "running")).alias("active"))


@query("agg13_region_metrics", f"WITH {DEVICES} SELECT region, count(*) AS devices, round(sum(load), 2) AS load FROM dev GROUP BY region")
def agg13(spark, sf):
    return tables.devices(spark, sf).groupBy("region").agg(F.count("*").alias("devices"), F.round(F.sum("load"), 2).alias("load"))


@query("agg21_worst_level", f"WITH {DEVICES}, l AS (SELECT nation, ['free', 'slow', 'congested', 'severe', 'abnormal'][device_key % 5 + 1] AS level, device_key % 5 AS r FROM dev) SELECT nation, arg_max(level, r) AS level FROM l GROUP BY nation")
def agg21(spark, sf):
    rank = (F.col("device_key") % 5).cast("int")
    levels = F.array(*[F.lit(x) for x in ("free", "slow", "congested", "severe", "abnormal")])
    return tables.devices(spark, sf).groupBy("nation").agg(F.max_by(F.get(levels, rank), rank).alias("level"))


@query("agg22_gate_centroid", f"WITH {DEVICES} SELECT nation, round(coalesce(avg(longitude) FILTER (WHERE category = 'checkpoint'), avg(longitude)), 6) AS lon, round(coalesce(avg(latitude) FILTER (WHERE category = 'checkpoint'), avg(latitude)), 6) AS lat FROM dev GROUP BY nation")
def agg22(spark, sf):
    veh = F.col("category") == "checkpoint"
    centre = lambda c: F.round(F.coalesce(F.avg(F.when(veh, F.col(c))), F.avg(c)), 6)
    return tables.devices(spark, sf).groupBy("nation").agg(centre("longitude").alias("lon"), centre("latitude").alias("lat"))


@query("agg25_group_count", f"WITH {DEVICES} SELECT {_KINDS} AS kind, count(*) AS n FROM dev GROUP BY kind")
def agg25(spark, sf):
    return tables.devices(spark, sf).groupBy(text.entrance_type(F.col("category"), "both-way", "entry", "exit").alias("kind")).agg(F.count("*").alias("n"))


@query("agg26_precision_recall", f"WITH {INGEST}, t AS (SELECT device_id, event_type, count(*) FILTER (WHERE event_id % 10 <> 0) AS truth, count(*) FILTER (WHERE event_id % 13 <> 0) AS counted FROM val GROUP BY ALL) SELECT round(sum(least(truth, counted)) / sum(counted), 9) AS precision, round(sum(least(truth, counted)) / sum(truth), 9) AS recall FROM t")
def agg26(spark, sf):
    t = tables.valid(spark, sf).groupBy("device_id", "event_type").agg(F.count_if(F.col("event_id") % 10 != 0).alias("truth"), F.count_if(F.col("event_id") % 13 != 0).alias("counted"))
    hit = F.sum(F.least("truth", "counted"))
    return t.agg(F.round(hit / F.sum("counted"), 9).alias("precision"), F.round(hit / F.sum("truth"), 9).alias("recall"))


@query("dst01_distinct_regions", f"WITH {DEVICES} SELECT DISTINCT trim(region) AS region FROM dev WHERE trim(region) <> ''")
def dst01(spark, sf):
    return tables.devices(spark, sf).select(F.trim("region").alias("region")).where("region != ''").distinct()


@query("set01_scenic_options", f"WITH {DEVICES}, b AS (SELECT * FROM (VALUES ('EUROPE', 0), ('OTHER', 1)) t(name, i)), u AS (SELECT region AS name FROM dev UNION SELECT nation FROM dev WHERE device_key < 3) SELECT name, i AS ordinal FROM b UNION ALL SELECT name, NULL FROM u WHERE name NOT IN (SELECT name FROM b)")
def set01(spark, sf):
    dev = tables.devices(spark, sf)
    base = spark.createDataFrame([("EUROPE", 0), ("OTHER", 1)], "name string, ordinal int")
    rest = dev.select(F.col("region").alias("name")).union(dev.where("device_key < 3").select("nation")).distinct().join(F.broadcast(base), "name", "left_anti")
    return base.union(rest.withColumn("ordinal", F.lit(None).cast("int")))


@query("set05_subset_check", f"WITH {INGEST} SELECT (SELECT count(*) FROM (SELECT DISTINCT device_id FROM val WHERE event_id % 7 = 0) a WHERE device_id NOT IN (SELECT device_id FROM val)) = 0 AS subset")
def set05(spark, sf):
    rows = tables.valid(spark, sf)
    return rows.where("event_id % 7 = 0").join(rows.select("device_id").distinct(), "device_id", "left_anti").agg((F.count("*") == 0).alias("subset"))


@query("set06_live_ids", f"WITH {INGEST}, m AS (SELECT max(us) AS now FROM val), a AS (SELECT DISTINCT device_id FROM val, m WHERE now - us <= 86400000000), b AS (SELECT DISTINCT device_id FROM val, m WHERE now - us <= 21600000000) SELECT device_id, device_id IN (SELECT device_id FROM b) AS running FROM a")
def set06(spark, sf):
    rows = tables.valid(spark, sf)
    age = rows.join(F.broadcast(rows.agg(F.max("us").alias("now")))).select("device_id", (F.col("now") - F.col("us")).alias("age"))
    live, running = (age.where(F.col("age") <= hours * 3_600_000_000).select("device_id").distinct() for hours in (24, 6))
    return live.join(running.withColumn("running", F.lit(True)), "device_id", "left").select("device_id", F.coalesce("running", F.lit(False)).alias("running"))


@query("sort10_first_samples", f"WITH {INGEST} SELECT device_id, event_id FROM val QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY event_id) <= 4")
def sort10(spark, sf):
    place = F.row_number().over(Window.partitionBy("device_id").orderBy("event_id"))
    return tables.valid(spark, sf).withColumn("r", place).where("r <= 4").select("device_id", "event_id")


SERIES = "m AS (SELECT max(us) // 900000000 AS l FROM val), g AS (SELECT i FROM range(0, 30) t(i)), ser AS (SELECT i, count(val.event_id) AS n FROM g CROSS JOIN m LEFT JOIN val ON us // 900000000 = l - 29 + i GROUP BY i)"


@query("mdl01_interval_series", f"WITH {INGEST}, {SERIES} SELECT i::INT AS slot, n FROM ser")
def mdl01(spark, sf):
    rows = tables.valid(spark, sf)
    one = forecast.series(rows, rows.agg(F.max("us")).scalar())
    return one.select(F.posexplode("history").alias("slot", "n"))


@query("mdl03_trend_forecast", f"WITH {INGEST}, {SERIES}, q AS (SELECT min(n) FILTER (WHERE i = 6) AS a, min(n) FILTER (WHERE i = 29) AS b FROM ser) SELECT round(greatest(0, b + (b - a) / 23.0::DOUBLE), 6) AS forecast FROM q")
def mdl03(spark, sf):
    rows = tables.valid(spark, sf)
    return forecast.series(rows, rows.agg(F.max("us")).scalar()).select(F.round(forecast.trend(F.col("history")), 6).alias("forecast"))


def _passengers(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE list_sum([{digest_number('i', 'j', '1')} % 4 + 2 FOR j IN range(1, {n} + 1)]) END"


PASSENGERS = f"veh AS (SELECT g.i, count(val.event_id) AS n FROM g CROSS JOIN m LEFT JOIN val ON us // 900000000 = l - 29 + g.i AND event_type LIKE 'Vehicle%' GROUP BY g.i), pas AS (SELECT i, ({_passengers('n')})::BIGINT AS persons FROM veh)"


@query("mdl05_total_forecast", f"WITH {INGEST}, {SERIES}, {PASSENGERS}, per AS (SELECT g.i, count(val.event_id) AS n FROM g CROSS JOIN m LEFT JOIN val ON us // 900000000 = l - 29 + g.i AND event_type LIKE 'Person%' GROUP BY g.i), tot AS (SELECT i, persons + n AS n FROM pas JOIN per USING (i)) SELECT array_to_string(list(n ORDER BY i), ',') AS history, round(greatest(0, min(n) FILTER (WHERE i = 29) + (min(n) FILTER (WHERE i = 29) - min(n) FILTER (WHERE i = 6)) / 23.0::DOUBLE), 6) AS predicted_total FROM tot")
def mdl05(spark, sf):
    rows = tables.valid(spark, sf)
    now = rows.agg(F.max("us")).scalar()
    out = forecast.total_persons(forecast.series(rows, now, kind="Vehicle"), forecast.series(rows, now, kind="Person"))
    return out.select(F.array_join(F.col("history").cast("array<string>"), ",").alias("history"), F.round("predicted_total", 6).alias("predicted_total"))


_DEMAND = f"{DEVICES}, {REGIONS}, c AS (SELECT region, count(*) AS crowd FROM dev GROUP BY region), dem AS (SELECT reg.*, crowd, 120.0::DOUBLE * crowd / sum(crowd) OVER () AS predicted, 0.3::DOUBLE * crowd + 0.7::DOUBLE * 120.0::DOUBLE * crowd / sum(crowd) OVER () AS demand FROM reg JOIN c USING (region))"


def _demand(spark, sf):
    crowd = tables.devices(spark, sf).groupBy("region").agg(F.count("*").alias("crowd"))
    return allocate.demand(tables.regions(spark, sf).join(crowd, "region"), 120.0)


@query("mdl06_staff_demand", f"WITH {_DEMAND} SELECT region, round(predicted, 6) AS predicted, round(demand, 6) AS demand FROM dem")
def mdl06(spark, sf):
    return _demand(spark, sf).select("region", F.round("predicted", 6).alias("predicted"), F.round("demand", 6).alias("demand"))


def _plan(spark, sf):
    return allocate.targets(_demand(spark, sf).select("ordinal", "region", "center_x", "center_y", "officers", "demand"), 35)


TARGETS = f"{_DEMAND}, raw AS (SELECT *, row_number() OVER (ORDER BY demand DESC, ordinal) AS rk, 1 + round_even(30 * demand / sum(demand) OVER (), 0)::INT AS r FROM dem), lef AS (SELECT *, 35 - sum(r) OVER () AS d, sum((r > 1)::INT) OVER (ORDER BY rk) AS above FROM raw), tar AS (SELECT *, (r + CASE WHEN rk <= d THEN 1 WHEN r > 1 AND above <= -d THEN -1 ELSE 0 END)::INT AS target FROM lef)"


@query("mdl07_staff_targets", f"WITH {TARGETS} SELECT region, officers, target FROM tar")
def mdl07(spark, sf):
    return _plan(spark, sf).select("region", "officers", "target")


_MOVES = f"""{TARGETS}, spa AS (SELECT *, officers - target AS spare, row_number() OVER (ORDER BY ordinal) AS k FROM tar),
par AS (SELECT *, row_number() OVER (ORDER BY distance, ai, bi) AS n FROM (SELECT a.k AS ai, b.k AS bi, a.region AS from_region, b.region AS to_region,
  sqrt((a.center_x - b.center_x) * (a.center_x - b.center_x) + (a.center_y - b.center_y) * (a.center_y - b.center_y)) AS distance FROM spa a, spa b WHERE a.spare > 0 AND b.spare < 0)),
mov AS (SELECT 0::BIGINT AS n, (SELECT list(spare::INT ORDER BY k) FROM spa) AS s, 18 AS rest, 0 AS c
  UNION ALL SELECT n + 1, list_transform(s, lambda v, i: CASE i WHEN ai THEN v - m WHEN bi THEN v + m ELSE v END), rest - m, m
  FROM (SELECT mov.n, s, rest, ai, bi, greatest(0, least(s[ai], -s[bi], rest)) AS m FROM mov JOIN par ON par.n = mov.n + 1)),
mvs AS (SELECT from_region, to_region, c AS count, distance FROM mov JOIN par USING (n) WHERE c > 0)"""


@query("mdl08_staff_movements", f"WITH RECURSIVE {_MOVES} SELECT from_region, to_region, count, round(distance, 6) AS distance FROM mvs")
def mdl08(spark, sf):
    return allocate.movements(_plan(spark, sf), 18).withColumn("distance", F.round("distance", 6))


@query(
    "mdl09_plan_scores",
    f"""WITH RECURSIVE {_MOVES}, w AS (SELECT coalesce(max(distance), 1) AS far, coalesce(sum(distance * count), 0) AS work FROM mvs), cov AS (SELECT avg(demand / greatest(1, target)) AS coverage FROM tar),
e AS (SELECT coverage, 1 - work / (35 * CASE WHEN far = 0 THEN 1 ELSE far END) AS efficiency FROM w, cov)
SELECT round(coverage, 6) AS coverage, round(efficiency, 6) AS efficiency, round(0.7 * least(coverage, 1) + 0.3 * greatest(0, efficiency), 6) AS score FROM e""",
)
def mdl09(spark, sf):
    plan = _plan(spark, sf)
    out = allocate.scores(plan, allocate.movements(plan, 18), 35)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_JOURNAL = "jou AS (SELECT event_id, event_id % 3 <> 0 AS d, event_id % 6 <> 1 AS a FROM events WHERE event_id % 20 <> 0), led AS (SELECT event_id, event_id % 9 = 0 AS bad, event_id % 4 <> 0 AS m FROM events WHERE event_id % 7 <> 0), ded AS (SELECT event_id, event_id % 11 = 0 AS bad FROM events WHERE event_id % 5 <> 0)"


@query(
    "join06_reconcile_outcomes",
    f"""WITH {_JOURNAL}, x AS (SELECT coalesce(j.event_id, l.event_id) AS event_id, j.event_id IS NOT NULL AS mine, l.event_id IS NOT NULL AS theirs, d, a, l.bad AS lb, m, k.event_id IS NOT NULL AS cached, k.bad AS kb FROM jou j FULL JOIN led l ON j.event_id = l.event_id LEFT JOIN ded k ON k.event_id = coalesce(j.event_id, l.event_id)),
o AS (SELECT event_id, CASE WHEN mine AND NOT theirs THEN CASE WHEN NOT d THEN 'ledger_missing_pending' WHEN NOT a THEN 'legacy_delivered_without_ledger' ELSE 'ledger_missing_delivered_v2' END WHEN mine THEN CASE WHEN lb THEN 'ledger_payload_conflict' ELSE 'ledger_match' END ELSE 'backend_only_candidate' END AS outcome FROM x
UNION ALL SELECT event_id, 'ledger_received_local_pending' FROM x WHERE mine AND theirs AND NOT d
UNION ALL SELECT event_id, CASE WHEN cached AND kb THEN 'redis_payload_conflict' WHEN theirs AND m AND NOT cached THEN 'materialized_missing_redis' WHEN theirs AND NOT m AND cached THEN 'redis_applied_ledger_pending' WHEN cached THEN 'redis_match' END FROM x WHERE mine)
SELECT outcome, count(*) AS n FROM o WHERE outcome IS NOT NULL GROUP BY outcome""",
)
def join06(spark, sf):
    e = tables.table(spark, sf, "events").select("event_id")
    n = F.col("event_id")
    journal = e.where("event_id % 20 != 0").select("event_id", n.cast("string").alias("digest"), n.cast("string").alias("identity"), F.when(n % 3 != 0, 1).alias("delivered"), F.when(n % 6 != 1, 1).alias("applied"))
    ledger = e.where("event_id % 7 != 0").select("event_id", F.when(n % 9 == 0, "x").otherwise(n.cast("string")).alias("payload_hash"), F.when(n % 4 != 0, 1).alias("materialized"))
    dedup = e.where("event_id % 5 != 0").select("event_id", F.when(n % 11 == 0, "x").otherwise(n.cast("string")).alias("cached"))
    return reconcile.summary(reconcile.outcomes(journal, ledger, dedup)).select("outcome", "n")


@query("join07_backend_only", f"WITH {_JOURNAL} SELECT event_id FROM led WHERE event_id NOT IN (SELECT event_id FROM jou)")
def join07(spark, sf):
    e = tables.table(spark, sf, "events").select("event_id")
    return e.where("event_id % 7 != 0").join(e.where("event_id % 20 != 0"), "event_id", "left_anti")


@query("join08_channel_actions", f"WITH {DEVICES}, r AS (SELECT device_key AS channel, name, CASE WHEN device_key % 5 = 0 THEN NULL ELSE device_key % 3 <> 0 END AS online FROM dev WHERE device_key % 11 <> 0), l AS (SELECT device_key AS channel, CASE WHEN device_key % 13 = 0 THEN 'old' ELSE name END AS name, device_key % 2 = 0 AS running, device_key % 7 <> 0 AS enabled FROM dev WHERE device_key % 4 <> 1) SELECT coalesce(r.channel, l.channel) AS channel, CASE WHEN l.channel IS NULL THEN 'add' WHEN r.channel IS NULL THEN CASE WHEN running THEN 'stop' ELSE 'keep' END WHEN online IS NULL THEN 'preserve' WHEN online AND enabled AND NOT running THEN 'start' WHEN NOT online AND running THEN 'stop' WHEN r.name <> l.name THEN 'rename' ELSE 'keep' END AS action FROM r FULL JOIN l ON r.channel = l.channel")
def join08(spark, sf):
    dev, k = tables.devices(spark, sf), F.col("device_key")
    remote = dev.where("device_key % 11 != 0").select(k.alias("channel"), "name", F.when(k % 5 != 0, k % 3 != 0).alias("online"))
    local = dev.where("device_key % 4 != 1").select(k.alias("channel"), F.when(k % 13 == 0, "old").otherwise(F.col("name")).alias("name"), (k % 2 == 0).alias("running"), (k % 7 != 0).alias("enabled"))
    return reconcile.channel_actions(remote, local)


def _log(spark, sf):
    n = F.col("event_id")
    message = F.concat(F.lit("[cam-"), (n % 5).cast("string"), F.lit("] 运行统计(30s): 处理fps="), F.format_string("%.1f", n % 90 / 10.0), F.lit(" 采样帧=200 丢帧="), (n % 40).cast("string"), F.lit("("), F.format_string("%.1f", n % 40 / 2.0), F.lit("%) | 拒绝: 未远离线="), (n % 3).cast("string"), F.lit(" ROI外="), (n % 4).cast("string"))
    other = F.when(n % 3 == 0, "[cam-1] 管道启动:rtsp://x/y").otherwise("管道停止 有效帧率过低")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".000 | INFO | app.x:fn:12 - "), F.when(n % 2 == 0, message).otherwise(other))
    return tables.table(spark, sf, "events").select((n + 1).alias("line_no"), F.when(n % 50 == 7, "broken line").otherwise(line).alias("value"))


@query("src11_log_totals", "SELECT count(*) AS lines, count(*) FILTER (WHERE event_id % 50 <> 7) AS parsed, array_to_string(list_slice(list(event_id + 1 ORDER BY event_id) FILTER (WHERE event_id % 50 = 7), 1, 20), ',') AS unmatched FROM events")
def src11(spark, sf):
    return audit.totals(audit.parsed(_log(spark, sf))).withColumn("unmatched", F.array_join("unmatched", ","))


@query("strf12_log_markers", "WITH e AS (SELECT event_id FROM events WHERE event_id % 50 <> 7 AND event_id % 2 = 1), m AS (SELECT 'pipeline_start' AS marker, event_id FROM e WHERE event_id % 3 = 0 UNION ALL SELECT unnest(['pipeline_stop', 'low_fps']), event_id FROM e WHERE event_id % 3 <> 0) SELECT marker, count(*) AS n, array_to_string(list_slice(list(event_id + 1 ORDER BY event_id), 1, 4), ',') AS first_lines FROM m GROUP BY marker")
def strf12(spark, sf):
    return audit.markers(audit.parsed(_log(spark, sf))).withColumn("first_lines", F.array_join("first_lines", ","))


@query("agg18_log_summary", "WITH e AS (SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 50 <> 7), v AS (SELECT 'fps' AS metric, (event_id % 90 / 10.0)::DOUBLE AS v FROM e UNION ALL SELECT 'sampled', 200 FROM e UNION ALL SELECT 'drop', event_id % 40 FROM e UNION ALL SELECT 'drop_pct', (event_id % 40 / 2.0)::DOUBLE FROM e) SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, quantile_disc(v, 0.95) AS p95, min(v) AS least, max(v) AS most FROM v GROUP BY metric")
def agg18(spark, sf):
    return audit.summary(audit.windows(audit.parsed(_log(spark, sf)))).select("metric", "n", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), "p95", "least", "most")


@query("agg18_weighted_drop", "WITH e AS (SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 50 <> 7) SELECT round(100.0::DOUBLE * sum(event_id % 40) / (200 * count(*)), 6) AS drop_pct, round(200 * count(*) / (30.0::DOUBLE * count(*)), 6) AS sample_fps, count(DISTINCT event_id % 5) AS devices FROM e")
def weighted(spark, sf):
    out = audit.weighted_drop(audit.windows(audit.parsed(_log(spark, sf))))
    return out.select(F.round("drop_pct", 6).alias("drop_pct"), F.round("sample_fps", 6).alias("sample_fps"), "devices")


@query("agg17_reject_reasons", "WITH e AS (SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 50 <> 7) SELECT '未远离线' AS reason, sum(event_id % 3)::BIGINT AS n FROM e UNION ALL SELECT 'ROI外', sum(event_id % 4)::BIGINT FROM e")
def agg17(spark, sf):
    return audit.reject_totals(audit.windows(audit.parsed(_log(spark, sf))))


@query("prj05_online_flag", f"WITH {INGEST}, m AS (SELECT max(us) AS now FROM val), l AS (SELECT device_id, max(us) AS us FROM val GROUP BY device_id) SELECT device_id, now - us < 7200000000 AS online FROM l, m")
def prj05(spark, sf):
    rows = tables.valid(spark, sf)
    now = rows.agg(F.max("us")).scalar()
    return rows.groupBy("device_id").agg((F.lit(now) - F.max("us") < 7_200_000_000).alias("online"))


@query("prj04_device_rows", f"WITH {INGEST}, k AS (SELECT 'cam-' || i::VARCHAR AS device_id, i FROM range(0, 36) t(i)), c AS (SELECT device_id, count(*) AS events, max(us) AS us FROM val GROUP BY device_id), m AS (SELECT max(us) AS now FROM val) SELECT device_id, coalesce(events, 0) AS events, CASE WHEN us IS NULL THEN 'registered' WHEN now - us > 7200000000 THEN 'offline' WHEN i % 2 = 0 THEN 'running' ELSE 'online' END AS status FROM k LEFT JOIN c USING (device_id), m")
def prj04(spark, sf):
    rows = tables.valid(spark, sf)
    now = rows.agg(F.max("us")).scalar()
    known = spark.range(36).select(F.concat(F.lit("cam-"), F.col("id").cast("string")).alias("device_id"), F.col("id").alias("i"))
    stats = rows.groupBy("device_id").agg(F.count("*").alias("events"), F.max("us").alias("us"))
    status = F.when(F.col("us").isNull(), "registered").when(F.lit(now) - F.col("us") > 7_200_000_000, "offline").when(F.col("i") % 2 == 0, "running").otherwise("online")
    return known.join(stats, "device_id", "left").select("device_id", F.coalesce("events", F.lit(0)).cast("long").alias("events"), status.alias("status"))


@query("dt10_last_active", f"WITH {INGEST} SELECT device_id, strftime(max(occurred_at), '%Y-%m-%d') AS last_active, max(us)::BIGINT AS us FROM val GROUP BY device_id")
def dt10(spark, sf):
    return tables.valid(spark, sf).groupBy("device_id").agg(F.date_format(F.max("occurred_at"), "yyyy-MM-dd").alias("last_active"), F.max(micros("occurred_at")).alias("us"))


_TERM = "exp(-mean + k * ln(mean) - lgamma(k + 1))"
_POISSON = f"sl AS (SELECT i % 32 AS d, i // 32 AS h FROM range(0, 32 * 72) t(i)), mn AS (SELECT d, h, (1 + (h % 24 % 12) / 4.0::DOUBLE) * 2.0::DOUBLE AS mean, {digest_number('d', 'h', '7')} / 4503599627370496.0::DOUBLE AS u FROM sl), cu AS (SELECT d, h, u, k, sum({_TERM}) OVER (PARTITION BY d, h ORDER BY k) AS c FROM mn, range(0, 90) r(k)), cn AS (SELECT d, h, count(*) FILTER (WHERE u > c) AS n FROM cu GROUP BY d, h), ev AS (SELECT d, h, unnest(range(1, n + 1)) AS i FROM cn)"


@query("src15_synthetic_events", f"WITH {_POISSON} SELECT concat_ws('-', d, h, i) AS event_id, 'cam-' || d::VARCHAR AS device_id, ['VehicleEnter', 'VehicleExit', 'PersonEnter', 'PersonExit'][{digest_number('d', 'h', 'i')} % 4 + 1] AS event_type, h FROM ev")
def src15(spark, sf):
    weights = [1 + (h % 12) / 4 for h in range(24)]
    return tables.synthetic_events(spark, 32, 72, weights, 2.0)
