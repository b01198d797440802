"""Queries on tracks, geometry, congestion, alerts and liveness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowspark.functions import geometry as g
from flowspark.operators import alerts, congestion, counters, events, flow, liveness
from flowspark.plans.base import INGEST, OBS, REPORTS, query
from flowspark.sources import tables

_TRACK = "PARTITION BY device_id, track_id ORDER BY n"


@query(
    "win04_09_motion",
    f"""WITH {OBS}, m AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM obs WINDOW w AS ({_TRACK})),
q AS (SELECT *, lag(dx) OVER w AS px, lag(dy) OVER w AS py, avg(dx) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS svx, first(x) OVER w3 AS fx, first(t) OVER w3 AS ft FROM m WINDOW w AS ({_TRACK}), w3 AS ({_TRACK} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT track_id, n, round(svx, 6) AS step_vx, round(CASE WHEN t > ft THEN (x - fx) / (t - ft) END, 6) AS vx,
round(CASE WHEN sqrt(dx * dx + dy * dy) * sqrt(px * px + py * py) > 1e-12 THEN (dx * px + dy * py) / (sqrt(dx * dx + dy * dy) * sqrt(px * px + py * py)) END, 6) AS cosine FROM q""",
)
def motion(spark, sf):
    return flow.motion(tables.observations(spark, sf)).select("track_id", "n", *[F.round(c, 6).alias(c) for c in ("step_vx", "vx", "cosine")])


@query(
    "win08_past_speed",
    f"""WITH {OBS}, m AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / ((t - lag(t) OVER w) * 25) AS step FROM obs WINDOW w AS ({_TRACK}))
SELECT track_id, n, round(avg(step) OVER ({_TRACK} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS past_speed FROM m""",
)
def past_speed(spark, sf):
    return flow.past_speed(tables.observations(spark, sf)).select("track_id", "n", F.round("past_speed", 6).alias("past_speed"))


@query("win06_bounded_history", f"WITH {OBS} SELECT track_id, n, least(30, n)::INT AS points, round(sum(x) OVER ({_TRACK} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS sum_x FROM obs")
def history(spark, sf):
    rows = flow.recent_points(tables.observations(spark, sf))
    return rows.select("track_id", "n", F.size("history").alias("points"), F.round(F.aggregate("history", F.lit(0.0), lambda a, p: a + p["x"]), 6).alias("sum_x"))


@query(
    "win12_moving_average",
    f"""WITH RECURSIVE {OBS}, s AS (SELECT track_id, n, y FROM obs), e AS (SELECT track_id, n, y AS a FROM s WHERE n = 1 UNION ALL SELECT s.track_id, s.n, 0.9 * e.a + 0.1 * s.y FROM e JOIN s ON s.track_id = e.track_id AND s.n = e.n + 1)
SELECT track_id, round(arg_max(a, n), 6) AS average FROM e GROUP BY track_id""",
)
def moving_average(spark, sf):
    return flow.moving_average(tables.observations(spark, sf), ["track_id"], "n", "y").select("track_id", F.round("average", 6).alias("average"))


@query("win11_counter_steps", f"WITH {OBS}, s AS (SELECT track_id, n, (x * 100)::INT AS c FROM obs) SELECT track_id, n, CASE WHEN c - coalesce(lag(c) OVER w, 0) < 0 THEN c ELSE c - coalesce(lag(c) OVER w, 0) END AS step FROM s WINDOW w AS (PARTITION BY track_id ORDER BY n)")
def steps(spark, sf):
    rows = tables.observations(spark, sf).select("track_id", "n", F.round(F.col("x") * 100).cast("int").alias("c"))
    return flow.counter_steps(rows, ["track_id"], "n", "c").select("track_id", "n", "step")


@query("win13_busy_percent", f"WITH {OBS}, s AS (SELECT track_id, n, sum((x * 100)::INT) OVER w AS idle, sum((x * 100)::INT + 50) OVER w AS total FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY n)) SELECT track_id, n, round(100.0::DOUBLE * ((total - lag(total) OVER w) - (idle - lag(idle) OVER w)) / (total - lag(total) OVER w), 6) AS busy FROM s WINDOW w AS (PARTITION BY track_id ORDER BY n)")
def busy(spark, sf):
    w = Window.partitionBy("track_id").orderBy("n")
    c = F.round(F.col("x") * 100).cast("int")
    rows = tables.observations(spark, sf).select("track_id", "n", F.sum(c).over(w).alias("idle"), F.sum(c + 50).over(w).alias("total"))
    return flow.busy_percent(rows, ["track_id"], "n").select("track_id", "n", F.round("busy", 6).alias("busy"))


@query("win14_forward_fill", f"WITH {OBS} SELECT track_id, n, last_value(CASE WHEN n % 3 = 1 THEN n END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS status FROM obs")
def fill(spark, sf):
    rows = tables.observations(spark, sf).select("track_id", "n", F.when(F.col("n") % 3 == 1, F.col("n")).alias("status"))
    return flow.filled(rows, ["track_id"], "n", "status")


@query("win15_largest_gap", f"WITH {INGEST}, g AS (SELECT device_id, us - lag(us) OVER (PARTITION BY device_id ORDER BY us) AS gap FROM val) SELECT device_id, max(gap)::BIGINT AS max_gap_us FROM g GROUP BY device_id")
def largest_gap(spark, sf):
    return flow.largest_gap(tables.valid(spark, sf), ["device_id"])


@query("win10_edges", f"WITH {REPORTS}, e AS (SELECT *, roi_vehicles >= 12 AS f, coalesce(lag(roi_vehicles >= 12) OVER (PARTITION BY device_id ORDER BY us, report_id), false) AS b FROM rep) SELECT device_id, report_id, CASE WHEN f AND NOT b THEN 'onset' ELSE 'recovery' END AS transition FROM e WHERE f <> b")
def edges(spark, sf):
    return events.consecutive(tables.reports(spark, sf), "device_id", ["us", "report_id"], F.col("roi_vehicles") >= 12).select("device_id", "report_id", "transition")


_SCORE = """jud AS (SELECT *, CASE WHEN roi_vehicles = 0 THEN 0 ELSE 1 - least(1.0, v_flow / 40.0::DOUBLE) END * 0.5 + 0.5 * least(1.0::DOUBLE, roi_vehicles / 15.0::DOUBLE) AS v,
 CASE WHEN roi_persons = 0 THEN 0 ELSE 1 - least(1.0, p_flow / 20.0::DOUBLE) END * 0.5 + 0.5 * least(1.0::DOUBLE, roi_persons / 30.0::DOUBLE) AS p, report_id % 4 AS k FROM rep),
sco AS (SELECT *, CASE k WHEN 0 THEN v * 0.5 + p * 0.5 WHEN 1 THEN v WHEN 2 THEN p ELSE 0 END AS score,
 coalesce(CASE k WHEN 0 THEN v * 0.5 + p * 0.5 >= 0.7 WHEN 1 THEN roi_vehicles >= 15 AND v_flow < 40 WHEN 2 THEN roi_persons >= 30 AND p_flow < 20 END, false) AS congested FROM jud)"""


def _judged(spark, sf):
    k = F.col("report_id") % 4
    limits = tables.reports(spark, sf).withColumns({"max_vehicles": F.when(k.isin(0, 1), 15).otherwise(0), "min_v_flow": F.lit(40.0), "max_persons": F.when(k.isin(0, 2), 30).otherwise(0), "min_p_flow": F.lit(20.0)})
    return congestion.judge(limits)


@query("mth01_congestion_score", f"WITH {REPORTS}, {_SCORE} SELECT report_id, round(score, 6) AS score, congested FROM sco")
def score(spark, sf):
    return _judged(spark, sf).select("report_id", F.round("score", 6).alias("score"), "congested")


@query("str10_congestion_transitions", f"WITH {REPORTS}, {_SCORE}, e AS (SELECT *, coalesce(lag(congested) OVER (PARTITION BY device_id ORDER BY us, report_id), false) AS b FROM sco) SELECT device_id, report_id, CASE WHEN congested THEN 'onset' ELSE 'recovery' END AS transition FROM e WHERE congested <> b")
def transitions(spark, sf):
    return congestion.transitions(_judged(spark, sf)).select("device_id", "report_id", "transition")


@query("agg14_passage_index", f"WITH {REPORTS}, {_SCORE} SELECT greatest(0, least(100, round(100 - 100 * avg(score))))::INT AS passage_index, CASE WHEN greatest(0, least(100, round(100 - 100 * avg(score)))) > 85 THEN 'smooth' WHEN greatest(0, least(100, round(100 - 100 * avg(score)))) > 70 THEN 'slow' ELSE 'congested' END AS level FROM sco")
def passage(spark, sf):
    return counters.passage_index(_judged(spark, sf))


_RULES = [("v_warn", "vehicle", "roi_vehicles", 18.0, "warning", "vehicles {value}/{threshold}"), ("v_crit", "vehicle", "roi_vehicles", 22.0, "critical", "vehicles {value}/{threshold}"), ("p_warn", "person", "roi_persons", 50.0, "warning", "persons {value}/{threshold}")]
_CROSSED = "hit AS (SELECT device_id, report_id, us, rule_id, value, 'vehicles ' || value::VARCHAR || '/' || t::VARCHAR AS message FROM (SELECT *, roi_vehicles AS value FROM rep) JOIN (VALUES ('v_warn', 18), ('v_crit', 22)) r(rule_id, t) ON value >= t UNION ALL SELECT device_id, report_id, us, 'p_warn', roi_persons, 'persons ' || roi_persons::VARCHAR || '/50' FROM rep WHERE roi_persons >= 50)"


def _alerts(spark, sf):
    rules = spark.createDataFrame(_RULES, alerts.RULES)
    return alerts.crossed(tables.reports(spark, sf), rules, ["device_id", "report_id", "us"], ["roi_vehicles", "roi_persons"])


@query("join15_threshold_rules", f"WITH {REPORTS}, {_CROSSED} SELECT device_id, report_id, rule_id, value::DOUBLE AS value, message FROM hit")
def rules(spark, sf):
    return _alerts(spark, sf).select("device_id", "report_id", "rule_id", "value", "message")


_SUPPRESSED = """r AS (SELECT *, row_number() OVER (PARTITION BY device_id, rule_id ORDER BY us, report_id) AS i FROM hit),
f AS (SELECT device_id, rule_id, i, us, us AS last, report_id, true AS fired FROM r WHERE i = 1
 UNION ALL SELECT r.device_id, r.rule_id, r.i, r.us, CASE WHEN r.us - f.last >= {s} * 1000000::BIGINT THEN r.us ELSE f.last END, r.report_id, r.us - f.last >= {s} * 1000000::BIGINT FROM f JOIN r ON r.device_id = f.device_id AND r.rule_id = f.rule_id AND r.i = f.i + 1)"""


@query("str07_alert_suppression", f"WITH RECURSIVE {REPORTS}, {_CROSSED}, {_SUPPRESSED.format(s=20000)} SELECT device_id, rule_id, report_id FROM f WHERE fired")
def suppression(spark, sf):
    return alerts.suppressed(_alerts(spark, sf).select("device_id", "rule_id", "us", "report_id"), ["device_id", "rule_id"], 20000).select("device_id", "rule_id", "report_id")


@query("str09_anomaly_cooldown", f"WITH RECURSIVE {REPORTS}, hit AS (SELECT device_id, CASE report_id % 2 WHEN 0 THEN 'black_screen' ELSE 'flower_screen' END AS rule_id, us, report_id FROM rep WHERE roi_persons % 3 = 0), {_SUPPRESSED.format(s=60000)} SELECT device_id, rule_id AS type, report_id FROM f WHERE fired")
def cooldown(spark, sf):
    rows = tables.reports(spark, sf).where("roi_persons % 3 = 0").select("device_id", F.when(F.col("report_id") % 2 == 0, "black_screen").otherwise("flower_screen").alias("type"), "us", "report_id")
    return alerts.suppressed(rows, ["device_id", "type"], 60000).select("device_id", "type", "report_id")


@query("agg15_roi_occupancy", f"WITH {OBS}, r AS (SELECT *, x BETWEEN 0.2 AND 0.8 AND y BETWEEN 0.1 AND 0.6 AND NOT (x > 0.5 AND y > 0.3) AS i FROM obs) SELECT device_id, n, count(*) FILTER (WHERE i AND class_name IN ('car', 'truck', 'bus')) AS vehicles, count(*) FILTER (WHERE i AND class_name = 'person') AS persons FROM r GROUP BY ALL")
def occupancy(spark, sf):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.2, 0.1), (0.8, 0.1), (0.8, 0.3), (0.5, 0.3), (0.5, 0.6), (0.2, 0.6))])
    rows = tables.observations(spark, sf).withColumn("i", g.in_polygon((F.col("x"), F.col("y")), ring))
    return rows.groupBy("device_id", "n").agg(F.count_if(F.col("i") & F.col("class_name").isin("car", "truck", "bus")).alias("vehicles"), F.count_if(F.col("i") & (F.col("class_name") == "person")).alias("persons"))


_LINE = (0.1, 0.45), (0.9, 0.55)
_OFF = "((x - 0.1) * -0.1::DOUBLE + (y - 0.45) * 0.8::DOUBLE)"


def _line():
    p1, p2 = [tuple(F.lit(c) for c in p) for p in _LINE]
    return p1, p2, tuple(F.round(c, 12) for c in g.normal(p1, p2, (F.lit(0.5), F.lit(0.9))))  # 0.1, not 0.55 - 0.45 in doubles


@query("geo02_05_line_relations", f"WITH {OBS}, t AS (SELECT *, ((x - 0.1) * 0.8::DOUBLE + (y - 0.45) * 0.1::DOUBLE) / 0.65::DOUBLE AS f FROM obs) SELECT track_id, n, round({_OFF}, 9) AS off, sign(round({_OFF}, 9))::INT AS side, round(f, 6) AS foot, round(sqrt(pow(x - (0.1 + greatest(0, least(1, f)) * 0.8), 2) + pow(y - (0.45 + greatest(0, least(1, f)) * 0.1), 2)), 6) AS distance FROM t")
def line_relations(spark, sf):
    p1, p2, n = _line()
    p = F.col("x"), F.col("y")
    off = g.rounded(g.offset(p, p1, n), 9)
    return tables.observations(spark, sf).select("track_id", "n", off.alias("off"), F.signum(off).cast("int").alias("side"), g.rounded(g.projection(p, p1, p2), 6).alias("foot"), g.rounded(g.segment_distance(p, p1, p2), 6).alias("distance"))


@query(
    "cep05_candidate_crossings",
    f"""WITH {OBS}, t AS (SELECT *, {_OFF} AS o, lag({_OFF}) OVER w AS po, lag(x) OVER w AS px, lag(y) OVER w AS py FROM obs WINDOW w AS ({_TRACK})),
c AS (SELECT *, px + po / (po - o) * (x - px) AS cx, py + po / (po - o) * (y - py) AS cy FROM t WHERE po * o < 0)
SELECT track_id, n, CASE WHEN o > 0 THEN 'enter' ELSE 'exit' END AS direction, round(cx, 6) AS cross_x, round(cy, 6) AS cross_y FROM c WHERE round(((cx - 0.1) * 0.8::DOUBLE + (cy - 0.45) * 0.1::DOUBLE) / 0.65::DOUBLE, 9) BETWEEN 0 AND 1
 AND round(abs((x - px) * -0.1::DOUBLE + (y - py) * 0.8::DOUBLE) / sqrt(0.65::DOUBLE) / 0.2::DOUBLE, 6) >= 0.5""",
)
def candidates(spark, sf):
    p1, p2, n = _line()
    w = Window.partitionBy("device_id", "track_id").orderBy("n")
    rows = tables.observations(spark, sf).withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    prev, cur = (F.col("px"), F.col("py")), (F.col("x"), F.col("y"))
    rows = rows.withColumns({"po": g.offset(prev, p1, n), "o": g.offset(cur, p1, n)}).where("po * o < 0")
    cx, cy = g.crossing_point(prev, cur, F.col("po"), F.col("o"))
    met = rows.where(g.fast_enough(prev, cur, g.unit(n), F.lit(0.2), 0.5)).withColumns({"cx": cx, "cy": cy})
    return met.where(g.rounded(g.projection((F.col("cx"), F.col("cy")), p1, p2), 9).between(0, 1)).select("track_id", "n", F.when(F.col("o") > 0, "enter").otherwise("exit").alias("direction"), g.rounded("cx", 6).alias("cross_x"), g.rounded("cy", 6).alias("cross_y"))


@query("geo15_adaptive_pixel", f"WITH {OBS} SELECT track_id, n, greatest(30.0::DOUBLE, 0.3::DOUBLE * greatest(x * 200, y * 200)) AS least FROM obs")
def adaptive(spark, sf):
    return tables.observations(spark, sf).select("track_id", "n", g.adaptive_pixel(F.col("x") * 200, F.col("y") * 200).alias("least"))


@query("agg28_bounding_box", f"WITH {OBS} SELECT device_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM obs GROUP BY device_id")
def bounding(spark, sf):
    return tables.observations(spark, sf).groupBy("device_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("agg27_largest_ring", f"WITH {OBS}, r AS (SELECT device_id, track_id, max(x) - min(x) AS w, max(y) - min(y) AS h FROM obs GROUP BY ALL) SELECT device_id, arg_max(track_id, round(w * h, 9) * 1000000 - track_id / 1000.0::DOUBLE) AS track_id, round(max(w * h), 6) AS area FROM r GROUP BY device_id")
def largest_ring(spark, sf):
    box = tables.observations(spark, sf).groupBy("device_id", "track_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    rings = box.withColumn("area", g.ring_area(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))))
    return rings.groupBy("device_id").agg(F.max_by("track_id", F.round("area", 9) * 1000000 - F.col("track_id") / 1000.0).alias("track_id"), F.round(F.max("area"), 6).alias("area"))


_LAST = f"{INGEST}, m AS (SELECT max(us) AS now FROM val), d AS (SELECT device_id, max(us) AS last_us, CASE WHEN substr(device_id, 5)::INT % 5 = 0 THEN 'offline' ELSE 'online' END AS status FROM val GROUP BY device_id)"


@query("str11_heartbeat_status", f"WITH {_LAST} SELECT device_id, CASE WHEN now - last_us > 7200000000 THEN 'offline' WHEN status = 'offline' THEN 'online' ELSE status END AS new_status, now - last_us > 7200000000 AND status <> 'offline' AS alert FROM d, m")
def heartbeat(spark, sf):
    rows = tables.valid(spark, sf)
    now = rows.agg(F.max("us")).scalar()
    last = rows.groupBy("device_id").agg(F.max("us").alias("last_us")).withColumn("status", F.when(F.substring("device_id", 5, 3).cast("int") % 5 == 0, "offline").otherwise("online"))
    return liveness.heartbeat_status(last, now, 7200).select("device_id", "new_status", "alert")


@query("str11_timeouts", f"WITH {INGEST}, m AS (SELECT max(us) AS now FROM val), g AS (SELECT device_id, us, lead(us) OVER (PARTITION BY device_id ORDER BY us) AS nxt FROM val) SELECT device_id, (us + 21600000000)::BIGINT AS offline_us, nxt::BIGINT AS recovered_us FROM g, m WHERE coalesce(nxt, now) - us > 21600000000")
def timeouts(spark, sf):
    rows = tables.valid(spark, sf)
    return liveness.timeouts(rows, 21600, rows.agg(F.max("us")).scalar())


@query(
    "str12_coverage_gaps",
    f"""WITH {REPORTS}, s AS (SELECT device_id, 'e' || (report_id // 1500)::VARCHAR AS stream_epoch, CASE WHEN roi_vehicles % 5 < 3 THEN 'processing' WHEN roi_vehicles % 5 = 3 THEN 'no_frames' ELSE 'low_fps' END AS state, us AS observed FROM rep),
b AS (SELECT *, state = 'processing' AS ok, lag(observed) OVER w AS prev, lag(stream_epoch) OVER w AS pe, coalesce(lag(state = 'processing') OVER w, true) AS pok FROM s WINDOW w AS (PARTITION BY device_id ORDER BY observed)),
o AS (SELECT *, pok AND (NOT ok OR coalesce(pe <> stream_epoch, false)) AS opens FROM b), i AS (SELECT *, sum(opens::INT) OVER (PARTITION BY device_id ORDER BY observed) AS gap FROM o WHERE opens OR NOT pok)
SELECT device_id, arg_min(stream_epoch, observed) AS stream_epoch, arg_min(coalesce(prev, observed), observed)::BIGINT AS start, max(observed) FILTER (WHERE ok)::BIGINT AS "end", arg_min(CASE WHEN ok THEN 'stream_epoch_changed_or_restart' ELSE state END, observed) AS reason FROM i GROUP BY device_id, gap""",
)
def coverage(spark, sf):
    m = F.col("roi_vehicles") % 5
    rows = tables.reports(spark, sf).select("device_id", F.concat(F.lit("e"), F.floor(F.col("report_id") / 1500).cast("string")).alias("stream_epoch"), F.when(m < 3, "processing").when(m == 3, "no_frames").otherwise("low_fps").alias("state"), F.col("us").alias("observed"))
    return liveness.coverage_gaps(rows).drop("gap")


@query("str16_clock_sessions", f"WITH {REPORTS}, f AS (SELECT device_id, report_id, us / 1000000.0::DOUBLE AS t_mono, us / 1000000.0::DOUBLE + CASE WHEN roi_persons = 7 THEN 5 ELSE 0 END AS t_wall FROM rep), j AS (SELECT *, coalesce(abs((t_wall - lag(t_wall) OVER w) - (t_mono - lag(t_mono) OVER w)) > 2 OR t_wall - lag(t_wall) OVER w <= 0, false) AS jump FROM f WINDOW w AS (PARTITION BY device_id ORDER BY t_mono)) SELECT device_id, report_id, sum(jump::INT) OVER (PARTITION BY device_id ORDER BY t_mono)::BIGINT AS session FROM j")
def clock(spark, sf):
    t = F.col("us") / 1000000.0
    rows = tables.reports(spark, sf).select("device_id", "report_id", t.alias("t_mono"), (t + F.when(F.col("roi_persons") == 7, 5).otherwise(0)).alias("t_wall"))
    return liveness.sessions(rows).select("device_id", "report_id", "session")


@query(
    "str15_health_states",
    f"""WITH {REPORTS} SELECT report_id, CASE WHEN report_id % 19 = 0 THEN 'stopped' WHEN roi_persons >= 55 THEN 'event_persist_blocked' WHEN report_id % 17 = 0 THEN CASE WHEN roi_vehicles < 15 THEN 'waiting_first_frame' ELSE 'no_frames' END
 WHEN roi_vehicles >= 20 THEN 'no_recent_frame' WHEN report_id % 13 = 0 OR roi_persons >= 50 THEN 'no_recent_inference' WHEN report_id % 11 = 0 THEN 'black_screen' WHEN roi_vehicles * 3 >= 30 AND v_flow < 5 THEN 'low_fps' ELSE 'processing' END AS state FROM rep""",
)
def health(spark, sf):
    r = F.col("report_id")
    rows = tables.reports(spark, sf).withColumns(
        {
            "running": r % 19 != 0,
            "persist_age": F.when(F.col("roi_persons") >= 55, 5.0),
            "packet_age": F.when(r % 17 != 0, F.when(F.col("roi_vehicles") >= 20, 15.0).otherwise(1.0)),
            "success_age": F.when(r % 13 != 0, F.when(F.col("roi_persons") >= 50, 20.0).otherwise(0.5)),
            "anomaly": F.when(r % 11 == 0, "black_screen"),
            "fps": F.col("v_flow"),
        }
    )
    first = F.when(r % 17 == 0, F.col("roi_vehicles")).otherwise(F.col("roi_vehicles") * 3)
    return liveness.health(rows.withColumn("start_age", first)).select("report_id", "state")


@query(
    "str13_confirmed_anomalies",
    f"""WITH {REPORTS}, s AS (SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY us, report_id) AS n, CASE WHEN roi_vehicles % 5 < 2 THEN NULL WHEN roi_persons < 30 THEN 'black_screen' ELSE 'flower_screen' END AS a FROM rep),
r AS (SELECT *, sum((a IS NULL)::INT) OVER (PARTITION BY device_id ORDER BY n) AS run FROM s), l AS (SELECT *, count(a) OVER (PARTITION BY device_id, run ORDER BY n) AS len FROM r),
t AS (SELECT *, CASE WHEN a IS NOT NULL AND len >= 2 THEN a END AS st FROM l), b AS (SELECT *, lag(st) OVER (PARTITION BY device_id ORDER BY n) AS bf FROM t)
SELECT device_id, n::INT AS n, coalesce(st, bf) AS type, CASE WHEN st IS NOT NULL THEN 'onset' ELSE 'recovery' END AS phase FROM b WHERE (st IS NOT NULL AND st IS DISTINCT FROM bf) OR (a IS NULL AND bf IS NOT NULL)""",
)
def confirmed(spark, sf):
    w = Window.partitionBy("device_id").orderBy("us", "report_id")
    a = F.when(F.col("roi_vehicles") % 5 < 2, None).when(F.col("roi_persons") < 30, "black_screen").otherwise("flower_screen")
    return liveness.confirmed(tables.reports(spark, sf).select("device_id", F.row_number().over(w).alias("n"), a.alias("anomaly")), 2)


@query("agg19_latency_percentiles", f"WITH {REPORTS} SELECT device_id, quantile_disc(v_flow, 0.95) AS p95, quantile_disc(v_flow, 0.99) AS p99 FROM rep GROUP BY device_id")
def latency(spark, sf):
    return liveness.percentiles(tables.reports(spark, sf), ["device_id"], "v_flow")


@query("flt01_camera_classes", f"WITH {OBS}, c AS (SELECT *, CASE substr(device_id, 5)::INT % 3 WHEN 0 THEN 'vehicle' WHEN 1 THEN 'person' ELSE 'any' END AS camera FROM obs) SELECT track_id, n FROM c WHERE CASE camera WHEN 'vehicle' THEN class_name IN ('car', 'truck', 'bus') WHEN 'person' THEN class_name IN ('person', 'bicycle', 'motorcycle') ELSE true END")
def classes(spark, sf):
    k = F.substring("device_id", 5, 3).cast("int") % 3
    return events.for_camera(tables.observations(spark, sf), F.when(k == 0, "vehicle").when(k == 1, "person").otherwise("any")).select("track_id", "n")


@query("flt02_coco_classes", "SELECT event_id, ['person', 'bicycle', 'car', 'motorcycle', NULL, 'bus', NULL, 'truck', NULL][event_id % 9 + 1] AS class_name, CASE WHEN event_id % 9 IN (0, 1, 3) THEN 'Person' WHEN event_id % 9 IN (2, 5, 7) THEN 'Vehicle' END AS stream FROM events WHERE event_id % 9 IN (0, 1, 2, 3, 5, 7)")
def coco(spark, sf):
    rows = tables.table(spark, sf, "events").select("event_id", events.class_of(F.col("event_id") % 9).alias("class_name")).where("class_name is not null")
    return rows.withColumn("stream", events.stream_of(F.col("class_name")))


@query("flt10_increasing_times", f"WITH {OBS}, t AS (SELECT track_id, n, CASE WHEN n % 7 = 0 THEN 'nan'::DOUBLE WHEN n % 5 = 0 THEN t - 1 ELSE t END AS t FROM obs), k AS (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY n) AS p FROM t WHERE NOT isnan(t)) SELECT track_id, n FROM k WHERE p IS NULL OR t > p")
def increasing(spark, sf):
    n = F.col("n")
    rows = tables.observations(spark, sf).select("track_id", "n", F.when(n % 7 == 0, float("nan")).when(n % 5 == 0, F.col("t") - 1).otherwise(F.col("t")).alias("t")).where(~F.isnan("t"))
    return rows.withColumn("p", F.lag("t").over(Window.partitionBy("track_id").orderBy("n"))).where("p is null or t > p").select("track_id", "n")


def _device_lines(n: int = 32):
    from flowspark.operators.crossing import Line

    return {f"cam-{i}": Line([(0.05, 0.45), (0.95, 0.55)], (0.5, 0.9), 1280, 720, [(0.0, 0.1), (0.9, 0.1), (0.9, 0.95), (0.0, 0.95)] if i % 2 else None, "enter" if i % 5 == 0 else None) for i in range(n)}


def _crossing_input(spark, sf):
    """Smoother tracks than the raw values: positions are means of the last five, in pixels, on a common clock."""
    w = Window.partitionBy("track_id").orderBy("n").rowsBetween(-4, 0)
    o = tables.observations(spark, sf)
    return o.select("device_id", F.col("track_id").cast("string").alias("track_id"), "class_name", (F.avg("x").over(w) * 1280).alias("x"), (F.avg("y").over(w) * 720).alias("y"), F.lit(40.0).alias("w"), F.lit(40.0).alias("h"), F.round("t", 3).alias("t_mono"), (F.round("t", 3) + 1_700_000_000).alias("t_wall"))


@query("cep_crossing_events")
def crossing_events(spark, sf):
    from flowspark.operators.crossing import Rules, crossings

    return crossings(_crossing_input(spark, sf), _device_lines(), Rules(hold_frames=1, min_motion=0.5))


@query("cep_reject_reasons")
def reject_reasons(spark, sf):
    from flowspark.operators.crossing import Rules, crossings

    return crossings(_crossing_input(spark, sf), _device_lines(), Rules(hold_frames=1, min_motion=0.5), rejected=True).groupBy("device_id", "reason").agg(F.count("*").alias("n"))


@query(
    "cep_planted_crossings",
    """WITH p AS (SELECT event_id AS e, 'cam-' || (event_id % 32)::VARCHAR AS device_id, 180.5 + event_id % 7 * 60 AS y, (CASE event_id % 2 WHEN 0 THEN 1 ELSE -1 END) * (20 + event_id % 5 * 8) AS v FROM events),
k AS (SELECT *, (360 - y) / v AS k FROM p)
SELECT device_id, e::VARCHAR AS track_id, (CASE WHEN e % 6 < 3 THEN 'Person' ELSE 'Vehicle' END) || (CASE WHEN v > 0 THEN 'Enter' ELSE 'Exit' END) AS event_type, CASE WHEN v > 0 THEN 'outer_to_inner' ELSE 'inner_to_outer' END AS direction,
  round(e // 32 * 10 + 0.2 * k, 3) AS t_cross, 200.0::DOUBLE + e % 10 * 90 AS x FROM k WHERE k > 0 AND k < 9 AND abs(v) * (9 - k) >= 20""",
)
def planted_crossings(spark, sf):
    """A straight track for each event, one after the other on each device, ten frames at five a second: what crosses is known."""
    from flowspark.operators.crossing import Line, Rules, crossings

    e, k = F.col("event_id"), F.col("k")
    tracks = tables.table(spark, sf, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    classes = F.array(*[F.lit(c) for c in ("person", "bicycle", "motorcycle", "car", "truck", "bus")])
    t = F.floor(e / 32) * 10 + k * 0.2
    y = 180.5 + e % 7 * 60 + k * F.when(e % 2 == 0, 1).otherwise(-1) * (20 + e % 5 * 8)
    seen = tracks.select(F.concat(F.lit("cam-"), (e % 32).cast("string")).alias("device_id"), e.cast("string").alias("track_id"), F.get(classes, (e % 6).cast("int")).alias("class_name"), (200.0 + e % 10 * 90).alias("x"), y.cast("double").alias("y"), F.lit(40.0).alias("w"), F.lit(40.0).alias("h"), t.alias("t_mono"), t.alias("t_wall"))
    lines = {f"cam-{i}": Line([(0.05, 0.5), (0.95, 0.5)], (0.5, 0.9), 1280, 720) for i in range(32)}
    found = crossings(seen, lines, Rules(hold_frames=1))
    return found.select("device_id", "track_id", "event_type", "direction", F.round("t_cross", 3).alias("t_cross"), "x")
