from __future__ import annotations

import datetime
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.functions import arrays, canonical, geometry, text, timing
from flowspark.operators import alerts, allocate, congestion, counters, delivery, enrich, events, flow, folds, forecast, frames, liveness, quantiles
from flowspark.sources import sinks, tables


def micros(seconds):
    return int(seconds * 1_000_000)


def facts(spark, kinds, device="cam-0"):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, device, k, t0 + datetime.timedelta(minutes=7 * i)) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "event_id long, device_id string, event_type string, occurred_at timestamp_ntz").withColumn("us", timing.micros("occurred_at"))


def test_counters(spark):
    df = facts(spark, ["PersonEnter", "PersonEnter", "PersonExit", "VehicleExit", "VehicleEnter"])
    assert counters.floored_total(df).where("stream = 'person'").first()["current"] == 1
    assert counters.floored_total(df).where("stream = 'vehicle'").first()["current"] == 1
    assert counters.device_current(df).first()["current_vehicles"] == 0  # the raw sum of -1 and 1
    day = counters.daily(df).first()
    assert (day["person_in"], day["person_out"], day["vehicle_in"], day["vehicle_out"]) == (2, 1, 1, 1)


def test_floored_count_equals_the_loop(spark):
    rng = random.Random(2)
    kinds = [rng.choice(("VehicleEnter", "VehicleExit", "PersonEnter", "PersonExit")) for _ in range(600)]
    got = {r["event_id"]: r["current"] for r in counters.floored_current(facts(spark, kinds)).collect()}
    now = {"V": 0, "P": 0}
    for i, k in enumerate(kinds):
        now[k[0]] = max(0, now[k[0]] + (1 if k.endswith("Enter") else -1))
        assert got[i] == now[k[0]]


def test_dedup_ignores_the_order_of_rows(spark):
    rows = [(i % 7 if i % 5 else None, i, f"d{i % 3}") for i in range(40)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted((str(r["event_id"]), r["arrival"]) for r in events.first_by_id(spark.createDataFrame(rows, "event_id long, arrival long, device_id string"), "event_id", "arrival").collect())
        assert want is None or got == want
        want = got
    assert len(want) == 7 + 8


def test_zone_and_bounds(spark):
    row = spark.sql("select timestamp_ntz'2026-01-01 16:30:00' as t").select(F.date_format(timing.in_zone("t", "Asia/Shanghai"), "yyyy-MM-dd").alias("d"), timing.minute_floor("t", 7).alias("b")).first()
    assert row["d"] == "2026-01-02" and row["b"] == "2026-01-01 16:28"
    assert timing.range_bound("2024-02-01", False) == ("2024-02-01", 0) and timing.range_bound("2024-02-01", True) == ("2024-02-01", 23)
    for bad in ("2024-13-01", "2024-01-01:24", "x"):
        with pytest.raises(ValueError):
            timing.range_bound(bad, False)


def test_sliding_flow(spark):
    df = spark.createDataFrame([("cam", "VehicleExit", micros(s)) for s in range(5)], "device_id string, event_type string, us long")
    asked = spark.createDataFrame([(t, "cam", micros(t)) for t in (4, 60, 61, 65)], "report_id long, device_id string, us long")
    assert {r["report_id"]: r["flow"] for r in flow.at_reports(df, asked).collect()} == {4: 5, 60: 5, 61: 4, 65: 0}


def test_congestion_score(spark):
    row = spark.createDataFrame([(1, "c", 12, 0, 2.0, 0.0, 10, 5.0, 0, 10.0, 0)], "report_id long, device_id string, roi_vehicles int, roi_persons int, v_flow double, p_flow double, max_vehicles int, min_v_flow double, max_persons int, min_p_flow double, us long")
    out = congestion.judge(row).first()
    assert abs(out["score"] - 0.8) < 1e-12 and out["congested"]


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_suppression_of_one_key_over_many_batches(spark, monkeypatch, size):
    """A key that never pauses, more rows than an Arrow batch holds, batches without an emission, equal times, null keys and times."""
    monkeypatch.setattr(alerts, "SLICE", 3)
    many = 25_000 if size > 100 else 900
    rows = [("a", micros(t // 2), 2**60 + t) for t in range(many)] + [(None, micros(t), t) for t in range(0, 90, 10)] + [("a", None, 1), ("a", None, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = alerts.suppressed(spark.createDataFrame(rows, "rule_id string, us long, n long"), ["rule_id"], 60).collect()
        dense = alerts.suppressed(spark.createDataFrame([("a", t, t) for t in range(many)], "rule_id string, us long, n long"), ["rule_id"], 1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    a = sorted((r["us"], r["n"]) for r in got if r["rule_id"] == "a" and r["us"] is not None)
    assert a == [(micros(t), 2**60 + 2 * t) for t in range(0, many // 2, 60)]
    assert sorted(r["us"] for r in got if r["rule_id"] is None) == [0, micros(60)]
    assert sum(r["us"] is None for r in got) == 2
    assert [(r["us"], r["n"]) for r in dense] == [(0, 0)]


@pytest.mark.parametrize("slice_", [1, 5])
def test_suppression_in_slices_equals_the_loop(spark, monkeypatch, slice_):
    """Periods that never meet, pauses over many slices, times before 1970, times at the edges of slices."""
    monkeypatch.setattr(alerts, "SLICE", slice_)
    rng = random.Random(slice_)
    rows = [("odd", micros(7 * k) + rng.randrange(3)) for k in range(-200, 400)]
    rows += [("rare", micros(rng.randrange(-50_000, 50_000))) for _ in range(60)]
    rows += [("edge", micros(60 * slice_ * k) + d) for k in range(-5, 30) for d in (-1, 0, 1)]
    rows += [("dense", rng.randrange(micros(700))) for _ in range(3000)]
    got = {k: [] for k, _ in rows}
    for r in alerts.suppressed(spark.createDataFrame(rows, "rule_id string, us long"), ["rule_id"], 60).collect():
        got[r["rule_id"]].append(r["us"])
    for key, found in got.items():
        last, want = None, []
        for us in sorted(u for k, u in rows if k == key):
            if last is None or us - last >= micros(60):
                last = us
                want.append(us)
        assert sorted(found) == want
    assert alerts.suppressed(spark.createDataFrame(rows[:3], "rule_id string, us long"), ["rule_id"], 0).count() == 3


def test_canonical_json_at_any_depth(spark):
    import hashlib
    import json

    texts = ['{"b":{"z":1,"a":[{"y":2.50,"x":1e5}]},"a":"\\u00e9 \\ud83d\\ude00"}', "[]", '"x"', "nope", '{"a":NaN}', "", None, '{"a":1,"a":2}', "[" * 5000, '{"ﬀ":1,"😀":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", canonical.canonical_json("t").alias("c")).collect()}
    form = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    assert got == {i: form(json.loads(t)) if i in (0, 1, 2, 7, 9) else None for i, t in enumerate(texts)}
    nested = spark.sql("select 1 as id, named_struct('z', 1, 'a', array(named_struct('k', null, 'b', 'x'))) as s, '{\"q\": 1, \"c\": {}}' as evidence")
    want = form({"event": {"id": 1, "s": {"z": 1, "a": [{"k": None, "b": "x"}]}}, "evidence": {"q": 1, "c": {}}})
    row = nested.select(canonical.event_body(["id", "s"], "evidence").alias("b"), canonical.event_digest(["s", "id"], "evidence").alias("d")).first()
    assert row["b"] == want and row["d"] == hashlib.sha256(want.encode()).hexdigest()


@pytest.mark.parametrize("few", [100_000, 4])
def test_quantiles_by_selection(spark, monkeypatch, few):
    """Against sorting: skewed values, equal ones, huge and infinite ones, a null key, nulls and NaNs left out."""
    monkeypatch.setattr(quantiles, "CELLS", 16 if few == 4 else 1024)
    rng = random.Random(few)
    groups = {
        "flat": [rng.uniform(-5, 5) for _ in range(300)],
        "skewed": [2.0 ** rng.randrange(-300, 300) for _ in range(200)] + [-1e308, 1e308],
        "equal": [7.0] * 50,
        "ends": [float("-inf")] * 9 + [0.0, -0.0, 1.0] * 5 + [float("inf")] * 9,
        "one": [3.0],
        None: [float(i % 11) for i in range(100)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("flat", None), ("flat", float("nan")), ("none", None)]
    rng.shuffle(rows)
    got = quantiles.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, ("p50",), few).collect()
    assert {r["k"] for r in got} == set(groups)
    for r in got:
        v = sorted(groups[r["k"]])
        n = len(v)
        rank = lambda p: v[max(1, math.ceil(n * p)) - 1]
        assert (r["p95"], r["p0"], r["p100"]) == (rank(0.95), v[0], v[-1])
        low, part = divmod((n - 1) * 0.5, 1)
        assert r["p50"] == (v[int(low)] if not part else v[int(low)] * 0.5 + v[int(low) + 1] * 0.5)


def test_movements_equal_the_loop(spark):
    rng = random.Random(8)
    rows = [(i, f"r{i}", rng.randrange(9) * 1.0, rng.randrange(9) * 1.0, rng.randrange(9), rng.randrange(9)) for i in range(9)]
    for limit in (0, 7, 100):
        spare = [o - t for *_, o, t in rows]
        left, want = limit, []
        for d, i, j in sorted((math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), a[0], b[0]) for a in rows for b in rows if a[4] > a[5] and b[4] < b[5]):
            n = min(spare[i], -spare[j], left)
            if n > 0:
                want.append((f"r{i}", f"r{j}", n, d))
                spare[i], spare[j], left = spare[i] - n, spare[j] + n, left - n
        plan = spark.createDataFrame(rows, "ordinal int, region string, center_x double, center_y double, officers int, target int")
        assert [tuple(r) for r in allocate.movements(plan, limit).collect()] == want
    assert allocate.movements(plan.limit(0), 5).count() == 0


@pytest.mark.parametrize("most", [100_000, 3])
def test_longest_contained_name(spark, most):
    """By the automaton and by joins alike: names within names, ties, nulls, empty texts and names, many names."""
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    names = [word(rng.randint(1, 5)) for _ in range(60)] + ["ab", "ba", "", None]
    texts = [word(rng.randint(0, 30)) for _ in range(200)] + [None, "", "zz", "xxabba"]
    points = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "i int, name string, short string")
    got = enrich.longest_contained(points, spark.createDataFrame([(n,) for n in names], "short string"), least=2, most=most)
    want = {i: min(((-len(n), n) for n in set(names) if n and len(n) >= 2 and t and n in t), default=(0, None))[1] for i, t in enumerate(texts)}
    assert {r["i"]: r["short"] for r in got.collect()} == want and any(want.values())
    assert enrich.longest_contained(points, spark.createDataFrame([], "short string")).where("short is not null").count() == 0


def test_trailing_counts_across_slices(spark):
    rng = random.Random(3)
    times = [rng.choice((0, 2, 64 * 2 * k, 64 * 2 * k - 2, rng.randrange(-300, 900))) for k in range(400)]
    df = spark.createDataFrame([(i, "c", "VehicleEnter", micros(t)) for i, t in enumerate(times)], "event_id long, device_id string, event_type string, us long")
    want = {i: sum(t - 2 <= u <= t for u in times) for i, t in enumerate(times)}
    assert {r["event_id"]: r["flow"] for r in flow.trailing(df, ["device_id"], 2).collect()} == want
    assert {r["event_id"]: round(r["v_in"] / 30) for r in flow.directional(df, 2).collect()} == want
    asked = df.select("device_id", "us", F.col("event_id").alias("report_id"))
    assert {r["report_id"]: r["flow"] for r in flow.at_reports(df, asked, 2).collect()} == want


def test_delivery_in_order_with_backoff(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([], delivery.LOG).write.parquet(log)
    outbox = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "event_id long, device_id string")

    def down(rows):
        raise ConnectionError

    sends = [lambda rows: [i not in (3, 5) for i in rows["event_id"]]] * 2 + [lambda rows: [True] * len(rows), down] + [lambda rows: [True] * len(rows)] * 3
    heads = []
    for second, send in enumerate(sends):
        heads.append(sorted(r["event_id"] for r in delivery.due_heads(outbox, spark.read.parquet(log), micros(second)).collect()))
        delivery.deliver(outbox, log, send, micros(second))
    assert heads == [[1, 3, 5], [2], [3, 5], [4], [], [4], []]
    assert [(r["event_id"], r["error"]) for r in spark.read.schema(delivery.LOG).parquet(log).where("error is not null").collect()] == [(4, "ConnectionError()")]


def test_forecast_by_model_falls_back(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([4, 4, 4],), ([],)], "h array<long>").repartition(1)
    mean = forecast.by_model(lambda hs: np.array([[sum(h) - 10, sum(h), sum(h) + 4] for h in hs]))
    assert sorted(r[0] for r in rows.select(mean(F.col("h"))).collect()) == [0.0, 4.0, 10.0]

    def broken(hs):
        raise MemoryError

    assert sorted(r[0] for r in rows.select(forecast.by_model(broken)(F.col("h"))).collect()) == [0.0, 4.0, 4.0]


def test_suppression_is_greedy(spark):
    rng = random.Random(1)
    rows = [(f"r{rng.randrange(3)}", micros(rng.randrange(100_000))) for _ in range(400)]
    got = sorted((r["rule_id"], r["us"]) for r in alerts.suppressed(spark.createDataFrame(rows, "rule_id string, us long").distinct(), ["rule_id"], 300).collect())
    last, want = {}, []
    for us, rule in sorted({(u, r) for r, u in rows}):
        if rule not in last or us - last[rule] >= micros(300):
            last[rule] = us
            want.append((rule, us))
    assert got == sorted(want)


def test_coverage_gap(spark):
    rows = [("d", "e1", "processing", 100), ("d", "e2", "waiting_first_frame", 130), ("d", "e2", "processing", 135)]
    out = liveness.coverage_gaps(spark.createDataFrame(rows, "device_id string, stream_epoch string, state string, observed long")).collect()
    assert [(r["start"], r["end"], r["reason"]) for r in out] == [(100, 135, "waiting_first_frame")]


def test_allocation(spark):
    def split(demands, total, least):
        rows = spark.createDataFrame([(i, float(d)) for i, d in enumerate(demands)], "ordinal long, demand double")
        return [r["target"] for r in allocate.targets(rows, total, least).orderBy("ordinal").collect()]

    assert split([30, 10], 10, 1) == [7, 3]
    assert split([5, 1, 9], 2, 1) == [1, 0, 1] and split([0, 0, 0], 7, 1) == [3, 2, 2]
    for s in range(12):
        rng = random.Random(s)
        out = split([rng.random() for _ in range(5)], 17 + s, 2)
        assert sum(out) == 17 + s and min(out) >= 2
    plan = spark.createDataFrame([(0, "a", 0.0, 0.0, 9, 1.0, 5), (1, "b", 1.0, 0.0, 1, 1.0, 4), (2, "c", 5.0, 0.0, 1, 1.0, 2)], "ordinal long, region string, center_x double, center_y double, officers int, demand double, target int")
    moves = [(r["from_region"], r["to_region"], r["count"]) for r in allocate.movements(plan, 10).collect()]
    assert moves == [("a", "b", 3), ("a", "c", 1)]
    assert [r["count"] for r in allocate.movements(plan, 2).collect()] == [2]
    assert 0 < allocate.scores(plan, allocate.movements(plan, 10), 11).first()["score"] <= 1


def test_forecast(spark):
    row = spark.sql("select array(1,2,3) as h, array(9,1) as d, array(5) as o, cast(array() as array<int>) as e")
    out = row.select(*[forecast.trend(F.col(c)).alias(c) for c in "hdoe"]).first()
    assert (out["h"], out["d"], out["o"], out["e"]) == (4.0, 0.0, 5.0, 0.0)
    n = row.select(forecast.converted(F.col("h")).alias("c")).first()["c"]
    assert all(2 * k <= v <= 5 * k for k, v in zip((1, 2, 3), n, strict=True))


def test_text_functions(spark):
    row = spark.createDataFrame([("广场出入口便道", "rtsp://10.0.0.1/a/b?c=1", "1, 2,x", "1,2,3")], "c string, u string, bad string, good string")
    out = row.select(text.entrance_type(F.col("c")).alias("e"), text.play_url(F.col("u"), "http://h/").alias("p"), text.coordinates(F.col("bad"), 3).alias("b"), text.coordinates(F.col("good"), 3).alias("g"), text.swap_host(F.col("u"), "x:1").alias("s")).first()
    assert (out["e"], out["p"], out["b"], out["g"], out["s"]) == ("出入口", "http://h/a/b?c=1/index.m3u8", None, [1.0, 2.0, 3.0], "rtsp://x:1/a/b?c=1")


def test_array_functions(spark):
    row = spark.createDataFrame([([" A", "B", "A", None], [1.0, 2.0], 0.0005, "{bad")], "l array<string>, s array<double>, v double, j string")
    a, b = arrays.with_forecast(F.col("s"), F.lit(9.0))
    out = row.select(arrays.lane_range(F.col("l"), "A", F.lit(4)).alias("a"), arrays.lane_range(F.col("l"), "cam B", F.lit(5)).alias("h"), a.alias("x"), b.alias("y"), arrays.half_even(F.col("v"), 3).alias("r"), arrays.tolerant_json(F.col("j"), "k int")["k"].alias("j")).first()
    assert (out["a"], out["h"], out["x"], out["y"], out["j"]) == ("1-3", "3-5", [1.0, 2.0, None], [None, None, 9.0], None)
    assert out["r"] == round(0.0005, 3)


def test_enrichment_edges(spark):
    dim = spark.createDataFrame([("abc1",), ("abd",), ("abd",)], "full string").distinct()
    short = spark.createDataFrame([("abc",), ("ab",), ("abd",), ("",)], "key string")
    assert {r["key"]: r["full"] for r in enrich.unique_prefix(short, dim).collect()} == {"abc": "abc1", "ab": None, "abd": "abd", "": None}
    regions = spark.createDataFrame([(0, "a", 0.0, 0.0), (1, "b", 2.0, 0.0)], "ordinal long, region string, center_x double, center_y double")
    points = spark.createDataFrame([(1.0, 0.0), (1.1, 0.0)], "longitude double, latitude double")
    assert [r["nearest"] for r in enrich.nearest(points, regions).orderBy("longitude").collect()] == ["a", "b"]


def test_longest_prefix_with_an_alias_that_many_share(spark):
    """Keys and equal aliases in numbers: the join must not hold their product."""
    n = 6000
    names = spark.range(n).select(F.concat(F.lit("gate"), F.format_string("%05d", "id"), F.lit("-tail")).alias("key"))
    aliases = spark.range(n).select(F.lit("gate ").alias("alias")).union(spark.createDataFrame([("gate00001",), ("ga te00002",), ("gate00002",)], "alias string"))
    began = time.monotonic()
    out = {r["key"]: r["alias"] for r in enrich.longest_prefix(names, aliases).collect()}
    assert time.monotonic() - began < 20
    assert len(out) == n and {k: v for k, v in out.items() if v is not None} == {"gate00001-tail": "gate00001"}


def test_polygon_column_equals_the_function(spark):
    ring = [(0.2, 0.1), (0.8, 0.1), (0.8, 0.3), (0.5, 0.3), (0.5, 0.6), (0.2, 0.6)]
    rng = random.Random(5)
    points = [(rng.random(), rng.random()) for _ in range(300)] + [(0.2, 0.3), (0.5, 0.45), (0.8, 0.1), (0.9, 0.1)]
    col = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
    out = spark.createDataFrame(points, "x double, y double").select("x", "y", geometry.in_polygon((F.col("x"), F.col("y")), col).alias("i")).collect()
    assert all(r["i"] == geometry.point_in_ring((r["x"], r["y"]), ring) for r in out)


def test_frames(spark):
    rng = np.random.default_rng(1)
    black = np.zeros((48, 64, 3), np.uint8)
    noise = rng.integers(0, 256, (48, 64, 3), dtype=np.uint8)
    scene = np.repeat(np.tile(np.linspace(40, 200, 64).astype(np.uint8), (48, 1))[:, :, None], 3, 2)
    rows = [("d", i, 64, 48, bytearray(p.tobytes())) for i, p in enumerate((black, scene, noise, scene))] + [("d", 9, 0, 0, None)]
    out = frames.anomalies(spark.createDataFrame(rows, "device_id string, n long, width int, height int, pixels binary")).orderBy("n").collect()
    assert [r["anomaly"] for r in out] == ["black_screen", None, "flower_screen", None, None]
    runs = spark.createDataFrame([("d", i, a) for i, a in enumerate([None, "b", "b", "b", "f", None, "b", None])], "device_id string, n long, anomaly string")
    assert [(r["n"], r["type"], r["phase"]) for r in liveness.confirmed(runs, 3).orderBy("n").collect()] == [(3, "b", "onset"), (4, "f", "onset"), (5, "f", "recovery")]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_frames_decided_by_the_change(spark, monkeypatch, broadcast):
    """Grey noise is only found by its change from the last whole frame of the device; twins, gaps and other sizes included."""
    monkeypatch.setattr(frames, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(2)
    grey = lambda w=64: np.repeat(rng.integers(0, 256, (48, w, 1), dtype=np.uint8), 3, 2)
    same = grey()
    plain = np.full((48, 64, 3), 127, np.uint8)
    pictures = [("a", 0, same), ("a", 1, same), ("a", 3, grey()), ("a", 4, grey(32)), ("b", 0, plain), ("b", 1, same), ("b", 2, same), (None, 1, same), (None, 2, grey())]
    rows = [(d, n, p.shape[1], 48, bytearray(p.tobytes())) for d, n, p in pictures] + [("a", 2, 64, 48, bytearray(5)), ("b", 3, None, None, None)]
    made = spark.createDataFrame(rows, "device_id string, n long, width int, height int, pixels binary").repartition(3)
    out = {(r["device_id"], r["n"]): r["anomaly"] for r in frames.anomalies(made).collect()}
    last, want = {}, {}
    for d, n, p in sorted(pictures, key=lambda r: (r[0] or "", r[1])):
        want[d, n], _, last[d] = frames.measures(p, last.get(d), frames.Limits())
    assert out == want | {("a", 2): None, ("b", 3): None}
    assert want["a", 3] == want["b", 1] == want[None, 2] == "flower_screen" and want["a", 1] is want["b", 2] is None


def test_frames_decided_alone_send_no_pictures(spark):
    """Plain and coloured frames: the plan of the result shuffles nothing."""
    pixels = F.unhex(F.repeat(F.lit("7f7f7f"), 64 * 48))
    made = spark.range(20).select(F.lit("d").alias("device_id"), F.col("id").alias("n"), F.lit(64).alias("width"), F.lit(48).alias("height"), pixels.alias("pixels"))
    out = frames.anomalies(made)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 20


def test_stream_headers(spark, tmp_path):
    pts = 3600
    head = bytes([0x21 | (pts >> 30 & 7) << 1, pts >> 22 & 255, (pts >> 15 & 127) << 1 | 1, pts >> 7 & 255, (pts & 127) << 1 | 1])
    data = b"\x00\x00\x01\xba\x44" + bytes(9) + b"\x00\x00\x01\xbc\x00" + b"\x00\x00\x01\xe0\x00\x10\x80\x80\x05" + head + bytes(20)
    (tmp_path / "a.ps").write_bytes(data)
    row = frames.scan_streams(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert (row["packs"], row["maps"], row["video"], row["version"], row["times"]) == (1, 1, 1, "MPEG-2", [3600])


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "archive")
    schema = "device_id string, hour int, vehicle_in long, stat_date string"
    sinks.merge_hours(spark.createDataFrame([("a", 1, 1, "2024-01-01"), ("a", 2, 1, "2024-01-02")], schema), path)
    for _ in range(2):
        sinks.merge_hours(spark.createDataFrame([("a", 1, 5, "2024-01-01"), ("b", 1, 7, "2024-01-01")], schema), path)
    rows = sorted((r["device_id"], str(r["stat_date"]), r["hour"], r["vehicle_in"]) for r in spark.read.parquet(path).collect())
    assert rows == [("a", "2024-01-01", 1, 5), ("a", "2024-01-02", 2, 1), ("b", "2024-01-01", 1, 7)]
    assert sinks.drop_before(path, spark.range(1), "2024-01-02") == ["2024-01-01"] and spark.read.parquet(path).count() == 1
    dim = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "name string, v int, w string")
    out = sinks.upserted(dim, spark.createDataFrame([("a", None, "z"), ("c", 3, None)], "name string, v int, w string"), "name")
    assert sorted(map(tuple, out.collect())) == [("a", 1, "z"), ("b", 2, "y"), ("c", 3, None)]
    assert sinks.deleted(dim, dim.where("v = 1"), "name").count() == 1
    assert sinks.newest(dim, "v", 0).count() == 0 and sinks.newest(dim, "v", 1).first()["name"] == "b"
    sinks.replace_table(dim, str(tmp_path / "t"))
    sinks.replace_table(dim.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.append_capped(dim, str(tmp_path / "t"))
    sinks.write_report(str(tmp_path / "r"), dim, dim, alarms=dim.limit(1), trace=dim)
    assert [spark.read.json(f"{tmp_path}/r/{n}").count() for n in ("events", "alarms", "trace")] == [2, 1, 2]


def test_readers(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"event_id":"1","device_id":"d","event_type":"VehicleEnter","occurred_at":"2024-01-01T00:00:00Z","evidence":"{}"}\nnot json\n')
    rows = tables.read_events_json(spark, str(tmp_path / "e.json")).collect()
    assert [r["event_id"] for r in rows] == ["1", None] and rows[1]["corrupt"] == "not json"
    (tmp_path / "p.csv").write_text("name,category,longitude,latitude,status\na,b,1.5,2,ok\n")
    assert tables.read_points_csv(spark, str(tmp_path / "p.csv")).first()["longitude"] == 1.5
    (tmp_path / "s.json").write_text('{"_meta": {"category": "x"}, "n1": {"category": "c", "point_id": "p"}}')
    assert [r["name"] for r in tables.read_seed_json(spark, str(tmp_path / "s.json")).collect()] == ["n1"]
    (tmp_path / "l.log").write_text("one\r\ntwo\n\nfour\n")
    assert [(r["line_no"], r["value"]) for r in tables.read_log(spark, str(tmp_path / "l.log")).orderBy("line_no").collect()] == [(1, "one"), (2, "two"), (4, "four")]
    (tmp_path / "r.json").write_text('{"rules": []}')
    assert tables.read_rules(str(tmp_path / "r.json")) == {"rules": []}
    items = [{"id": str(i)} for i in range(5)]
    page = lambda p, n: {"total": 5, "list": items[(p - 1) * n : p * n]}
    assert len(tables.paged(page, 2)) == 5
    with pytest.raises(ValueError):
        tables.paged(lambda p, n: {"total": 5, "list": items[:n]}, 2)
    assert tables.synthetic_events(spark, 8, 24, [2.0] * 24, 1.0).count() == pytest.approx(384, rel=0.2)


def test_fold_gets_whole_units_and_one_state_a_key(spark):
    """Units that Arrow batches cut arrive in one call; the state starts anew with each key."""
    rng = random.Random(5)
    rows = [(rng.choice(("a", "b", None)), rng.randrange(12)) for _ in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:

        def fold(key, part, seen):
            units = part["u"].to_pylist()
            assert not set(units) & (seen or set()) and units == sorted(units)
            return part.group_by(["k", "u"]).aggregate([("u", "count")]).select(["k", "u", "u_count"]), (seen or set()) | set(units)

        got = folds.fold_sorted(spark.createDataFrame(rows, "k string, u long"), ["k"], ["u"], fold, "k string, u long, n long", together="u").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r[0], r[1]): r[2] for r in got} == {x: rows.count(x) for x in rows} and len(got) == len(set(rows))
