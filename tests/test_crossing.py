from __future__ import annotations

import math
import random
import time

import pandas as pd
import pytest

from flowspark.functions.geometry import clip_intervals, point_in_ring, validate
from flowspark.operators.crossing import OBSERVED, Device, Line, Rules, Seen, crossings, frames, run_device, step

LINE, ANCHOR = [(0.1, 0.5), (0.9, 0.5)], (0.5, 0.9)


def line(**k):
    return Line(LINE, ANCHOR, 1280, 720, **k)


#: At a frame a second the paths are slower than the default least speed.
SLOW = Rules(min_motion=0.5)


def run(path, dt=1.0, kind="car", rules=SLOW, dev=None, start=0.0, where=None, tid="1", size=40.0):
    dev = dev or Device()
    events = []
    for i, p in enumerate(path):
        x, y = p if isinstance(p, tuple) else (640.0, float(p))
        now = start + (i + 1) * dt
        got, _ = step(dev, [Seen(tid, kind, x, y, size, size)], where or line(), now, 1000 + now, rules)
        events += got
    return events, dev


ENTER, EXIT = (300, 330, 370, 400, 430, 460), (420, 390, 350, 320, 290, 260)


def test_enter_and_exit():
    (e,), _ = run(ENTER)
    assert e["event_type"] == "VehicleEnter" and e["direction"] == "outer_to_inner" and abs(e["y"] - 360) < 1e-9
    (e,), _ = run(EXIT)
    assert e["event_type"] == "VehicleExit" and e["direction"] == "inner_to_outer"


@pytest.mark.parametrize("kind, stream", [("truck", "Vehicle"), ("bus", "Vehicle"), ("bicycle", "Person"), ("motorcycle", "Person"), ("person", "Person")])
def test_classes(kind, stream):
    assert [e["event_type"] for e in run(ENTER, kind=kind)[0]] == [f"{stream}Enter"]


def test_unknown_class_is_refused():
    assert run(ENTER, kind="dog")[0] == []


@pytest.mark.parametrize(
    "path, dt, n",
    [
        ((300, 320, 310, 330, 300, 320), 1.0, 0),
        ((355, 365, 355, 365, 358, 362, 355, 365), 1.0, 0),
        ((300, 330, 370, 400, 430), 0.04, 0),
        ((300, 330, 360, 390, 420, 450), 1 / 25, 1),
        ((330, 370, 400, 430), 0.2, 1),
        ((340, 334, 328, 322, 420), 0.04, 0),
    ],
)
def test_paths(path, dt, n):
    rules = Rules(hold_frames=3 if n == 0 else 1, min_motion=0.5)
    assert len(run(path, dt, rules=rules)[0]) == n


def test_slow_and_accelerating_objects():
    slow = tuple(range(350, 395, 5))
    assert len(run(slow, 0.2, rules=Rules(hold_frames=1, min_motion=0.5, min_distance_ratio=0.005))[0]) == 1
    assert len(run((250, 260, 272, 287, 312, 372, 462, 572, 682), 0.04, rules=Rules(hold_frames=1))[0]) == 1


def test_repeats_and_returns():
    events, dev = run(ENTER)
    more, dev = run((330, 300), dev=dev, start=6)
    again, _ = run(ENTER, dev=dev, start=8, rules=Rules(reverse_cooldown=0, min_motion=0.5))
    assert len(events) == 1 and again == []
    both, _ = run((*ENTER, *EXIT), 2.0)
    assert [e["event_type"] for e in both] == ["VehicleEnter", "VehicleExit"]
    cool, _ = run((*ENTER, *EXIT), 0.4)
    assert [e["event_type"] for e in cool] == ["VehicleEnter"]


def test_one_way_and_regions():
    assert run(EXIT, where=line(count_only="enter"))[0] == []
    left, middle = [(0, 0), (0.4, 0), (0.4, 1), (0, 1)], [(0.3, 0), (0.8, 0), (0.8, 1), (0.3, 1)]
    assert run(ENTER, where=line(ring=left))[0] == [] and len(run(ENTER, where=line(ring=middle))[0]) == 1
    above = [(0, 0), (1, 0), (1, 0.4), (0, 0.4)]
    assert line(ring=above).stretches == [] and run(ENTER, where=line(ring=above))[0] == []


def test_leaving_the_region_while_confirming():
    ring = [(0, 0.4), (1, 0.4), (1, 0.53), (0, 0.53)]
    assert len(run((320, 340, 365, 380, 400, 420), 0.04, where=line(ring=ring), rules=Rules(hold_frames=1))[0]) == 1


def test_diagonal_at_the_lines_end():
    (e,), _ = run([(1070.0, 350.0), (1175.0, 365.0), (1225.0, 380.0), (1275.0, 395.0), (1275.0, 410.0)], 0.2, rules=Rules(hold_frames=1, endpoint_sensitivity=0.02))
    assert abs(e["x"] - 1140) < 1 and abs(e["y"] - 360) < 1e-6


@pytest.mark.parametrize("fps", [2, 3, 6, 8, 12, 25])
def test_frame_rates_count_alike(fps):
    path = [(640.0, 200 + 100 * i / fps) for i in range(int(3.5 * fps))]
    assert len(run(path, 1 / fps, rules=Rules())[0]) == 1


def test_interpolated_time():
    vertical = Line([(0.5, 0.1), (0.5, 0.9)], (0.9, 0.5), 1000, 1000)
    dev, events = Device(), []
    for now, wall, x in ((0.0, 3599.4, 440), (0.4, 3599.8, 480), (0.8, 3600.2, 520), (1.2, 3600.6, 560), (1.6, 3601.0, 600)):
        events += step(dev, [Seen("1", "car", x, 500)], vertical, now, wall, Rules())[0]
    assert len(events) == 1 and abs(events[0]["t_cross"] - 3600.0) < 1e-9


def test_long_gaps_start_anew():
    dev = Device()
    step(dev, [Seen("1", "car", 640, 340)], line(), 1.0, 1.0, Rules())
    assert step(dev, [Seen("1", "car", 640, 400)], line(), 12.0, 12.0, Rules())[0] == []
    assert len(dev.tracks["1"].points) == 1


def test_stitching():
    for gap, points in ((0.2, 4), (0.6, 1)):
        dev = Device()
        for i, y in enumerate((400, 410, 420)):
            step(dev, [Seen("1", "car", 640, y)], line(), 0.1 * (i + 1), 0, Rules())
        step(dev, [], line(), 0.35, 0, Rules())
        step(dev, [Seen("2", "car", 640, 440)], line(), 0.3 + gap if gap > 0.2 else 0.5, 0, Rules())
        assert len(dev.tracks["2"].points) == points


def test_precision_and_recall():
    rng = random.Random(1)
    dev, events, now = Device(), [], 0.0
    paths = {f"e{i}": ("enter", rng.uniform(200, 1000)) for i in range(10)} | {f"x{i}": ("exit", rng.uniform(200, 1000)) for i in range(5)}
    for k in range(8):
        now += 2.0
        frame = [Seen(t, "car", x, (280 + 30 * k) if way == "enter" else (440 - 30 * k)) for t, (way, x) in paths.items()]
        events += step(dev, frame, line(), now, now, SLOW)[0]
    assert sum(e["event_type"] == "VehicleEnter" for e in events) == 10 and sum(e["event_type"] == "VehicleExit" for e in events) == 5


def test_state_survives_a_dump():
    rows = [(640.0, float(y)) for y in ENTER]
    dev, events = Device(), []
    for i, (x, y) in enumerate(rows):
        dev = Device.loads(dev.dumps())
        events += step(dev, [Seen("1", "car", x, y)], line(), i + 1.0, i + 1.0, SLOW)[0]
    assert len(events) == 1 and events[0]["event_type"] == "VehicleEnter"


def test_times_must_rise():
    dev = Device()
    step(dev, [], line(), 1.0, 1.0, Rules())
    for now in (1.0, 0.5, math.nan):
        with pytest.raises(ValueError):
            step(dev, [], line(), now, 1.0, Rules())


def test_geometry():
    u = [(0.1, 0.2), (0.9, 0.2), (0.9, 0.8), (0.65, 0.8), (0.65, 0.4), (0.25, 0.4), (0.25, 0.8), (0.1, 0.8)]
    got = clip_intervals((0.0, 0.5), (1.0, 0.5), u)
    assert [(round(a, 2), round(b, 2)) for a, b in got] == [(0.1, 0.25), (0.65, 0.9)]
    good = [(0.1, 0.5), (0.9, 0.5)]
    validate(good, (0.5, 0.9), u)
    bad = [
        ([(math.nan, 0.5), (0.9, 0.5)], (0.5, 0.9), None),
        ([(0.1, 0.5), (0.1, 0.5)], (0.5, 0.9), None),
        (good, (0.5, 0.5), None),
        (good, (0.5, 0.9), [(0.1, 0.1), (0.2, 0.2)]),
        (good, (0.5, 0.9), [(0.1, 0.1), (0.9, 0.9), (0.9, 0.1), (0.1, 0.9)]),
        (good, (0.5, 0.9), [(0.1, 0.1), (0.9, 0.1), (0.9, 0.3)]),
    ]
    for case in bad:
        with pytest.raises(ValueError):
            validate(*case)


def test_stretches_of_lines_in_rings():
    """Against points along the line: rings with corners and edges on it, concave ones, lines that only touch."""
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(3, 9)
        turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(4 + round(r * math.cos(u)), 4 + round(r * math.sin(u))) for u, r in ((u, rng.uniform(1, 4)) for u in turn)]
        if abs(sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(n))) < 1e-9:
            continue
        a, b = ((rng.randint(0, 8), rng.randint(0, 8)) for _ in range(2))
        got = clip_intervals(a, b, ring)
        assert all(0 <= x < y <= 1 for x, y in got) and all(y < x for (_, y), (x, _) in zip(got, got[1:], strict=False))
        if a == b:
            assert got == []
            continue
        for k in range(199):
            t = (k + 0.3719) / 199  # no corner lies there
            p = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
            near_end = any(abs(t - e) < 1e-6 for i in got for e in i)
            assert near_end or any(x <= t <= y for x, y in got) == point_in_ring(p, ring), (a, b, ring, t)
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert clip_intervals((-1.0, 1.0), (2.0, 1.0), square) == [(1 / 3, 2 / 3)]
    assert clip_intervals((-1.0, 1.0), (1.0, 3.0), square) == []
    assert clip_intervals((0.5, 0.5), (0.5, 0.5), square) == []


def observed(seed=3, devices=3, tracks=12):
    rng = random.Random(seed)
    rows = []
    for d in range(devices):
        for t in range(tracks):
            y, x, v, t0 = rng.uniform(200, 500), rng.uniform(200, 1000), rng.choice((-1, 1)) * rng.uniform(20, 120), rng.randrange(20)
            for k in range(25):
                rows.append((f"cam-{d}", str(t), rng.choice(("car", "person")) if k == 0 else rows[-1][2], x + rng.uniform(-2, 2), y + v * k * 0.2, 40.0, 40.0, round((t0 + k) * 0.2, 3), 1000 + round((t0 + k) * 0.2, 3)))
    return pd.DataFrame(rows, columns=list(OBSERVED))


def test_batch_equals_the_fold(spark):
    rows = observed()
    lines = {f"cam-{d}": line() for d in range(2)}
    df = spark.createDataFrame(rows)
    got = sorted((r["device_id"], r["track_id"], r["event_type"], round(r["t_cross"], 6)) for r in crossings(df, lines).collect())
    want = []
    for d, part in rows[rows.device_id != "cam-2"].groupby("device_id"):
        want += [(e[0], e[1], e[2], round(e[4], 6)) for e in run_device(Device(), part, lines[d], Rules())[0]]
    assert got == sorted(want) and len(got) > 5
    assert crossings(df, lines, rejected=True).count() > 0


@pytest.mark.parametrize("slice_s, warm", [(5.0, None), (2.0, 0.0), (1.5, 0.4)])
def test_slices_of_a_busy_camera_equal_one_fold(spark, slice_s, warm):
    """A camera without pauses, in slices; with too short a warm-up they are folded again until they follow from each other."""
    rules = Rules(hold_frames=1, min_motion=0.5, counted_ttl=3.0, history=6, longest_gap=0.7, idle=1.0, dedup_window=2.0)
    rows = pd.concat([observed(seed, 2, 6).assign(track_id=lambda d, s=seed: d.track_id + f"-{s % 3}", t_mono=lambda d, s=seed: d.t_mono + 3.8 * s, t_wall=lambda d, s=seed: d.t_wall + 3.8 * s) for seed in range(6)])
    rows = pd.concat([rows, rows.head(3).assign(t_mono=[math.nan, math.inf, 1.0], t_wall=[1.0, 1.0, math.nan])]).sample(frac=1, random_state=1)
    lines = {f"cam-{d}": line() for d in range(2)}
    for rejected in (False, True):
        want = sorted(str(r) for _, part in rows.groupby("device_id") for r in run_device(Device(), part, line(), rules)[rejected])
        got = sorted(str(tuple(r)) for r in crossings(spark.createDataFrame(rows), lines, rules, rejected, slice_s, warm).collect())
        assert got == want and len(got) > 20


def test_frames_cost_little_each():
    """One track a frame, as on a quiet road: a frame costs microseconds, not a group of a table."""
    n = 20_000
    rows = pd.DataFrame({"device_id": "d", "track_id": [str(i // 10) for i in range(n)], "class_name": "car", "x": 1.0, "y": 2.0, "w": 40.0, "h": 40.0, "t_mono": [n - i * 0.2 for i in range(n)], "t_wall": 5.0})
    again = pd.DataFrame([("d", "a", "bus", 9.0, 9.0, 40.0, 40.0, float(n), 7.0), ("d", "0", "bus", 9.0, 9.0, 40.0, 40.0, float(n), 6.0), ("d", "b", "bus", 9.0, 9.0, 40.0, 40.0, math.nan, 6.0), ("d", "b", "bus", 9.0, 9.0, 40.0, 40.0, 0.0, math.inf)], columns=list(OBSERVED))
    began = time.process_time()
    found = list(frames(pd.concat([rows, again], ignore_index=True)))
    assert time.process_time() - began < 5
    assert len(found) == n and [f[0] for f in found] == sorted(f[0] for f in found)
    assert found[-1] == (float(n), 5.0, [Seen("0", "car", 1.0, 2.0), Seen("a", "bus", 9.0, 9.0)])
