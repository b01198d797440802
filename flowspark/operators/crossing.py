"""Line crossings of tracks: one step function for a device's frame, used in batch and in streams.

All tracks of a device share its state, since a new track may continue a vanished one. A frame is a list of
observations at one time. ``step`` moves each track on - history, gaps, continuation - and then asks, in a fixed order,
whether it has crossed the counting line and stays across; each refusal has a name.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowspark.functions.geometry import clip_intervals, point_in_ring
from flowspark.operators.folds import fold_sorted
from flowspark.sources.saved import saved

PERSONS, VEHICLES = ("person", "bicycle", "motorcycle"), ("car", "truck", "bus")
EVENTS = "device_id string, track_id string, event_type string, direction string, t_cross double, x double, y double"
REJECTS = "device_id string, track_id string, t_mono double, reason string"


@dataclass(frozen=True)
class Rules:
    """Thresholds; pixels and seconds. Frames count at 25 a second."""

    hold_frames: int = 3
    min_distance_ratio: float = 0.02
    hysteresis_ratio: float = 0.04
    min_motion: float = 2.0
    endpoint_sensitivity: float = 0.05
    reverse_cooldown: float = 3.0
    dedup_window: float = 10.0
    dedup_distance: float = 60.0
    speed_ratio: float = 3.0
    least_excess: float = 30.0
    excess_share: float = 0.3
    least_average: float = 5.0
    direction_cosine: float = 0.5
    direction_window: int = 5
    longest_gap: float = 2.4
    stitch_gap: float = 0.48
    stitch_jump: float = 2.0
    stitch_cosine: float = 0.5
    history: int = 30
    idle: float = 20.0
    counted_ttl: float = 300.0
    base_fps: float = 25.0


class Line:
    """The counting line of a device in pixels: inner normal, valid stretches, region."""

    def __init__(self, line, anchor, width: int, height: int, ring=None, count_only: str | None = None):
        px = lambda p: (p[0] * width, p[1] * height)
        self.a, self.b, self.size = px(line[0]), px(line[1]), (width, height)
        self.dx, self.dy = self.b[0] - self.a[0], self.b[1] - self.a[1]
        self.length = math.hypot(self.dx, self.dy)
        self.n = (-self.dy, self.dx)
        if self.offset(px(anchor)) < 0:
            self.n = (self.dy, -self.dx)
        self.ring = [px(p) for p in ring or []]
        self.stretches = clip_intervals(self.a, self.b, self.ring)
        self.count_only = count_only

    def offset(self, p) -> float:
        """Distance to the line times its length, positive inside."""
        return (p[0] - self.a[0]) * self.n[0] + (p[1] - self.a[1]) * self.n[1]

    def distance(self, p) -> float:
        t = min(1.0, max(0.0, self.foot(p)))
        return math.hypot(p[0] - self.a[0] - t * self.dx, p[1] - self.a[1] - t * self.dy)

    def foot(self, p) -> float:
        return ((p[0] - self.a[0]) * self.dx + (p[1] - self.a[1]) * self.dy) / self.length**2

    def in_region(self, p) -> bool:
        return not self.ring or point_in_ring(p, self.ring)

    def speed_across(self, p, q, dt: float) -> float:
        return abs((q[0] - p[0]) * self.n[0] + (q[1] - p[1]) * self.n[1]) / self.length / dt

    def met(self, p, q):
        """Where the move from p to q meets a valid stretch of the line, or None. A move that ends on it doesn't yet."""
        o, c = self.offset(p), self.offset(q)
        if c == 0 or o * c > 0:
            return None
        s = min(1.0, max(0.0, o / (o - c)))
        x = (p[0] + s * (q[0] - p[0]), p[1] + s * (q[1] - p[1]))
        t = self.foot(x)
        return x if any(lo - 1e-9 <= t <= hi + 1e-9 for lo, hi in self.stretches) else None


@dataclass
class Track:
    """What is known of one track."""

    kind: str
    points: list = field(default_factory=list)
    times: list = field(default_factory=list)
    crossing: bool = False
    start: list | None = None
    cross: list | None = None
    cross_wall: float | None = None
    side: int = 0
    held: float = 0.0
    last_crossing: float | None = None

    def quiet(self) -> None:
        """Forget a crossing that isn't confirmed."""
        self.crossing, self.start, self.cross, self.cross_wall, self.side, self.held = False, None, None, None, 0, 0.0


@dataclass
class Device:
    tracks: dict = field(default_factory=dict)
    #: (track, way) -> [time, point]: the last counted crossing.
    counted: dict = field(default_factory=dict)
    seen: list = field(default_factory=list)
    clock: float | None = None

    def dumps(self) -> str:
        return json.dumps({"tracks": {k: asdict(t) for k, t in self.tracks.items()}, "counted": [[*k, *v] for k, v in self.counted.items()], "seen": self.seen, "clock": self.clock})

    def settled(self, now: float, rules: Rules) -> str:
        """What a frame at ``now`` finds of this state that can still matter; equal for states that act alike from then on."""
        kept = {k: t for k, t in self.tracks.items() if now - t.times[-1] <= rules.longest_gap}
        told = {k: asdict(t) if t.crossing else {"kind": t.kind, "points": t.points, "times": t.times} for k, t in kept.items()}
        ttl = max(rules.counted_ttl, rules.dedup_window, rules.reverse_cooldown)
        counted = sorted([*k, *v] for k, v in self.counted.items() if k[0] in kept and now - v[0] <= ttl)
        return json.dumps([told, counted, sorted(set(self.seen) & set(kept))], sort_keys=True)

    @staticmethod
    def loads(text: str) -> Device:
        d = json.loads(text)
        names = {f.name for f in fields(Track)}
        return Device({k: Track(**{n: v for n, v in t.items() if n in names}) for k, t in d["tracks"].items()}, {(a, b): [t, p] for a, b, t, p in d["counted"]}, d["seen"], d["clock"])


@dataclass
class Seen:
    """One observation of a frame."""

    track_id: str
    kind: str
    x: float
    y: float
    w: float = 40.0
    h: float = 40.0


def _velocity(t: Track) -> tuple[float, float]:
    k = max(0, len(t.points) - 3)
    dt = t.times[-1] - t.times[k]
    return ((t.points[-1][0] - t.points[k][0]) / dt, (t.points[-1][1] - t.points[k][1]) / dt) if dt > 0 else (0.0, 0.0)


def _continued(dev: Device, s: Seen, now: float, present: set, rules: Rules) -> str | None:
    """The vanished track of the same class that ``s`` continues best; of equal ones, the least id."""
    best = None
    for tid, t in dev.tracks.items():
        if tid == s.track_id or tid in present or tid in dev.seen or t.kind != s.kind or len(t.points) < 3:
            continue
        gap = now - t.times[-1]
        if not 0 < gap <= rules.stitch_gap:
            continue
        vx, vy = _velocity(t)
        px, py = t.points[-1]
        gx, gy = s.x - px, s.y - py
        moved = math.hypot(gx, gy) * math.hypot(vx, vy)
        error = math.hypot(px + vx * gap - s.x, py + vy * gap - s.y)
        if moved < 1e-9 or error > rules.stitch_jump * math.hypot(s.w, s.h) or (gx * vx + gy * vy) / moved < rules.stitch_cosine:
            continue
        if best is None or (error, tid) < best:
            best = (error, tid)
    return best and best[1]


def _move_on(dev: Device, frame: list[Seen], now: float, rules: Rules) -> list[tuple[str, str]]:
    """Bring histories up to the frame; pairs of a vanished track and the one that continues it."""
    present, pairs = {s.track_id for s in frame}, []
    for s in frame:
        t = dev.tracks.get(s.track_id)
        if t is not None and t.points and now - t.times[-1] > rules.longest_gap:
            _forget(dev, s.track_id)
            t = None
        if t is None:
            old = _continued(dev, s, now, present, rules)
            t = dev.tracks.pop(old) if old else Track(s.kind)
            if old:
                pairs.append((old, s.track_id))
                for way in ("enter", "exit"):
                    a, b = dev.counted.pop((old, way), None), dev.counted.get((s.track_id, way))
                    if a is not None and (b is None or a[0] >= b[0]):
                        dev.counted[s.track_id, way] = a
            dev.tracks[s.track_id] = t
        t.kind = s.kind
        t.points = [*t.points[1 - rules.history :], [s.x, s.y]]
        t.times = [*t.times[1 - rules.history :], now]
    for tid in [k for k, t in dev.tracks.items() if k not in present and now - t.times[-1] > rules.longest_gap]:
        _forget(dev, tid)
    dev.seen = sorted(present)
    return pairs


def _forget(dev: Device, tid: str) -> None:
    dev.tracks.pop(tid, None)
    for way in ("enter", "exit"):
        dev.counted.pop((tid, way), None)


def _switched(t: Track, s: Seen, rules: Rules) -> bool:
    """Whether the last step is too fast and too sharply turned to be the same object."""
    n = len(t.points)
    if n < 4:
        return False

    def step(i: int) -> float:
        dt = (t.times[i] - t.times[i - 1]) * rules.base_fps
        d = math.dist(t.points[i], t.points[i - 1])
        return d / dt if dt > 0 else d

    average, last = sum(step(i) for i in range(1, n - 1)) / (n - 2), step(n - 1)
    excess = max(rules.least_excess, rules.excess_share * max(s.w, s.h))
    if not (average > rules.least_average and last > rules.speed_ratio * average and last - average > excess):
        return False
    (ax, ay), (bx, by), (cx, cy) = t.points[-3:]
    norm = math.hypot(bx - ax, by - ay) * math.hypot(cx - bx, cy - by)
    straight = norm > 1e-12 and ((bx - ax) * (cx - bx) + (by - ay) * (cy - by)) / norm >= rules.direction_cosine
    return not straight


def _stuck_at_end(t: Track, line: Line, rules: Rules) -> bool:
    near = rules.endpoint_sensitivity * max(line.size)
    return any(all(math.dist(p, e) < near for p in t.points[-2:]) for e in (line.a, line.b))


def _judge(dev: Device, s: Seen, line: Line, now: float, wall: float, rules: Rules) -> tuple[dict | None, str | None]:
    """(event, None), (None, reason of refusal) or (None, None) for one track of a frame."""
    t = dev.tracks[s.track_id]
    if len(t.points) < 2:
        return None, "short history"
    prev, cur = t.points[-2], t.points[-1]
    dt = t.times[-1] - t.times[-2]
    if not 0 < dt <= rules.longest_gap:
        t.quiet()
        return None, "observation gap"
    before, after = line.offset(prev), line.offset(cur)
    fast = line.speed_across(prev, cur, dt) >= rules.min_motion * rules.base_fps
    met = line.met(prev, cur) if fast and (before or after) else None
    if met is None and not t.crossing and not line.in_region(cur):
        return None, "outside region"
    if _switched(t, s, rules):
        t.quiet()
        return None, "track switch"
    reason = None
    if met is None and before * after < 0:
        reason = "beyond the line's valid part" if fast else "too slow"
    if met is not None:
        t.last_crossing, t.cross = now, list(met)
        part = min(1.0, max(0.0, before / (before - after))) if abs(before - after) > 1e-9 else 1.0
        t.cross_wall = wall - dt * (1 - part)
        if not t.crossing:
            t.crossing, t.start, t.held = True, _clear_point(t, line), 0.0
            t.side = (after > 0) - (after < 0)
    if not t.crossing:
        return None, reason
    short = min(line.size)
    if line.distance(cur) < max(20, int(rules.min_distance_ratio * short)):
        return None, "near the line"
    if _stuck_at_end(t, line, rules):
        return None, "at an end of the line"
    if after * t.side < 0:
        if abs(after) < max(20, int(rules.hysteresis_ratio * short)) * line.length:
            return None, "not held"
        t.held, t.side, t.start = 0.0, (1 if after > 0 else -1), _clear_point(t, line)
        return None, "side changed"
    t.held += dt
    if t.held < rules.hold_frames / rules.base_fps:
        return None, "not held"
    began = line.offset(t.start)
    if began * after >= 0:
        t.crossing = False
        return None, "same side"
    way = "enter" if after > 0 else "exit"
    recent = t.points[-rules.direction_window :]
    if len(recent) == rules.direction_window:
        run = line.offset(recent[-1]) - line.offset(recent[0])
        if abs(run) > line.length / 2 and (run > 0) != (way == "enter"):
            t.quiet()
            return None, "against its motion"
    same, other = dev.counted.get((s.track_id, way)), dev.counted.get((s.track_id, "exit" if way == "enter" else "enter"))
    if same and now - same[0] <= rules.dedup_window and math.dist(same[1], t.cross) <= rules.dedup_distance:
        reason = "counted before"
    elif other and now - other[0] < rules.reverse_cooldown:
        reason = "reverse cooldown"
    elif line.count_only and way != line.count_only:
        reason = "other way"
    else:
        reason = None
    if reason:
        t.crossing = False
        return None, reason
    stream = "Person" if t.kind in PERSONS else "Vehicle" if t.kind in VEHICLES else None
    if stream is None:
        t.quiet()
        return None, "unknown class"
    event = {"track_id": s.track_id, "event_type": stream + way.capitalize(), "direction": "outer_to_inner" if way == "enter" else "inner_to_outer", "t_cross": t.cross_wall, "x": t.cross[0], "y": t.cross[1]}
    return event, None


def _clear_point(t: Track, line: Line):
    """The last point before the current one that isn't on the line."""
    return next((p for p in reversed(t.points[:-1]) if line.offset(p) != 0), t.points[-2])


def commit(dev: Device, events: list[dict], now: float) -> None:
    """Take events as counted. For streams: after they are written."""
    for e in events:
        way = "enter" if e["direction"] == "outer_to_inner" else "exit"
        dev.counted[e["track_id"], way] = [now, [e["x"], e["y"]]]
        if e["track_id"] in dev.tracks:
            dev.tracks[e["track_id"]].crossing = False


def step(dev: Device, frame: list[Seen], line: Line, now: float, wall: float, rules: Rules) -> tuple[list[dict], list[tuple[str, str]]]:
    """Events and (track, reason) refusals of one frame; ``dev`` moves on."""
    if not (math.isfinite(now) and math.isfinite(wall)) or (dev.clock is not None and now <= dev.clock):
        raise ValueError("frame times must be finite and rise")
    dev.clock = now
    _move_on(dev, frame, now, rules)
    events, rejects = [], []
    for s in frame:
        event, reason = _judge(dev, s, line, now, wall, rules)
        if event:
            events.append(event)
            commit(dev, [event], now)
        elif reason:
            rejects.append((s.track_id, reason))
    for t in dev.tracks.values():
        if t.crossing and t.last_crossing is not None and now - t.last_crossing > rules.idle:
            t.quiet()
    dev.counted = {k: v for k, v in dev.counted.items() if now - v[0] <= rules.counted_ttl}
    return events, rejects


OBSERVED = ("device_id", "track_id", "class_name", "x", "y", "w", "h", "t_mono", "t_wall")


def frames(rows: pd.DataFrame) -> Iterator[tuple[float, float, list[Seen]]]:
    """Frames of one device's observations, in order of time. Times that aren't finite are left out."""
    t, wall = (rows[c].to_numpy(float) for c in ("t_mono", "t_wall"))
    ok = rows[np.isfinite(t) & np.isfinite(wall)].sort_values(["t_mono", "track_id"], kind="stable")
    columns = [ok[c].tolist() for c in ("t_mono", "t_wall", *OBSERVED[1:-2])]
    for now, part in itertools.groupby(zip(*columns, strict=True), key=itemgetter(0)):
        first = {}
        for r in part:
            first.setdefault(r[2], r)
        seen = list(first.values())
        yield float(now), float(seen[0][1]), [Seen(str(i), kind, float(x), float(y), float(w), float(h)) for _, _, i, kind, x, y, w, h in seen]


def run_device(dev: Device, rows: pd.DataFrame, line: Line, rules: Rules) -> tuple[list[tuple], list[tuple]]:
    events, rejects = [], []
    device = str(rows["device_id"].iloc[0])
    for now, wall, seen in frames(rows):
        if dev.clock is not None and now <= dev.clock:
            continue
        got, refused = step(dev, seen, line, now, wall, rules)
        events += [(device, e["track_id"], e["event_type"], e["direction"], e["t_cross"], e["x"], e["y"]) for e in got]
        rejects += [(device, t, now, r) for t, r in refused]
    return events, rejects


#: Seconds of a slice of a device's time.
SLICE = 3600.0


def crossings(observations: DataFrame, lines: dict[str, Line], rules: Rules = Rules(), rejected: bool = False, slice_s: float = SLICE, warm: float | None = None) -> DataFrame:
    """Crossing events (or refusals) of observations (OBSERVED) of the devices that have a line.

    Each frame depends on those before it, but what happened long ago doesn't matter any more. So a device's time is cut
    into slices, which are folded side by side, each from ``warm`` seconds before it: longer than all windows. Where the
    state that a slice began with isn't the one that the slice before it ended in, in all that can still matter, it is
    folded again from there, until all slices follow from each other: then the events are those of one fold from the
    beginning. A task holds a batch of observations and one state. Observations without finite times are left out.
    """
    warm = rules.counted_ttl + rules.history * rules.longest_gap + rules.idle if warm is None else warm
    slice_s = max(slice_s, warm)
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    rows = observations.select(*OBSERVED).where(F.col("device_id").isin(*lines) & finite("t_mono") & finite("t_wall"))
    place = F.floor(F.col("t_mono") / slice_s)
    ends = (place + 1) * slice_s - warm
    own = rows.withColumn("_slice", place)
    copies = own.where(F.col("t_mono") >= ends).withColumn("_slice", F.col("_slice") + 1)
    schema = REJECTS if rejected else EVENTS
    told = f"{schema}, _slice long, _start string, _first double, _end string"
    out = to_arrow_schema(StructType.fromDDL(told))
    n = len(out) - 4

    def table(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(out), out, strict=True)], schema=out)

    def fold(key: tuple, part: pa.Table, state: tuple | None) -> tuple[pa.Table, tuple]:
        device, number = key
        dev, begun = state or (Device(), None)
        prior = part["_prior"].drop_null()
        if len(prior):
            dev = Device.loads(prior[0].as_py())
        found = []
        for now, wall, seen in frames(part.drop_columns(["_prior"]).to_pandas()):
            if now >= number * slice_s and begun is None:
                begun = (dev.settled(now, rules), now)
            got, refused = step(dev, seen, lines[device], now, wall, rules)
            if begun is not None and rejected:
                found += [(device, t, now, r, number, None, None, None) for t, r in refused]
            elif begun is not None:
                found += [(device, e["track_id"], e["event_type"], e["direction"], e["t_cross"], e["x"], e["y"], number, None, None, None) for e in got]
        return table(found), (dev, begun)

    def finish(key: tuple, state: tuple) -> pa.Table:
        dev, begun = state
        return table([] if begun is None else [(key[0], *[None] * (n - 1), key[1], *begun, dev.dumps())])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = [Device.loads(b).settled(f, rules) != s for b, f, s in zip(*(batch.column(c).to_pylist() for c in ("_before", "_first", "_start")), strict=True)]
            yield batch.select(["device_id", "_slice", "_before"]).filter(pa.array(odd, pa.bool_()))

    def run(some: DataFrame) -> DataFrame:
        return saved(fold_sorted(some, ["device_id", "_slice"], ["t_mono", *(c for c in OBSERVED[1:] if c != "t_mono")], fold, told, together="t_mono", finish=finish))

    done = run(own.unionByName(copies).withColumn("_prior", F.lit(None).cast("string")))
    before = F.lag("_end").over(Window.partitionBy("device_id").orderBy("_slice"))
    while True:
        states = done.where("_end is not null").select("device_id", "_slice", "_start", "_first", before.alias("_before")).where("_before is not null")
        odd = saved(states.mapInArrow(apart, "device_id string, _slice long, _before string"))
        if odd.isEmpty():
            return done.where("_end is null").drop("_slice", "_start", "_first", "_end")
        which = odd.select("device_id", "_slice")
        heads = odd.select("device_id", "_slice", F.col("_before").alias("_prior"))
        again = own.join(which, ["device_id", "_slice"], "left_semi").unionByName(heads, allowMissingColumns=True)
        done = run(again).unionByName(done.join(which, ["device_id", "_slice"], "left_anti"))
