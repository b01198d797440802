"""Geometry of lines and regions as columns: points are (x, y) columns, polygons arrays of such structs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def rounded(c: Column | str, digits: int) -> Column:
    """Half away from zero after scaling, in doubles, as SQL engines do: Spark's own rounding goes by decimal digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 10.0**digits) / 10.0**digits


def normal(p1: Point, p2: Point, anchor: Point) -> Point:
    """Normal of the line, as long as it, on the anchor's side."""
    nx, ny = -(p2[1] - p1[1]), p2[0] - p1[0]
    flip = F.when((anchor[0] - p1[0]) * nx + (anchor[1] - p1[1]) * ny < 0, -1.0).otherwise(1.0)
    return nx * flip, ny * flip


def unit(v: Point) -> Point:
    n = F.hypot(v[0], v[1])
    return tuple(F.when(n > 0, c / n).otherwise(0.0) for c in v)


def offset(p: Point, p1: Point, n: Point) -> Column:
    """Distance to the line times its length, positive on the inner side."""
    return (p[0] - p1[0]) * n[0] + (p[1] - p1[1]) * n[1]


def side(p: Point, p1: Point, n: Point) -> Column:
    return F.signum(offset(p, p1, n)).cast("int")


def projection(p: Point, p1: Point, p2: Point) -> Column:
    """Parameter of the foot of p on the line; 0 for a line without length."""
    dx, dy = p2[0] - p1[0], p2[1] - p1[1]
    l2 = dx * dx + dy * dy
    return F.when(l2 > 0, ((p[0] - p1[0]) * dx + (p[1] - p1[1]) * dy) / l2).otherwise(0.0)


def segment_distance(p: Point, p1: Point, p2: Point) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), projection(p, p1, p2)))
    return F.hypot(p[0] - (p1[0] + t * (p2[0] - p1[0])), p[1] - (p1[1] + t * (p2[1] - p1[1])))


def crossing_point(prev: Point, cur: Point, off_prev: Column, off_cur: Column) -> Point:
    """Where the move meets the line, by the offsets at its ends."""
    d = off_prev - off_cur
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), off_prev / F.when(F.abs(d) >= 1e-9, d)))
    return tuple(F.when(F.abs(d) < 1e-9, c).otherwise(a + s * (c - a)) for a, c in zip(prev, cur, strict=True))


def fast_enough(prev: Point, cur: Point, unit_normal: Point, dt: Column, least: float) -> Column:
    """Speed across the line, in pixels a second."""
    step = F.when(dt > 0, dt).otherwise(1 / 25)
    return F.round(F.abs((cur[0] - prev[0]) * unit_normal[0] + (cur[1] - prev[1]) * unit_normal[1]) / step, 6) >= least


def in_polygon(p: Point, ring: Column) -> Column:
    """Whether p lies in the ring, its edges included (within 1e-9). A bounding box is tested first."""
    x, y = p
    n = F.size(ring)
    at = lambda i: F.get(ring, i)
    edges = F.sequence(F.lit(0), n - 1)

    def on_edge(i: Column) -> Column:
        a, b = at(i), at((i + 1) % n)
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        dot = (x - a["x"]) * (x - b["x"]) + (y - a["y"]) * (y - b["y"])
        return (F.abs(cross) <= 1e-9) & (dot <= 1e-9)

    def cuts(acc: Column, i: Column) -> Column:
        a, b = at(i), at((i + 1) % n)
        spans = (a["y"] > y) != (b["y"] > y)
        return acc != F.coalesce(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"]), F.lit(False))

    xs, ys = F.transform(ring, lambda q: q["x"]), F.transform(ring, lambda q: q["y"])
    near = x.between(F.array_min(xs) - 1e-9, F.array_max(xs) + 1e-9) & y.between(F.array_min(ys) - 1e-9, F.array_max(ys) + 1e-9)
    return near & (F.exists(edges, on_edge) | F.aggregate(edges, F.lit(False), cuts))


def ring_area(ring: Column) -> Column:
    n = F.size(ring)
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])) / 2


def adaptive_pixel(width: Column, height: Column, least: float = 30.0, share: float = 0.3) -> Column:
    return F.greatest(F.lit(least), share * F.greatest(width, height))


# small geometry of one device, for the driver or a task ---------------------------------------------


def clip_intervals(p1: tuple[float, float], p2: tuple[float, float], ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Stretches of the line within the closed ring, as parameters of its length. An empty ring gives the whole line.

    By the ring's corners: their distances to the line have signs, and edges between corners of different signs cross it.
    In order along the line, crossings lead in and out by turns. Corners on the line count to either side in turn, which
    is the line moved a little to the one and to the other side: what either has inside, edges along the line included,
    lies in the closed ring.
    """
    if not ring:
        return [(0.0, 1.0)]
    dx, dy = p2[0] - p1[0], p2[1] - p1[1]
    length = math.hypot(dx, dy)
    if length == 0:
        return []
    away = [(dx * (y - p1[1]) - dy * (x - p1[0])) / length for x, y in ring]
    away = [0.0 if abs(d) <= 1e-9 else d for d in away]
    along = [(dx * (x - p1[0]) + dy * (y - p1[1])) / length**2 for x, y in ring]
    inside: list[tuple[float, float]] = []
    for with_zero in (True, False):
        left = [d > 0 or with_zero and d == 0 for d in away]
        turns = sorted(along[i - 1] + (along[i] - along[i - 1]) * away[i - 1] / (away[i - 1] - away[i]) for i in range(len(ring)) if left[i - 1] != left[i])
        inside += zip(turns[::2], turns[1::2], strict=True)
    out: list[tuple[float, float]] = []
    for a, b in sorted((max(0.0, a), min(1.0, b)) for a, b in inside):
        if b - a <= 1e-12:
            continue
        if out and a <= out[-1][1] + 1e-9:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def longest_interval(intervals: list[tuple[float, float]]) -> tuple[float, float]:
    return max(intervals, key=lambda i: i[1] - i[0], default=(1.0, 0.0))


def point_in_ring(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    x, y = p
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= 1e-9 and (x - ax) * (x - bx) + (y - ay) * (y - by) <= 1e-9:
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def validate(line: list[tuple[float, float]], anchor: tuple[float, float], ring: list[tuple[float, float]] | None) -> None:
    """ValueError unless a device's geometry can count: finite unit coordinates, a line, an anchor off it, a simple ring
    of some area that overlaps the line."""
    points = [*line, anchor, *(ring or [])]
    if any(not math.isfinite(c) or not 0 <= c <= 1 for q in points for c in q):
        raise ValueError("coordinates must be finite and within 0 to 1")
    (ax, ay), (bx, by) = line
    if math.hypot(bx - ax, by - ay) < 1e-9:
        raise ValueError("the line has no length")
    if abs((bx - ax) * (anchor[1] - ay) - (by - ay) * (anchor[0] - ax)) < 1e-9:
        raise ValueError("the anchor lies on the line")
    if not ring:
        return
    n = len(ring)
    area = abs(sum(ring[i][0] * ring[(i + 1) % n][1] - ring[(i + 1) % n][0] * ring[i][1] for i in range(n))) / 2
    if n < 3 or area < 1e-9:
        raise ValueError("the region has no area")

    def turn(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    for i in range(n):
        for j in range(i + 1, n):
            if (j + 1) % n == i or (i + 1) % n == j:
                continue
            a, b, c, d = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
            across = turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0
            touching = any(abs(turn(o, q, p)) < 1e-12 and (p[0] - o[0]) * (p[0] - q[0]) + (p[1] - o[1]) * (p[1] - q[1]) <= 0 for o, q, p in ((a, b, c), (a, b, d), (c, d, a), (c, d, b)))
            if across or touching:
                raise ValueError("the region crosses itself")
    if not clip_intervals(line[0], line[1], ring):
        raise ValueError("the region misses the line")
