"""Video frames and streams as bytes: black and noisy pictures, program-stream headers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.enrich import BROADCAST_ROWS
from flowspark.sources.saved import saved


@dataclass(frozen=True)
class Limits:
    width: int = 320
    brightness: float = 20.0
    dark_share: float = 0.95
    dark_value: int = 30
    grid: int = 8
    noise: float = 40.0
    uniformity: float = 0.7
    correlation: float = 0.5
    change: float = 40.0


def measures(pixels: np.ndarray, before: np.ndarray | None, limits: Limits) -> tuple[str | None, dict, np.ndarray]:
    """(anomaly or None, measures, grey picture) of a height x width x 3 picture, blue first."""
    h, w = pixels.shape[:2]
    if w > limits.width:
        rows = (np.arange(max(1, round(h * limits.width / w))) * w / limits.width).astype(int).clip(0, h - 1)
        pixels = pixels[rows][:, (np.arange(limits.width) * w / limits.width).astype(int)]
    grey = np.rint(pixels.astype(np.float32) @ np.array([0.114, 0.587, 0.299], np.float32)).astype(np.uint8)
    m: dict = {"brightness": float(grey.mean()), "dark": float((grey < limits.dark_value).mean())}
    if m["brightness"] < limits.brightness and m["dark"] > limits.dark_share:
        return "black_screen", m, grey
    g = limits.grid
    bh, bw = grey.shape[0] // g, grey.shape[1] // g
    m |= {"noise": 0.0, "uniformity": 0.0}
    if bh and bw:
        std = grey[: bh * g, : bw * g].astype(np.float32).reshape(g, bh, g, bw).std(axis=(1, 3))
        m["noise"] = float(std.mean())
        m["uniformity"] = max(0.0, 1 - float(std.std() / std.mean())) if std.mean() >= 1e-6 else 0.0
    blue, green, red = (pixels[:, :, c].astype(np.float32).ravel() for c in range(3))

    def correlation(a: np.ndarray, b: np.ndarray) -> float:
        a, b = a - a.mean(), b - b.mean()
        norm = float(np.sqrt(float(a @ a) * float(b @ b)))
        return 1.0 if norm < 1e-6 else abs(float(a @ b) / norm)

    m["correlation"] = (correlation(red, green) + correlation(green, blue)) / 2
    m["change"] = float(np.abs(grey.astype(np.int16) - before).mean()) if before is not None and before.shape == grey.shape else None
    noisy = m["noise"] > limits.noise and m["uniformity"] > limits.uniformity
    odd = m["correlation"] < limits.correlation or (m["change"] or 0) > limits.change
    return ("flower_screen" if noisy and odd else None), m, grey


_TOLD = "device_id string, n long, anomaly string, brightness double, noise double, undecided boolean"
_GREY = "height int, width int, grey binary"


def _told(frames: DataFrame, limits: Limits, grey: bool) -> DataFrame:
    """Each frame judged by itself: ``undecided`` where the change from the frame before decides. Its grey picture, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, p in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "pixels")), strict=True):
                if p is None or not h or not w or min(h, w) < 0 or len(p) != h * w * 3:
                    out.append((None, None, None, False, None, None, None))
                    continue
                kind, m, g = measures(np.frombuffer(p, np.uint8).reshape(h, w, 3), None, limits)
                noisy = m.get("noise", 0.0) > limits.noise and m["uniformity"] > limits.uniformity
                out.append((kind, m["brightness"], m.get("noise"), kind is None and noisy, *g.shape, g.tobytes() if grey else None))
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_(), *((pa.int32(), pa.int32(), pa.binary()) if grey else ()))
            names = ("anomaly", "brightness", "noise", "undecided", "height", "width", "grey")[: len(types)]
            yield pa.RecordBatch.from_arrays([batch.column("device_id"), batch.column("n"), *(pa.array([o[i] for o in out], t) for i, t in enumerate(types))], ["device_id", "n", *names])

    return frames.select("device_id", F.col("n").cast("long").alias("n"), "width", "height", "pixels").mapInArrow(run, f"{_TOLD}, {_GREY}" if grey else _TOLD)


def anomalies(frames: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(device_id, n, anomaly, brightness, noise) of frames (device_id, n, width, height, pixels).

    Frames are judged where they are read. Only for those that the change from the last whole frame before them decides
    do pictures travel, grey and scaled down: theirs and the ones before. A task holds a batch of frames only.
    """
    told, result = saved(_told(frames, limits, False)), ["device_id", "n", "anomaly", "brightness", "noise"]
    if told.where("undecided").isEmpty():
        return told.select(result)
    by_n = Window.partitionBy("device_id").orderBy("n")
    last = F.max(F.when(F.col("brightness").isNotNull(), F.col("n"))).over(by_n.rangeBetween(Window.unboundedPreceding, -1))
    asked = told.withColumn("last", last).where("undecided").select(F.col("device_id").alias("_d"), F.explode(F.array("n", "last")).alias("_n")).distinct()
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # beyond that, all grey pictures are sorted
        frames = frames.join(F.broadcast(asked), F.col("device_id").eqNullSafe(F.col("_d")) & F.col("n").eqNullSafe(F.col("_n")), "left_semi")
    before = F.last(F.when(F.col("grey").isNotNull(), F.struct("height", "width", "grey")), ignorenulls=True).over(by_n.rowsBetween(Window.unboundedPreceding, -1))
    paired = _told(frames, limits, True).withColumn("before", before).where("undecided")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for h, w, g, b in zip(*(batch.column(c).to_pylist() for c in ("height", "width", "grey", "before")), strict=True):
                alike = b is not None and (b["height"], b["width"]) == (h, w)
                change = np.abs(np.frombuffer(g, np.uint8).astype(np.int16) - np.frombuffer(b["grey"], np.uint8)).mean() if alike else 0
                kinds.append("flower_screen" if change > limits.change else None)
            yield pa.RecordBatch.from_arrays([batch.column("device_id"), batch.column("n"), pa.array(kinds, pa.string()), batch.column("brightness"), batch.column("noise")], result)

    return told.where("not undecided").select(result).unionByName(paired.mapInArrow(compare, "device_id string, n long, anomaly string, brightness double, noise double"))


def timestamp90k(b: bytes) -> int:
    """The 33-bit presentation time of five header bytes."""
    return (b[0] >> 1 & 7) << 30 | (b[1] << 8 | b[2]) >> 1 << 15 | (b[3] << 8 | b[4]) >> 1


def scan_stream(data: bytes) -> dict:
    """Start codes, header versions and presentation times of a program stream."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw[:-3] == 0) & (raw[1:-2] == 0) & (raw[2:-1] == 1)) if len(raw) > 3 else np.zeros(0, int)
    codes = raw[at + 3] if len(at) else raw[:0]
    times: dict[int, list[int]] = {1: [], 2: []}
    for i in at[codes == 0xE0].tolist():
        head = data[i : i + 20]
        if len(head) < 14:
            continue
        if head[6] >> 6 == 2:
            if head[7] & 0x80:
                times[2].append(timestamp90k(head[9:14]))
        else:
            j = 6
            while j < len(head) - 5 and head[j] >> 6 == 2:
                j += 1
            if head[j] >> 4 == 2:
                times[1].append(timestamp90k(head[j : j + 5]))
    kinds = [data[i + 4] >> 4 for i in at[codes == 0xBA].tolist() if i + 4 < len(data)]
    v1, v2 = kinds.count(2), kinds.count(4)
    return {"packs": len(kinds), "maps": int((codes == 0xBC).sum()), "video": int((codes == 0xE0).sum()), "version": "MPEG-2" if v2 and not v1 else "MPEG-1" if v1 and not v2 else "mixed", "times": times[2] or times[1]}


def scan_streams(files: DataFrame) -> DataFrame:
    """``scan_stream`` of each file of the binaryFile source (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_stream(c or b"") for c in batch.column("content").to_pylist()]
            types = {"packs": pa.int32(), "maps": pa.int32(), "video": pa.int32(), "version": pa.string(), "times": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([f[k] for f in found], t) for k, t in types.items())], ["path", *types])

    return files.select("path", "content").mapInArrow(run, "path string, packs int, maps int, video int, version string, times array<long>")
