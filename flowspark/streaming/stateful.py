"""Streams with timers, lists, maps and expiring state, on ``transformWithState``.

These need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``): state lives on disk and its changes
in the checkpoint, so that a key's state isn't bound by memory, and a restart goes on where the query was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _needs_rocksdb(spark: SparkSession) -> None:
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        raise ValueError(f"{name} must be {PROVIDER}")


class _Heartbeats(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "status string, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = sorted(int(ms) for part in rows for ms in part["ms"])
        status, last = self.seen.get() if self.seen.exists() else ("online", times[0])
        changes = []
        for ms in times:
            if ms <= last and status == "offline":
                continue  # a late beat of the time before
            if status == "online" and ms - last > self.limit_ms:
                changes.append((key[0], "offline", last + self.limit_ms))
                status = "offline"
            if status == "offline":
                changes.append((key[0], "online", ms))
            status, last = "online", max(last, ms)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "online":
            self.handle.registerTimer(last + self.limit_ms)
        self.seen.update((status, last))
        if changes:
            yield pd.DataFrame(changes, columns=["device_id", "status", "at_ms"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.update(("offline", self.seen.get()[1]))
        yield pd.DataFrame([(key[0], "offline", int(expiredTimerInfo.getExpiryTimeInMs()))], columns=["device_id", "status", "at_ms"])

    def close(self) -> None:
        pass


def heartbeats(beats: DataFrame, limit_ms: int = 90_000, late: str = "10 seconds") -> DataFrame:
    """Offline and online changes of devices by the beats' own time (device_id, at timestamp).

    Each beat winds a timer up again; a device is offline when the watermark passes its last beat by the limit. The
    result is the same however the beats fall into micro-batches. Beats without a time or device are left out.
    """
    _needs_rocksdb(beats.sparkSession)
    timed = beats.where("device_id is not null and at is not null").withWatermark("at", late).select("device_id", "at", F.unix_millis("at").alias("ms"))
    return timed.groupBy("device_id").transformWithStateInPandas(_Heartbeats(limit_ms), "device_id string, status string, at_ms long", "append", "eventTime")


class _Cooldown(StatefulProcessor):
    def __init__(self, seconds: int, ttl_ms: int | None):
        self.gap, self.ttl_ms = seconds * 1_000_000, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = pd.concat(list(rows), ignore_index=True)["us"]
        out: list[tuple] = [(key[0], None)] * int(times.isna().sum())
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for us in sorted(times.dropna().astype("int64")):
            if last is None or us - last >= self.gap:
                last = int(us)
                out.append((key[0], last))
        if last is not None and last != before:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["rule_id", "us"]).astype({"us": "Int64"})

    def close(self) -> None:
        pass


def suppressed(alerts: DataFrame, seconds: int = 300, ttl_ms: int | None = None) -> DataFrame:
    """Alerts (rule_id, us) that are ``seconds`` after the last one emitted of their rule; untimed ones are all emitted.

    ``ttl_ms``: a rule that emitted nothing for so long, by the clock of the machine, is forgotten. For alerts that come
    about when they happen, the cooldown itself will do, and rules no longer used cost no state. A query with it runs on
    until it is stopped: the clock always makes another micro-batch.
    """
    _needs_rocksdb(alerts.sparkSession)
    return alerts.groupBy("rule_id").transformWithStateInPandas(_Cooldown(seconds, ttl_ms), "rule_id string, us long", "append", "processingTime" if ttl_ms else "none")


class _Positions(StatefulProcessor):
    def __init__(self, recent: int, ttl_ms: int | None):
        self.recent, self.ttl_ms = recent, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "track_id string", "us long, x double, y double", self.ttl_ms)
        self.trail = handle.getListState("trail", "us long, track_id string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True).dropna(subset=["track_id", "us"]).sort_values(["us", "track_id"], kind="stable")
        moved = {}
        for r in seen.itertuples():
            had = self.tracks.getValue((r.track_id,)) if self.tracks.containsKey((r.track_id,)) else None
            if had is None or r.us >= had[0]:
                self.tracks.updateValue((r.track_id,), (int(r.us), float(r.x), float(r.y)))
                moved[r.track_id] = (int(r.us), float(r.x), float(r.y))
        trail = sorted([*(tuple(t) for t in self.trail.get()), *((v[0], k) for k, v in moved.items())])[-self.recent :]
        if trail:
            self.trail.put(trail)
        here = sum(1 for _ in self.tracks.keys())
        names = ",".join(t for _, t in trail)
        yield pd.DataFrame([(key[0], k, *v, here, names) for k, v in moved.items()], columns=["device_id", "track_id", "us", "x", "y", "tracks", "trail"])

    def close(self) -> None:
        pass


def last_positions(observations: DataFrame, recent: int = 5, ttl_ms: int | None = None) -> DataFrame:
    """The last position of each track that a micro-batch moved, how many tracks its device has, and the last moved ones.

    ``observations``: (device_id, track_id, us, x, y); an older observation moves nothing. A map holds a device's tracks;
    with ``ttl_ms``, those that didn't move for so long are gone.
    """
    _needs_rocksdb(observations.sparkSession)
    out = "device_id string, track_id string, us long, x double, y double, tracks long, trail string"
    return observations.groupBy("device_id").transformWithStateInPandas(_Positions(recent, ttl_ms), out, "append", "processingTime" if ttl_ms else "none")
