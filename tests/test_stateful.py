"""Streams with timers, lists, maps and expiring state."""

from __future__ import annotations

import datetime
import time

import pytest
from pyspark.sql import functions as F

from flowspark.streaming import stateful, streams

from .test_streams import put

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": stateful.PROVIDER, "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_the_store_is_checked(spark):
    with pytest.raises(ValueError, match="providerClass"):
        stateful.suppressed(spark.createDataFrame([("r", 1)], "rule_id string, us long"))


@pytest.mark.parametrize("parts", [1, 3])
def test_heartbeat_timers_by_event_time(rocks, tmp_path, parts):
    """The same changes, however the beats fall into micro-batches, also over a restart from the checkpoint."""
    beats = [("a", s) for s in (0, 30, 60, 300, 330, 700)] + [("b", s) for s in range(0, 700, 50)] + [("c", 10)]
    rows = rocks.createDataFrame([(d, T0 + datetime.timedelta(seconds=s)) for d, s in beats] + [(None, T0), ("a", None)], "device_id string, at timestamp")
    cuts = [rows] if parts == 1 else [rows.where("at is null or at <= '2024-01-01 00:02:00'"), rows.where("at > '2024-01-01 00:02:00' and at <= '2024-01-01 00:05:20'"), rows.where("at > '2024-01-01 00:05:20'")]
    (tmp_path / "in").mkdir()
    for k, part in enumerate(cuts):  # each its own run of the query
        put(rocks, f"{tmp_path}/in", [part])
        for f in (tmp_path / "in").glob("0-*"):
            f.rename(tmp_path / "in" / f"run{k}-{f.name}")
        df = stateful.heartbeats(streams.read(rocks, f"{tmp_path}/in", "device_id string, at timestamp", files=1), 90_000)
        q = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(180)
        assert q.exception() is None
    base = int(T0.replace(tzinfo=datetime.timezone.utc).timestamp())
    got = {(r["device_id"], r["status"], r["at_ms"] // 1000 - base) for r in rocks.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", "offline", 150), ("a", "online", 300), ("a", "offline", 420), ("a", "online", 700), ("c", "offline", 100)}


def test_cooldown_state_expires(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "rule_id string, us long"
    for k, (name, us) in enumerate((("kept", 0), ("kept", 299_000_000), ("later", 300_000_000))):
        put(rocks, f"{tmp_path}/in", [rocks.createDataFrame([(r, us) for r in ("x", "y")] + [("x", None)], schema)])
        for f in (tmp_path / "in").glob("0-*"):
            f.rename(tmp_path / "in" / f"{k}{name}-{f.name}")
        for out, ttl in (("forever", None), ("short", 1)):
            df = stateful.suppressed(streams.read(rocks, f"{tmp_path}/in", schema), 300, ttl)
            w = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c-{out}")
            # with a clock there is always one more micro-batch: one at a time
            q = (w.trigger(once=True) if ttl else w.trigger(availableNow=True)).start(f"{tmp_path}/{out}")
            assert q.awaitTermination(60)
            assert q.exception() is None
        time.sleep(0.05)
    times = {out: sorted(r["us"] // 1_000_000 for r in rocks.read.parquet(f"{tmp_path}/{out}").where("us is not null").collect()) for out in ("forever", "short")}
    assert times == {"forever": [0, 0, 300, 300], "short": [0, 0, 299, 299, 300, 300]}
    assert rocks.read.parquet(f"{tmp_path}/forever").where("us is null").count() == 3


def test_last_positions_over_restarts(rocks, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "device_id string, track_id string, us long, x double, y double"
    batches = [[("d", "1", 10, 1.0, 1.0), ("d", "2", 11, 2.0, 2.0), ("d", None, 5, 0.0, 0.0)], [("d", "1", 9, 9.0, 9.0), ("e", "1", 1, 0.5, 0.5)], [("d", "3", 12, 3.0, 3.0), ("d", "1", 20, 4.0, 4.0)]]
    for k, batch in enumerate(batches):
        put(rocks, f"{tmp_path}/in", [rocks.createDataFrame(batch, schema)])
        for f in (tmp_path / "in").glob("0-*"):
            f.rename(tmp_path / "in" / f"run{k}-{f.name}")
        df = stateful.last_positions(streams.read(rocks, f"{tmp_path}/in", schema), recent=2).withColumn("run", F.lit(k))
        q = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(180)
        assert q.exception() is None
    got = sorted((r["run"], r["device_id"], r["track_id"], r["x"], r["tracks"], r["trail"]) for r in rocks.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "d", "1", 1.0, 2, "1,2"), (0, "d", "2", 2.0, 2, "1,2"), (1, "e", "1", 0.5, 1, "1"), (2, "d", "1", 4.0, 3, "3,1"), (2, "d", "3", 3.0, 3, "3,1")]


