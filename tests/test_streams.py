from __future__ import annotations

import datetime

import pytest

from flowspark.operators import counters, events
from flowspark.operators.crossing import Line, crossings
from flowspark.streaming import streams

from .test_crossing import ANCHOR, LINE, observed

SCHEMA = "event_id long, device_id string, event_type string, occurred_at timestamp_ntz"


def rows(n=300):
    t0 = datetime.datetime(2024, 1, 1)
    kinds = ("VehicleEnter", "VehicleExit", "PersonEnter", "PersonExit", "Invalid")
    return [(i, f"cam-{i % 4}", kinds[i % 5], t0 + datetime.timedelta(minutes=3 * i)) for i in range(n)]


def put(spark, folder, parts):
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/tmp{k}")
    import pathlib
    import shutil

    for k in range(len(parts)):
        for p in pathlib.Path(f"{folder}/tmp{k}").glob("*.parquet"):
            shutil.move(p, f"{folder}/{k}-{p.name}")
        shutil.rmtree(f"{folder}/tmp{k}")


def drain(df, checkpoint, name=None, sink=None, mode="append"):
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("memory").queryName(name)).start()
    q.awaitTermination(120)
    assert q.exception() is None


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def test_hourly_counts(spark, folder):
    df = spark.createDataFrame(rows(), SCHEMA)
    put(spark, f"{folder}/in", [df.where("event_id < 150"), df.where("event_id >= 150")])
    drain(streams.hourly(streams.read(spark, f"{folder}/in", SCHEMA, files=1)), f"{folder}/c", "hourly")
    batch = counters.hourly(events.known_types(df)).collect()
    got = {tuple(r) for r in spark.table("hourly").select("device_id", "stat_date", "hour", "vehicle_in", "vehicle_out", "person_in", "person_out").collect()}
    assert got < {tuple(r) for r in batch} and len(got) > len(batch) * 0.6  # open windows come later


def test_ledger_takes_each_id_once(spark, folder):
    df = spark.createDataFrame(rows(40), SCHEMA)
    again = df.where("event_id % 10 = 0").withColumn("event_type", events.F.lit("PersonExit"))
    put(spark, f"{folder}/in", [df, again, df.limit(5)])
    sink = streams.append_new(f"{folder}/ledger", conflicts=f"{folder}/conflicts")
    drain(streams.read(spark, f"{folder}/in", SCHEMA, files=1), f"{folder}/c", sink=sink)
    out = spark.read.parquet(f"{folder}/ledger")
    assert out.count() == 40 and out.select("event_id").distinct().count() == 40
    odd = spark.read.parquet(f"{folder}/conflicts")
    assert {r["event_id"] for r in odd.collect()} == {r["event_id"] for r in again.join(df, ["event_id", "event_type"], "left_anti").collect()}
    with pytest.raises(streams.ConflictError):
        streams.append_new(f"{folder}/ledger")(again, 9)
    sink(df, 0)  # a batch that runs again
    assert spark.read.parquet(f"{folder}/ledger").count() == 40


def test_archive_is_acknowledged_by_version(spark, folder):
    df = spark.createDataFrame(rows(100), SCHEMA).where("event_type != 'Invalid'")
    df.write.parquet(f"{folder}/facts")
    sink = streams.archive_again(*(f"{folder}/{n}" for n in ("facts", "late", "done", "archive")))
    hour = df.where("device_id = 'cam-0' and hour(occurred_at) = 0")
    for k in (0, 0, 1):  # a batch that runs again, and a batch without news
        sink(hour if k == 0 else hour.limit(0), k)
        assert [tuple(r) for r in spark.read.parquet(f"{folder}/done").collect()] == [("cam-0", "2024-01-01", 0, hour.count())]
    late = spark.createDataFrame([(9000, "cam-0", "VehicleEnter", datetime.datetime(2024, 1, 1, 0, 30))], SCHEMA)
    late.write.mode("append").parquet(f"{folder}/facts")
    sink(late, 2)
    assert sorted(r["version"] for r in spark.read.parquet(f"{folder}/done").collect()) == [hour.count(), hour.count() + 1]
    archive = spark.read.parquet(f"{folder}/archive")
    assert archive.count() == 1 and archive.first()["vehicle_in"] == hour.where("event_type = 'VehicleEnter'").count() + 1


def test_archive_waits_for_the_ledger(spark, folder):
    """A late event that reaches the facts after its batch: the hour isn't acknowledged for it until it is counted."""
    paths = [f"{folder}/{n}" for n in ("facts", "late", "done", "archive")]
    sink = streams.archive_again(*paths)
    at = datetime.datetime(2024, 1, 1, 5, 10)
    facts = spark.createDataFrame([(1, "cam-0", "VehicleEnter", at)], SCHEMA)
    late = spark.createDataFrame([(2, "cam-0", "VehicleEnter", at), (2, "cam-0", "VehicleEnter", at)], SCHEMA)
    facts.write.parquet(paths[0])
    sink(late, 0)  # the ledger is behind
    assert spark.read.schema("version long").parquet(paths[2]).count() == 0
    late.limit(1).write.mode("append").parquet(paths[0])
    for number in (1, 1, 2):
        sink(late.limit(0), number)
        assert [r["version"] for r in spark.read.parquet(paths[2]).collect()] == [1]
        assert [r["vehicle_in"] for r in spark.read.parquet(paths[3]).collect()] == [2]


def test_ledger_compares_canonical_content(spark, folder):
    rows = [(1, '{"b": {"y": 1, "x": [2, 1]}, "a": null}'), (2, "no json"), (3, None)]
    same = [(1, '{"a":null,"b":{"x":[2,1],"y":1}}'), (2, "no json"), (3, None)]
    sink = streams.append_new(f"{folder}/ledger", evidence="evidence")
    schema = "event_id long, evidence string"
    sink(spark.createDataFrame(rows, schema), 0)
    sink(spark.createDataFrame(same, schema), 1)
    assert spark.read.parquet(f"{folder}/ledger").count() == 3
    for odd in ((1, '{"a":null,"b":{"x":[1,2],"y":1}}'), (2, "other"), (3, "{}")):
        with pytest.raises(streams.ConflictError):
            sink(spark.createDataFrame([odd], schema), 2)


def test_late_hours_are_counted_again(spark, folder):
    df = spark.createDataFrame(rows(100), SCHEMA).where("event_type != 'Invalid'")
    df.write.parquet(f"{folder}/facts")
    sink = streams.recompute_hours(f"{folder}/facts", f"{folder}/archive")
    sink(df, 0)
    first = spark.read.parquet(f"{folder}/archive").agg(events.F.sum("vehicle_in")).first()[0]
    late = spark.createDataFrame([(9000, "cam-0", "VehicleEnter", datetime.datetime(2024, 1, 1, 0, 30))], SCHEMA)
    late.write.mode("append").parquet(f"{folder}/facts")
    for k in (1, 2):
        sink(late, k)
    assert spark.read.parquet(f"{folder}/archive").agg(events.F.sum("vehicle_in")).first()[0] == first + 1


def test_crossings_equal_the_batch(spark, folder):
    df = spark.createDataFrame(observed())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    put(spark, f"{folder}/in", [df.where("t_mono < 3"), df.where("t_mono >= 3 and t_mono < 5"), df.where("t_mono >= 5")])
    lines = {f"cam-{d}": Line(LINE, ANCHOR, 1280, 720) for d in range(3)}
    drain(streams.crossings(streams.read(spark, f"{folder}/in", schema, files=1), lines), f"{folder}/c", "crossings", mode="append")
    key = lambda r: (r["device_id"], r["track_id"], r["event_type"], round(r["t_cross"], 6))
    assert sorted(map(key, spark.table("crossings").collect())) == sorted(map(key, crossings(df, lines).collect()))


def test_cooldown(spark, folder):
    df = spark.createDataFrame([("r", s * 1_000_000) for s in (0, 100, 299, 300, 500, 601, 700)], "rule_id string, us long")
    put(spark, f"{folder}/in", [df.where("us < 300000000"), df.where("us >= 300000000")])
    drain(streams.suppressed(streams.read(spark, f"{folder}/in", "rule_id string, us long", files=1)), f"{folder}/c", "cool")
    assert sorted(r["us"] // 1_000_000 for r in spark.table("cool").collect()) == [0, 300, 601]
    (folder / "none").mkdir()
    put(spark, f"{folder}/none", [spark.createDataFrame([("r", None), ("r", 5), ("r", None)], "rule_id string, us long")])
    drain(streams.suppressed(streams.read(spark, f"{folder}/none", "rule_id string, us long")), f"{folder}/c2", "untimed")
    assert sorted(str(r["us"]) for r in spark.table("untimed").collect()) == ["5", "None", "None"]


def test_latest_and_partitions(spark, folder):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "k string, t int, v string")
    sink = streams.latest(f"{folder}/last", "k", "t")
    sink(df.where("t < 3"), 0)
    sink(df.where("t = 3"), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/last/1").collect()) == [("a", 3, "z"), ("b", 2, "y")]
    put_ = streams.replace_partitions(f"{folder}/p", "k")
    put_(df, 0)
    put_(df.where("t = 3"), 1)
    assert spark.read.parquet(f"{folder}/p").count() == 2


def test_windows_and_dedup(spark, folder):
    df = spark.createDataFrame(rows(60) + rows(10), SCHEMA)
    put(spark, f"{folder}/in", [df])
    drain(streams.first_within(streams.read(spark, f"{folder}/in", SCHEMA)).select("event_id"), f"{folder}/c", "once")
    assert spark.table("once").count() == 60
    drain(streams.flow_windows(streams.read(spark, f"{folder}/in", SCHEMA), "10 minutes", "5 minutes"), f"{folder}/d", "flows")
    assert spark.table("flows").where("flow > 0").count() > 10
