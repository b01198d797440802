"""Paged sources: whole snapshots or errors, and what a growing one appends."""

from __future__ import annotations

import json

import pytest

from flowspark.sources.paged import IncompleteError, paged_source, read_paged

SCHEMA = "id string, name string"


def source(n, change=None):
    def fetch(page, size):
        items = [{"id": f"i{k}", "name": f"n{k}", "more": 1} for k in range(n)]
        got = {"total": n, "list": items[(page - 1) * size : page * size]}
        return change(page, got) if change else got

    return fetch


@pytest.mark.parametrize("n", [0, 1, 10, 23])
def test_whole_snapshots(spark, n):
    out = read_paged(spark, source(n), SCHEMA, size=5)
    assert sorted(tuple(r) for r in out.collect()) == sorted((f"i{k}", f"n{k}") for k in range(n))
    untold = read_paged(spark, source(n, lambda page, got: {"list": got["list"]}), SCHEMA, size=5)
    assert untold.count() == n
    assert spark.read.format("paged").load().rdd.getNumPartitions() == 1


def test_a_partition_a_page(spark):
    spark.dataSource.register(paged_source(source(23), SCHEMA, 5, name="devices"))
    df = spark.read.format("devices").load()
    assert df.rdd.getNumPartitions() == 5 and df.count() == 23


@pytest.mark.parametrize(
    "change, told",
    [
        (lambda page, got: got | {"list": got["list"][:-1]} if page == 2 else got, "items in place of"),
        (lambda page, got: got | {"list": [*got["list"], {"id": "x"}]} if page == 3 else got, "items in place of"),
        (lambda page, got: got | {"total": 24} if page == 2 else got, "the total changed"),
        (lambda page, got: got | {"total": None} if page == 2 else got, "the total changed"),
        (lambda page, got: got | {"total": -1}, "a total of"),
        (lambda page, got: got | {"list": [got["list"][0]] * len(got["list"])} if page == 2 else got, "twice in a page"),
        (lambda page, got: got | {"list": [{"id": "i0"}, *got["list"][1:]]} if page == 2 else got, "ids come twice"),
        (lambda page, got: got | {"list": [{"id": ""}, *got["list"][1:]]} if page == 2 else got, "no id"),
        (lambda page, got: {"total": 23} if page == 2 else got, "no list"),
    ],
)
def test_incomplete_snapshots_are_errors(spark, change, told):
    with pytest.raises(Exception, match=told) as e:
        read_paged(spark, source(23, change), SCHEMA, size=5).collect()
    assert told != "ids come twice" or isinstance(e.value, IncompleteError)


def test_a_growing_source_as_a_stream(spark, tmp_path):
    held = tmp_path / "items.json"

    def fetch(page, size, path=str(held)):
        with open(path, encoding="utf-8") as f:
            items = json.load(f)
        return {"total": len(items), "list": items[(page - 1) * size : page * size]}

    spark.dataSource.register(paged_source(fetch, SCHEMA, 4, name="growing"))
    for n in (3, 3, 11, 12):
        held.write_text(json.dumps([{"id": str(k), "name": None} for k in range(n)]))
        q = spark.readStream.format("growing").load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(120)
        assert q.exception() is None
        got = [r["id"] for r in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()]
        assert sorted(got, key=int) == [str(k) for k in range(n)]
