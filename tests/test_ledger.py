"""The indexed ledger: what is read for a batch, repeats, conflicts, batches that die and run again."""

from __future__ import annotations

import pathlib
import shutil

import pytest
from pyspark.sql import functions as F

from flowspark.streaming.ledger import Ledger
from flowspark.streaming.streams import ConflictError

SCHEMA = "event_id string, kind string, evidence string"


def rows(spark, ids, kind="k", evidence='{"a": 1, "b": [2]}'):
    return spark.createDataFrame([(i, kind, evidence) for i in ids], SCHEMA)


def test_a_batch_reads_what_it_may_meet(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "l"), evidence="evidence", buckets=32, bits=1 << 12)
    ledger.append(rows(spark, [f"e{i}" for i in range(1500)]), 0)
    assert spark.read.parquet(ledger.path).select("event_id").distinct().count() == 1500
    assert len(list(pathlib.Path(ledger.path).glob("bucket=*"))) == 32
    fresh, again = (ledger._hashed(rows(spark, ids)) for ids in (["new1", "new2"], ["e7", "new3"]))
    assert ledger.maybe(fresh).count() == 0 and ledger.known(fresh, 1).count() == 0
    own = again.where("event_id = 'e7'").first()["bucket"]
    assert {r["bucket"] for r in ledger.maybe(again).collect()} == {own}
    files = [r[0] for r in ledger.known(again, 1).select(F.input_file_name()).distinct().collect()]
    assert files and all(f"bucket={own}/" in f for f in files)
    wrong = ledger.maybe(ledger._hashed(rows(spark, [f"n{i}" for i in range(2000)]))).count()
    assert wrong < 60


def test_repeats_and_conflicts(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "l"), evidence="evidence", buckets=4, bits=1 << 10)
    first = rows(spark, ["a", "b", "b", None, None])
    for _ in range(2):  # the same batch again changes nothing
        ledger.append(first, 0)
        assert sorted(str(r["event_id"]) for r in spark.read.parquet(ledger.path).collect()) == ["None", "None", "a", "b"]
    ledger.append(rows(spark, ["a", "c"], evidence='{"b":[2],"a":1}'), 1)
    assert spark.read.parquet(ledger.path).where("event_id is not null").count() == 3
    with pytest.raises(ConflictError, match="'a'"):
        ledger.append(rows(spark, ["a", "d"], kind="other"), 2)
    with pytest.raises(ConflictError):
        ledger.append(rows(spark, ["e"]).union(rows(spark, ["e"], kind="other")), 2)
    assert spark.read.parquet(ledger.path).where("event_id in ('d', 'e')").count() == 0
    ledger.append(rows(spark, ["a", "d"], kind="other"), 2, conflicts=str(tmp_path / "odd"))
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "odd")).collect()] == ["a"]
    assert spark.read.parquet(ledger.path).where(F.col("event_id").isin("a", "d")).select("event_id", "kind").distinct().count() == 2


def test_a_batch_that_died_runs_again(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "l"), buckets=2, bits=1 << 10)
    batch = rows(spark, ["a", "b"])
    ledger._add_to_filters(ledger._hashed(batch))  # it died before its rows were written
    ledger.append(batch, 0)
    assert spark.read.parquet(ledger.path).count() == 2
    shutil.rmtree(ledger.filters)  # filters that are lost mean maybe
    ledger.append(rows(spark, ["a", "c"]), 1)
    assert sorted(r["event_id"] for r in spark.read.parquet(ledger.path).collect()) == ["a", "b", "c"]
