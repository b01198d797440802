"""Queries against their SQL where doubles decide: crossing points on a rounding tie, stitched pairs of nearly equal error."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest

from flowspark import plans


def both(spark, tmp_path, name, events):
    """Rows of the query and of its SQL over events (user, value, k), a second apart."""
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), user, "view", value, f'{{"k": {k}}}') for i, (user, value, k) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = plans.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({plans.SQL[name]})").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(want)


def test_crossing_points_on_a_tie(spark, tmp_path):
    got, want = both(spark, tmp_path, "cep05_candidate_crossings", [(854, 50.14, 69), (854, 73.39, 55), (130, 144.73, 67), (130, 90.48, 73)])
    assert got == want and len(got) == 2


@pytest.mark.parametrize("seed", range(3))
def test_stitched_pairs_of_nearly_equal_error(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = [(1 + 96 * (i % 60), rng.randrange(11) * 10.0, rng.randrange(11) * 10) for i in range(60 * 200)]
    got, want = both(spark, tmp_path, "join19_track_stitching", events)
    assert got == want and got
