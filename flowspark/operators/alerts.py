"""Threshold alerts and their suppression."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from flowspark.operators.enrich import small
from flowspark.operators.folds import fold_sorted

#: A slice of time in cooldowns.
SLICE = 64
RULES = "rule_id string, category string, metric string, threshold double, level string, message string"


def crossed(metrics: DataFrame, rules: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rules that metrics reach, one row each, with the message filled in. ``metrics`` are columns ``names``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    long = metrics.select(*keys, pairs.alias("m")).select(*keys, "m.*")
    hit = long.join(small(rules), "metric").where("value >= threshold")
    text = F.replace(F.replace("message", F.lit("{value}"), F.col("value").cast("long").cast("string")), F.lit("{threshold}"), F.col("threshold").cast("long").cast("string"))
    return hit.withColumn("message", text)


def _chain_ends(us: np.ndarray, step: int) -> np.ndarray:
    """Of each of rising times: the last one emitted, if it is emitted and each next one is the first ``step`` later."""
    nxt = np.searchsorted(us, us + step)
    end = np.where(nxt < len(us), nxt, np.arange(len(us)))
    while not np.array_equal(further := end[end], end):  # doubles the steps taken
        end = further
    return us[end]


def _after(slices: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """For each slice of a key, the last time emitted after it as a step function of the last time emitted before it.

    One row a slice: of rising ``ends``, the first one at least the cooldown after the last emission tells which of
    ``lasts`` is the last one then; beyond all ``ends``, nothing in the slice is emitted. Only times within one cooldown
    of the slice's start, and the next one, can be its first emission; others need no step.
    """
    step = seconds * 1_000_000
    kinds = [slices.schema[c] for c in keys]
    schema = StructType([*kinds, StructField("_slice", LongType()), StructField("ends", ArrayType(LongType())), StructField("lasts", ArrayType(LongType()))])
    out = to_arrow_schema(schema)

    def gather(key: tuple, part: pa.Table, held: list | None) -> tuple[pa.Table, list]:
        return out.empty_table(), [*(held or []), np.unique(part["us"].to_numpy())]

    def finish(key: tuple, held: list) -> pa.Table:
        us = np.unique(np.concatenate(held))
        first = int(np.searchsorted(us, key[-1] * SLICE * step + step - 1)) + 1
        lasts = _chain_ends(us, step)[:first]
        ends = us[:first]
        cut = np.append(lasts[1:] != lasts[:-1], True)
        return pa.table([pa.array([k], f.type) for k, f in zip(key, out, strict=False)] + [pa.array([ends[cut].tolist()], pa.list_(pa.int64())), pa.array([lasts[cut].tolist()], pa.list_(pa.int64()))], schema=out)

    return fold_sorted(slices.select(*keys, "_slice", "us"), [*keys, "_slice"], ["us"], gather, schema, finish=finish)


def _before(functions: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """(keys, _slice, _last): the last time emitted before each slice, by applying the slices' functions in order.

    Slices are as many as the time that a key's alerts span has room for, whatever their number.
    """
    step = seconds * 1_000_000
    schema = StructType([*functions.schema.fields[: len(keys) + 1], StructField("_last", LongType())])
    out = to_arrow_schema(schema)

    def run(key: tuple, part: pa.Table, last: int | None) -> tuple[pa.Table, int | None]:
        had = []
        for ends, lasts in zip(part["ends"], part["lasts"], strict=True):
            had.append(last)
            e = ends.values.to_numpy()
            i = 0 if last is None else int(np.searchsorted(e, last + step))
            last = last if i == len(e) else lasts.values[i].as_py()
        return pa.table([*part.select([*keys, "_slice"]).columns, pa.array(had, pa.int64())], schema=out), last

    return fold_sorted(functions, keys, ["_slice"], run, schema)


def suppressed(alerts: DataFrame, keys: list[str], seconds: int, order: str = "us") -> DataFrame:
    """The first alert of each key, then the first one at least ``seconds`` after the last that was emitted.

    A key's time is cut into slices of ``SLICE`` cooldowns, so that one key may have as many tasks as slices: each slice
    tells what it makes of the last emission before it, these step functions are applied one after the other, and then
    every slice emits by itself. Of equal times, the first by the other columns in their order. Alerts without a time
    are all emitted, and all alerts where ``seconds`` is 0.
    """
    if seconds <= 0:
        return alerts
    others = [c for c in alerts.columns if c not in (*keys, order)]
    names = [*keys, "us", *others]
    rows = alerts.select(*keys, F.col(order).alias("us"), *others)
    dealt = rows.where("us is not null").withColumn("_slice", F.floor(F.col("us") / (SLICE * seconds * 1_000_000)).cast("long"))
    before = _before(_after(dealt, keys, seconds), keys, seconds)
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "_slice"]])
    timed = dealt.alias("a").join(before.alias("b"), same).select("a.*", "b._last")

    def fold(key: tuple, part: pa.Table, last: int | None) -> tuple[pa.Table, int | None]:
        us, kept = part["us"].to_numpy(), []
        last = part["_last"][0].as_py() if last is None else last
        i = 0 if last is None else int(np.searchsorted(us, last + seconds * 1_000_000))
        while i < len(us):
            last = int(us[i])
            kept.append(i)
            i = int(np.searchsorted(us, last + seconds * 1_000_000))
        return part.select(names).take(pa.array(kept, pa.int64())), last

    emitted = fold_sorted(timed, [*keys, "_slice"], ["us", *others], fold, rows.schema)
    return emitted.union(rows.where("us is null")).withColumnRenamed("us", order).select(*alerts.columns)


def message(template: str, **columns: Column) -> Column:
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out
