"""Interval series and short forecasts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.arrays import digest_number, pairwise_sum

STEP_US = 60_000_000


def series(events: DataFrame, now_us: Column | int, minutes: int = 15, steps: int = 30, kind: str | None = None) -> DataFrame:
    """One row: counts of the last ``steps`` intervals before ``now_us``, oldest first, gaps filled with 0."""
    width = minutes * STEP_US
    last = F.floor(F.lit(now_us) / width)
    rows = events if kind is None else events.where(F.startswith("event_type", F.lit(kind)))
    counted = rows.withColumn("slot", F.floor(F.col("us") / width)).where((F.col("slot") > last - steps) & (F.col("slot") <= last)).groupBy("slot").agg(F.count("*").alias("n"))
    one = counted.agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m")).withColumn("last", last)
    return one.select(F.transform(F.sequence(F.col("last") - steps + 1, F.col("last")), lambda s: F.coalesce(F.element_at("m", s), F.lit(0))).alias("history"))


def converted(history: Column, seed: int = 1) -> Column:
    """Vehicles as persons: 2 to 5 each, by a hash of place and number."""
    return F.transform(history, lambda n, i: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0).cast("bigint"), lambda a, j: a + F.when(j <= n, digest_number(i, j, F.lit(seed)) % 4 + 2).otherwise(0)))


def trend(history: Column, most: int = 24) -> Column:
    """The next value on the line from the first to the last of at most ``most`` values, not below 0."""
    some = F.greatest(F.lit(1), F.least(F.size(history), F.lit(most)))
    h = F.slice(history, -some, some)
    n = F.size(h)
    last, first = F.get(h, n - 1).cast("double"), F.get(h, F.lit(0)).cast("double")
    return F.when(n == 0, 0.0).when(n == 1, F.greatest(F.lit(0.0), last)).otherwise(F.greatest(F.lit(0.0), last + (last - first) / (n - 1)))


def by_model(model: Callable[[list[np.ndarray]], np.ndarray]) -> Callable[[Column], Column]:
    """A forecast by ``model``, which gives the quantiles of the next value for a batch of histories, a row each.

    Their mean, not below 0, is the forecast. Where the model raises or gives no finite value, the trend stands in.
    """

    @F.pandas_udf("double")
    def predict(histories: pd.Series) -> pd.Series:
        try:
            quantiles = np.asarray(model([np.asarray(h, float) for h in histories]), float)
            mean = np.maximum(0.0, quantiles.reshape(len(histories), -1).mean(axis=1))
        except Exception:  # noqa: BLE001 a model that fails must not take the forecast with it
            mean = np.full(len(histories), np.nan)
        return pd.Series(mean).where(np.isfinite(mean), None)

    return lambda history: F.coalesce(predict(F.coalesce(history.cast("array<double>"), F.array().cast("array<double>"))), trend(history))


def total_persons(vehicles: DataFrame, persons: DataFrame, model=trend) -> DataFrame:
    """History of persons with vehicles' passengers, and the forecast by ``model``, a function of the history column."""
    both = vehicles.select(converted(F.col("history")).alias("v")).join(F.broadcast(persons.select(F.col("history").alias("p"))))
    return both.select(pairwise_sum(F.col("v"), F.col("p")).alias("history")).withColumn("predicted_total", model(F.col("history")))
