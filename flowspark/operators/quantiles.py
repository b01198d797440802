"""Exact order statistics by distributed selection, so that no task holds or sorts a group's values.

A sketch of bounded size tells about where a rank lies: between two values that some hundredths of a percent of the rows
lie between. Exact counts below, at, between and above these two say in which part the rank is, and only that part is
looked into further. When few values are left, or only equal ones, the rank is read off. A round leaves some 300th of
the values, whatever their distribution; a wrong guess of the sketch costs another round, never a wrong rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators.enrich import small
from flowspark.sources.saved import saved

#: Cells of the sketch, and its accuracy.
CELLS, ACCURACY = 1024, 10_000
#: Values that a task may sort.
FEW = 100_000


def _ranks(n: Column, share: float, between: bool) -> Column:
    """(rank from 1, weight) of the values that make up the quantile of n values."""
    if not between:
        return F.array(F.struct(F.greatest(F.lit(1), F.ceil(n * share)).cast("long").alias("rank"), F.lit(1.0).alias("weight")))
    at = (n - 1) * share
    low = F.floor(at)
    both = F.array(F.struct((low + 1).cast("long").alias("rank"), (1 - (at - low)).alias("weight")), F.struct((low + 2).cast("long").alias("rank"), (at - low).alias("weight")))
    return F.filter(both, lambda x: (x["weight"] > 0) | (x["rank"] == 1))


def _same(keys: list[str], mark: str) -> Column:
    """Keys equal to those named with ``mark``; nulls are equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
    return out


def _within(data: DataFrame, spans: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Values of ``data`` in the ``spans`` (_lo to _hi) of their keys, once for each span, with _l, _h and ``more`` of it."""
    named = spans.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), *more)
    return data.join(small(named), _same(keys, "_s_") & F.col("_v").between(F.col("_l"), F.col("_h"))).drop(*[f"_s_{k}" for k in keys])


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], between: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """The ``wanted`` quantiles of ``value`` for each of ``keys``, as columns: nearest rank, or, of those named in
    ``between``, interpolated between the two nearest.

    Nulls and NaNs are left out; a group without values has no row. Null keys are a group. Jobs run when this is called,
    where a group has more than ``few`` values.
    """
    data = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    groups = data.groupBy(*keys).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    def named(name: str, p: float) -> Column:
        return F.transform(_ranks(F.col("_c"), p, name in between), lambda r: F.struct(F.lit(name).alias("name"), r["rank"].alias("rank"), r["weight"].alias("weight")))

    asked = F.explode(F.concat(*[named(name, p) for name, p in wanted.items()]))
    targets = saved(groups.select(*keys, "_c", "_lo", "_hi", asked.alias("_a")).select(*keys, "_c", "_lo", "_hi", "_a.*"))
    grid = F.array(*[F.lit(i / CELLS) for i in range(CELLS + 1)])
    while not (open_ := targets.where((F.col("_c") > few) & (F.col("_lo") < F.col("_hi")))).isEmpty():
        inside = _within(data, open_.select(*keys, "_lo", "_hi").distinct(), keys)
        sketch = inside.groupBy(*keys, "_l", "_h").agg(F.percentile_approx("_v", grid, ACCURACY).alias("_g"))
        sketch = sketch.select(*[F.col(k).alias(f"_p_{k}") for k in keys], "_l", "_h", "_g")
        cell = F.floor(F.col("rank") / F.col("_c") * CELLS).cast("int")
        at = lambda i: F.get("_g", F.least(F.greatest(i, F.lit(0)), F.lit(CELLS)))
        guess = open_.join(sketch, _same(keys, "_p_") & (F.col("_l") == F.col("_lo")) & (F.col("_h") == F.col("_hi")))
        guess = saved(guess.select(*keys, "_c", "_lo", "_hi", "name", "rank", "weight", at(cell - 1).alias("_a"), at(cell + 2).alias("_b")))
        met = _within(data, guess.select(*keys, "_lo", "_hi", "_a", "_b").distinct(), keys, "_a", "_b")
        v = F.col("_v")
        part = F.when(v < F.col("_a"), 0).when(v == F.col("_a"), 1).when(v < F.col("_b"), 2).when(v == F.col("_b"), 3).otherwise(4)
        own = [*keys, "_l", "_h", "_a", "_b"]
        counts = met.withColumn("_k", part).groupBy(*own, "_k").agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        upto = F.sum("_n").over(Window.partitionBy(*own).orderBy("_k"))
        parts = counts.select(*[F.col(k).alias(f"_p_{k}") for k in keys], "_l", "_h", F.col("_a").alias("_x"), F.col("_b").alias("_y"), "_n", "_min", "_max", (upto - F.col("_n")).alias("_before"))
        mine = _same(keys, "_p_") & (F.col("_l") == F.col("_lo")) & (F.col("_h") == F.col("_hi")) & (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b")) & (F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_n"))
        closer = guess.join(parts, mine).select(*keys, F.col("_n").alias("_c"), F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), "name", (F.col("rank") - F.col("_before")).alias("rank"), "weight")
        targets = saved(targets.where((F.col("_c") <= few) | (F.col("_lo") >= F.col("_hi"))).unionByName(closer))
    alike = targets.where("_lo = _hi").select(*keys, "name", "weight", F.col("_lo").alias("_v"))
    rest = targets.where("_lo < _hi")
    near = _within(data, rest.select(*keys, "_lo", "_hi").distinct(), keys)
    ordered = near.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_l", "_h").orderBy("_v")))
    ordered = ordered.select(*[F.col(k).alias(f"_p_{k}") for k in keys], "_l", "_h", "_r", "_v")
    found = _same(keys, "_p_") & (F.col("_l") == F.col("_lo")) & (F.col("_h") == F.col("_hi")) & (F.col("_r") == F.col("rank"))
    read = rest.join(ordered, found).select(*keys, "name", "weight", "_v").unionByName(alike)
    sums = [F.sum(F.when(F.col("name") == n, F.when(F.col("weight") == 1, F.col("_v")).otherwise(F.col("_v") * F.col("weight")))).alias(n) for n in wanted]
    return read.groupBy(*keys).agg(*sums)
