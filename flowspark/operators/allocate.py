"""Staff allocation over a few regions: demand, targets, movements, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def demand(regions: DataFrame, predicted_total: float, alpha: float = 0.3, beta: float = 0.7) -> DataFrame:
    """Demand of regions with a column crowd: current and predicted share; 1 each without any data."""
    everything = Window.partitionBy()
    total = F.sum("crowd").over(everything)
    share = F.when(total > 0, F.col("crowd") / total).otherwise(1.0 / F.count("*").over(everything))
    nothing = (total == 0) & F.lit(predicted_total == 0)
    return regions.withColumns({"predicted": predicted_total * share, "demand": F.when(nothing, 1.0).otherwise(alpha * F.col("crowd") + beta * predicted_total * share)})


def targets(demands: DataFrame, total: int, least: int = 1) -> DataFrame:
    """``demands`` (ordinal, demand, ...) with whole targets that sum to ``total``.

    A base each and the rest in proportion, rounded half to even; what rounding left over is given to, or taken from,
    one region each from the largest demand on, never below the base. With fewer officers than regions, the largest
    demands get one each; without any demand the rest is dealt evenly by ordinal. Regions are few: the windows over all
    of them run in one task.
    """
    every = Window.partitionBy()
    m = F.count("*").over(every)
    asked = F.sum("demand").over(every)
    known = demands.withColumns({"_m": m, "_asked": asked, "_rank": F.row_number().over(Window.orderBy(F.desc("demand"), "ordinal")), "_place": F.row_number().over(Window.orderBy("ordinal"))})
    base = F.least(F.lit(least), F.floor(F.lit(total) / F.col("_m")))
    rest = total - F.col("_m") * base
    even = F.floor(rest / F.col("_m")) + F.when(F.col("_place") <= rest % F.col("_m"), 1).otherwise(0)
    known = known.withColumn("_base", base).withColumn("_raw", base + F.when(F.col("_asked") > 0, F.rint(rest * F.col("demand") / F.col("_asked"))).otherwise(even).cast("int"))
    known = known.withColumn("_left", total - F.sum("_raw").over(every))
    above = F.sum((F.col("_raw") > F.col("_base")).cast("int")).over(Window.orderBy("_rank"))
    change = F.when(F.col("_rank") <= F.col("_left"), 1).when((F.col("_raw") > F.col("_base")) & (above <= -F.col("_left")), -1).otherwise(0)
    target = F.when(F.lit(total) < F.col("_m"), (F.col("_rank") <= total).cast("int")).otherwise(F.col("_raw") + change)
    return known.withColumn("target", target.cast("int")).select(*demands.columns, "target")


def movements(plan: DataFrame, limit: int) -> DataFrame:
    """Moves from regions with officers to spare to those that lack some, nearest pairs first, ``limit`` in all.

    Each move depends on those before it: the pairs, in order, are folded in one row of arrays. Regions are few.
    """
    own = F.struct("ordinal", "region", "center_x", "center_y", (F.col("officers") - F.col("target")).cast("int").alias("spare"))
    regions = plan.agg(F.array_sort(F.collect_list(own)).alias("r"))
    far = lambda a, b: F.sqrt((a["center_x"] - b["center_x"]) * (a["center_x"] - b["center_x"]) + (a["center_y"] - b["center_y"]) * (a["center_y"] - b["center_y"]))
    met = lambda a, i: F.transform("r", lambda b, j: F.when((a["spare"] > 0) & (b["spare"] < 0), F.struct(far(a, b).alias("distance"), i.alias("i"), j.alias("j"))))
    pairs = regions.withColumn("pairs", F.array_sort(F.array_compact(F.flatten(F.transform("r", met)))))
    start = F.struct(F.transform("r", lambda a: a["spare"]).alias("spare"), F.lit(limit).alias("left"), F.array().cast("array<struct<i:int,j:int,count:int,distance:double>>").alias("moves"))

    def move(done: Column, p: Column) -> Column:
        n = F.greatest(F.lit(0), F.least(F.get(done["spare"], p["i"]), -F.get(done["spare"], p["j"]), done["left"]))
        spare = F.transform(done["spare"], lambda s, k: s - F.when(k == p["i"], n).when(k == p["j"], -n).otherwise(0))
        more = F.when(n > 0, F.array_append(done["moves"], F.struct(p["i"].alias("i"), p["j"].alias("j"), n.alias("count"), p["distance"].alias("distance")))).otherwise(done["moves"])
        return F.struct(spare.alias("spare"), (done["left"] - n).alias("left"), more.alias("moves"))

    moved = pairs.select("r", F.explode(F.aggregate("pairs", start, move)["moves"]).alias("m"))
    return moved.select(F.get("r", F.col("m.i"))["region"].alias("from_region"), F.get("r", F.col("m.j"))["region"].alias("to_region"), "m.count", "m.distance")


def scores(plan: DataFrame, moves: DataFrame, total: int) -> DataFrame:
    """Coverage, efficiency and their weighted score."""
    moved = moves.agg(F.coalesce(F.max("distance"), F.lit(1.0)).alias("far"), F.coalesce(F.sum(F.col("distance") * F.col("count")), F.lit(0.0)).alias("work"))
    covered = plan.agg(F.avg(F.col("demand") / F.greatest(F.lit(1), F.col("target"))).alias("coverage"))
    far = F.when(F.col("far") == 0, 1.0).otherwise(F.col("far"))
    efficiency = 1.0 - F.col("work") / (total * far) if total > 0 else F.lit(1.0)
    return covered.join(F.broadcast(moved)).select("coverage", efficiency.alias("efficiency")).withColumn("score", 0.7 * F.least("coverage", F.lit(1.0)) + 0.3 * F.greatest(F.lit(0.0), "efficiency"))


def next_round(plan: DataFrame) -> DataFrame:
    """The plan's regions with the targets as the officers of the next round."""
    return plan.withColumn("officers", F.col("target")).drop("target")
