"""Audit of service logs: lines (line_no, value) to headers, markers, statistics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.text import MARKERS, METRICS, metric, rejections
from flowspark.operators.quantiles import quantiles

#: Fixed value: the log format.
HEADER = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+) \|\s*(\w+)\s*\|\s*([^ ]+) - (.*)$"


def parsed(lines: DataFrame) -> DataFrame:
    """time, level, function, message and device of each line; ``matched`` is false for others."""
    part = lambda i: F.regexp_extract("value", HEADER, i)
    return lines.select("line_no", F.col("value").rlike(HEADER).alias("matched"), part(1).alias("time"), part(2).alias("level"), F.regexp_replace(part(3), r":[^:]*$", "").alias("function"), part(4).alias("message")).withColumn("device", F.nullif(F.regexp_extract("message", r"^\[([^]]+)\]", 1), F.lit("")))


def totals(rows: DataFrame, first: int = 20) -> DataFrame:
    """Lines, parsed ones, and the first unmatched line numbers."""
    counted = rows.agg(F.count("*").alias("lines"), F.count_if("matched").alias("parsed"))
    odd = rows.where(~F.col("matched")).select("line_no").orderBy("line_no").limit(first)
    return counted.join(F.broadcast(odd.agg(F.sort_array(F.collect_list("line_no")).alias("unmatched"))))


def markers(rows: DataFrame, references: int = 4) -> DataFrame:
    """How often each mark occurs, and its first lines. All marks are tested in one pass."""
    hits = F.explode(F.array_compact(F.array(*[F.when(F.contains("message", F.lit(text)), F.lit(name)) for name, text in MARKERS.items()])))
    each = rows.where("matched").select(hits.alias("marker"), "line_no")
    counts = each.groupBy("marker").agg(F.count("*").alias("n"))
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("marker").orderBy("line_no"))).where(F.col("r") <= references).groupBy("marker").agg(F.sort_array(F.collect_list("line_no")).alias("first_lines"))
    return counts.join(first, "marker")


def windows(rows: DataFrame) -> DataFrame:
    """Statistics lines of devices as columns; missing metrics are null."""
    seconds = F.nullif(F.regexp_extract("message", r"运行统计\((\d+)s\):", 1), F.lit("")).cast("int")
    return rows.where("matched and device is not null").withColumn("seconds", seconds).where("seconds is not null").select("line_no", "time", "device", "seconds", *[metric(F.col("message"), m).alias(m) for m in METRICS], metric(F.col("message"), "drop", 2).alias("drop_pct"), rejections(F.col("message")).alias("reject"))


def summary(stats: DataFrame) -> DataFrame:
    """n, mean, median, nearest-rank 95th hundredth, least and most of each metric."""
    names = [*METRICS, "drop_pct"]
    pairs = stats.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names])).alias("p")).select("p.*").where("v is not null")
    plain = pairs.groupBy("metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    ranks = quantiles(pairs, ["metric"], "v", {"p50": 0.5, "p95": 0.95}, between=("p50",))
    return plain.join(ranks, "metric").select("metric", "n", "mean", "p50", "p95", "least", "most")


def weighted_drop(stats: DataFrame) -> DataFrame:
    return stats.agg((100 * F.sum("drop") / F.sum("sampled")).alias("drop_pct"), (F.sum("sampled") / F.sum("seconds")).alias("sample_fps"), F.count_distinct("device").alias("devices"))


def reject_totals(stats: DataFrame) -> DataFrame:
    return stats.select(F.explode("reject").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


def report(stats: DataFrame, path: str) -> None:
    """A gzip JSON report."""
    stats.write.mode("overwrite").option("compression", "gzip").json(path)
