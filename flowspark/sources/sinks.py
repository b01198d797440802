"""Tables and files that results go to: dimensions, archives, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def upsert_partitions(rows: DataFrame, path: str, column: str = "stat_date") -> None:
    """Replace the partitions that ``rows`` hold; others stay. Again with the same rows: no change."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def merge_hours(rows: DataFrame, path: str, keys: tuple[str, ...] = ("device_id", "stat_date", "hour")) -> None:
    """Upsert by key into an archive by date: only the dates touched are read and written."""
    spark = rows.sparkSession
    if not exists(spark, path):
        upsert_partitions(rows, path)
        return
    dates = rows.select("stat_date").distinct()
    # an archive of no rows has no file to tell its columns
    old = spark.read.schema(rows.schema).parquet(path).join(F.broadcast(dates), "stat_date", "left_semi")
    merged = rows.unionByName(old.join(rows.select(*keys), list(keys), "left_anti").select(*rows.columns))
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    upsert_partitions(spark.read.parquet(staged), path)
    _remove(rows, staged)


def drop_before(path: str, rows: DataFrame, cutoff: str, column: str = "stat_date") -> list[str]:
    """Retention: remove the partitions of dates before ``cutoff``; their names. ``rows``: any frame of the session."""
    spark = rows.sparkSession
    days = [r[0] for r in spark.read.parquet(path).select(F.col(column).cast("string")).distinct().where(F.col(column) < cutoff).collect()]
    for d in days:
        _remove(rows, f"{path}/{column}={d}")
    return sorted(days)


def _remove(df: DataFrame, path: str) -> None:
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def upserted(dim: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``dim`` with ``changes``: null columns of a change keep the old value; new keys are added."""
    c = changes.select(F.col(key), *[F.col(n).alias(f"_{n}") for n in changes.columns if n != key], F.lit(True).alias("_c"))
    both = dim.join(c, key, "full_outer")
    return both.select(key, *[F.coalesce(f"_{n}", n).alias(n) if n in changes.columns else F.col(n) for n in dim.columns if n != key])


def deleted(dim: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return dim.join(keys.select(key), key, "left_anti")


def replace_table(rows: DataFrame, path: str) -> None:
    """Truncate and load."""
    rows.write.mode("overwrite").parquet(path)


def append_capped(rows: DataFrame, path: str) -> None:
    """Append; the cap of a list is applied where it is read (``newest``)."""
    rows.write.mode("append").parquet(path)


def newest(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last ``n`` rows by arrival; none for 0. More than a thousand are not served."""
    return rows.orderBy(F.desc(order)).limit(max(0, min(n, 1000)))


def write_report(path: str, events: DataFrame, statistics: DataFrame, **more: DataFrame) -> None:
    """An offline report: statistics as CSV; events and ``more`` (alarms, anomalies, summary, trace) as JSON, a folder each."""
    for name, rows in {"events": events, **more}.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
    statistics.write.mode("overwrite").option("header", True).csv(f"{path}/statistics")
