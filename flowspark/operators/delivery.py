"""Ordered delivery with retries: an outbox, and an append-only log of attempts.

The state of a row is read from the log, so that a round that dies after sending is repeated: at least once, in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.timing import backoff
from flowspark.operators.events import head_of_queue

LOG = "event_id long, at_us long, ok boolean, error string"


def pending(outbox: DataFrame, log: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows that no attempt delivered, with ``attempts`` and ``due_us``: when the next one is due, 0 before the first."""
    tried = log.groupBy(key).agg(F.count("*").alias("attempts"), F.max("at_us").alias("_last"), F.max("ok").alias("_ok"))
    rows = outbox.join(tried, key, "left").where(~F.coalesce("_ok", F.lit(False)))
    wait = F.when(F.col("attempts") > 0, F.col("_last") + backoff("attempts").cast("long") * 1_000_000).otherwise(0)
    return rows.withColumns({"attempts": F.coalesce("attempts", F.lit(0)).cast("long"), "due_us": wait}).drop("_last", "_ok")


def due_heads(outbox: DataFrame, log: DataFrame, now_us: Column | int, queue: str = "device_id", order: str = "event_id") -> DataFrame:
    """The oldest pending row of each queue, if it is due: a head that waits holds the rows after it."""
    return head_of_queue(pending(outbox, log), queue, order, F.col("due_us") <= now_us)


def deliver(outbox: DataFrame, log_path: str, send: Callable[[pd.DataFrame], list[bool]], now_us: int, queue: str = "device_id") -> None:
    """One round: send the due heads in batches on the executors and append what came of each.

    ``send`` tells for each row whether it arrived; a batch for which it raises counts as refused, with the error in the
    log.
    """
    spark = outbox.sparkSession
    heads = due_heads(outbox, spark.read.schema(LOG).parquet(log_path), now_us, queue)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            error = None
            try:
                ok = [bool(x) for x in send(rows)]
            except Exception as e:  # noqa: BLE001 whatever the other side does, the round goes on and the row waits
                ok, error = [False] * len(rows), repr(e)
            yield pd.DataFrame({"event_id": rows["event_id"], "at_us": now_us, "ok": ok, "error": pd.Series([error] * len(rows), rows.index, dtype=object)})

    heads.mapInPandas(run, LOG).write.mode("append").parquet(log_path)
