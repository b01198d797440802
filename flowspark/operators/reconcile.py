"""Reconciliation of the local journal, the ledger and the deduplication digests; channel registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(journal: DataFrame, ledger: DataFrame, dedup: DataFrame) -> DataFrame:
    """(event_id, outcome), several for an event.

    ``journal``: event_id, digest, identity, delivered, applied; ``ledger``: event_id, payload_hash, materialized;
    ``dedup``: event_id, cached (a digest of identity).
    """
    led = ledger.select("event_id", "payload_hash", "materialized", F.lit(True).alias("in_ledger"))
    rows = journal.withColumn("in_journal", F.lit(True)).join(led, "event_id", "full_outer").join(dedup.select("event_id", "cached"), "event_id", "left")
    mine, theirs = F.col("in_journal").isNotNull(), F.col("in_ledger").isNotNull()
    first = F.when(mine & ~theirs, F.when(F.col("delivered").isNull(), "ledger_missing_pending").when(F.col("applied").isNull(), "legacy_delivered_without_ledger").otherwise("ledger_missing_delivered_v2")).when(mine, F.when(F.col("digest") == F.col("payload_hash"), "ledger_match").otherwise("ledger_payload_conflict")).otherwise("backend_only_candidate")
    second = F.when(mine & theirs & F.col("delivered").isNull(), "ledger_received_local_pending")
    cached = F.col("cached").isNotNull()
    third = F.when(
        mine,
        F.when(cached & (F.col("cached") != F.col("identity")), "redis_payload_conflict")
        .when(theirs & F.col("materialized").isNotNull() & ~cached, "materialized_missing_redis")
        .when(theirs & F.col("materialized").isNull() & cached, "redis_applied_ledger_pending")
        .when(cached, "redis_match"),
    )
    return rows.select("event_id", F.explode(F.array_compact(F.array(first, second, third))).alias("outcome"))


def summary(found: DataFrame, samples: int = 5) -> DataFrame:
    """Number and first ids of each outcome. Ids beyond the first few of a task don't travel."""
    counts = found.groupBy("outcome").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    first = found.withColumn("r", F.row_number().over(Window.partitionBy("outcome").orderBy("event_id"))).where(F.col("r") <= samples).groupBy("outcome").agg(F.sort_array(F.collect_list("event_id")).alias("sample"))
    return counts.join(first, "outcome")


def channel_actions(remote: DataFrame, local: DataFrame) -> DataFrame:
    """What to do with each channel: ``remote`` (channel, name, online or null), ``local`` (channel, name, running, enabled)."""
    r = remote.select("channel", F.col("name").alias("remote_name"), "online", F.lit(True).alias("there"))
    both = r.join(local.select("channel", "name", "running", "enabled", F.lit(True).alias("here")), "channel", "full_outer")
    action = (
        F.when(F.col("here").isNull(), "add")
        .when(F.col("there").isNull(), F.when(F.col("running"), "stop").otherwise("keep"))
        .when(F.col("online").isNull(), "preserve")
        .when(F.col("online") & F.col("enabled") & ~F.col("running"), "start")
        .when(~F.col("online") & F.col("running"), "stop")
        .when(F.col("remote_name") != F.col("name"), "rename")
        .otherwise("keep")
    )
    return both.select("channel", action.alias("action"))
