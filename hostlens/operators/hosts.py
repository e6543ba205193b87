"""Host registry, summaries and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.functions.exprs import freshness
from hostlens.operators.keys import in_receipt
from hostlens.params import Params, activity_bucket

ACTIVITY_POINTS = 13
SPARK_POINTS = 12


def host_registry(accepted: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """First and last receipt and accepted rows per host, merged with an earlier registry."""
    fresh = accepted.groupBy("host").agg(
        F.min("received_at").alias("first_seen"),
        F.max("received_at").alias("last_seen"),
        F.count("*").alias("sample_count"),
    )
    if previous is None:
        return fresh
    return (
        fresh.unionByName(previous.select(*fresh.columns))
        .groupBy("host")
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.sum("sample_count").alias("sample_count"),
        )
    )


def reading_age(now: float, seen: str = "last_seen") -> Column:
    return F.greatest(F.lit(0.0), F.lit(float(now)) - F.col(seen))


def active_alert_counts(alerts: DataFrame) -> DataFrame:
    return (
        alerts.filter(F.col("status") == "active").groupBy("host").agg(F.count("*").alias("active_alert_count"))
    )


def cpu_total() -> Column:
    return F.coalesce(F.sum(F.greatest(F.coalesce("cpu_percent", F.lit(0.0)), F.lit(0.0))), F.lit(0.0))


def memory_total() -> Column:
    return F.least(F.lit(100.0), F.coalesce(F.sum(F.greatest("memory_percent", F.lit(0.0))), F.lit(0.0)))


def host_summary(
    registry: DataFrame, latest: DataFrame, alerts: DataFrame, now: float, params: Params = Params()
) -> DataFrame:
    """One row per known host; load is zero for hosts offline by the fixed or the given limit."""
    load = latest.groupBy("host").agg(
        F.count("*").alias("process_count"), cpu_total().alias("cpu_percent"), memory_total().alias("memory_percent")
    )
    zero_after = min(Params.offline_after, params.offline_after)
    rows = (
        registry.join(load, "host", "left")
        .join(active_alert_counts(alerts), "host", "left")
        .withColumn("last_seen_age_seconds", reading_age(now))
    )
    age = F.col("last_seen_age_seconds")

    def while_online(name: str) -> Column:
        zero = F.lit(0) if name == "process_count" else F.lit(0.0)
        return F.when(age > zero_after, zero).otherwise(F.coalesce(name, zero)).alias(name)

    return rows.select(
        "host",
        "first_seen",
        "last_seen",
        "last_seen_age_seconds",
        freshness(age, params.stale_after, params.offline_after).alias("status"),
        while_online("process_count"),
        while_online("cpu_percent"),
        while_online("memory_percent"),
        "sample_count",
        F.coalesce("active_alert_count", F.lit(0)).alias("active_alert_count"),
    )


def host_cards(summary: DataFrame, k: int = 6) -> DataFrame:
    """First hosts by name, ignoring case."""
    return summary.orderBy(F.lower("host"), "host").limit(k)


def host_activity(registry: DataFrame, samples: DataFrame, now: float, lookback: int = 3600) -> DataFrame:
    """Samples received per host on a dense grid of 13 buckets, with sparkline heights.

    Only the last 12 points are drawn; the height of the first is null.
    """
    width = activity_bucket(lookback)
    start = now - lookback
    first = int(start / width)
    slot = F.floor(F.col("received_at") / width)
    counts = (
        in_receipt(samples, start)
        .groupBy("host", slot.alias("slot"))
        .agg(F.count("*").alias("value"))
    )
    grid = registry.select("host", F.explode(F.sequence(F.lit(0), F.lit(ACTIVITY_POINTS - 1))).alias("position"))
    grid = grid.withColumn("slot", F.lit(first).cast("long") + F.col("position"))
    peak = F.greatest(F.lit(1), F.max("value").over(W.partitionBy("host")))
    height = F.greatest(F.lit(3), F.floor(F.col("value") / peak * 18 + 0.5))
    return (
        grid.join(counts, ["host", "slot"], "left")
        .withColumn("value", F.coalesce("value", F.lit(0)))
        .withColumn("height", F.when(F.col("position") >= ACTIVITY_POINTS - SPARK_POINTS, height))
        .select("host", "position", (F.col("slot") * width).cast("double").alias("timestamp"), "value", "height")
    )
