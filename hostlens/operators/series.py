"""Bucketed series over samples and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.functions.exprs import bucket, settled
from hostlens.operators.keys import in_time
from hostlens.params import series_bucket


def metric_series(samples: DataFrame, now: float, lookback: int = 3600, host: str | None = None) -> DataFrame:
    """Average CPU and memory and sample count per time bucket."""
    rows = in_time(samples, now - lookback)
    if host:
        rows = rows.filter(F.col("host") == host)
    return rows.groupBy(bucket(F.col("timestamp"), series_bucket(lookback)).alias("bucket")).agg(
        settled(F.coalesce(F.avg("cpu_percent"), F.lit(0.0)), 3).alias("cpu"),
        settled(F.coalesce(F.avg("memory_percent"), F.lit(0.0)), 3).alias("memory"),
        F.count("*").alias("activity"),
    )


def alert_series(alerts: DataFrame, now: float, lookback: int = 3600, host: str | None = None) -> DataFrame:
    """Alerts triggered per time bucket."""
    rows = alerts.filter(F.col("triggered_at") >= now - lookback)
    if host:
        rows = rows.filter(F.col("host") == host)
    return rows.groupBy(bucket(F.col("triggered_at"), series_bucket(lookback)).alias("bucket")).agg(
        F.count("*").alias("alerts")
    )


def metrics_summary(
    samples: DataFrame, alerts: DataFrame, now: float, lookback: int = 3600, host: str | None = None
) -> DataFrame:
    """The four dashboard series in long form: cpu, memory, activity and alerts."""
    metrics = metric_series(samples, now, lookback, host).select(
        F.expr(
            "stack(3, 'cpu', cpu, 'memory', memory, 'activity', cast(activity AS double)) AS (series, value)"
        ),
        F.col("bucket").alias("timestamp"),
    )
    counts = alert_series(alerts, now, lookback, host).select(
        F.lit("alerts").alias("series"),
        F.col("alerts").cast("double").alias("value"),
        F.col("bucket").alias("timestamp"),
    )
    return metrics.unionByName(counts).select("series", "timestamp", "value")


def series_bounds(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Chart range per series; equal bounds are opened by one on each side, nulls do not count."""
    low, high = F.col("__low"), F.col("__high")
    return (
        series.filter(F.col("value").isNotNull())
        .groupBy(*(keys or ["series"]))
        .agg(F.min("value").alias("__low"), F.max("value").alias("__high"))
        .select(
            *(keys or ["series"]),
            F.when(low == high, F.greatest(F.lit(0.0), low - 1)).otherwise(low).alias("low"),
            F.when(low == high, high + 1).otherwise(high).alias("high"),
        )
    )
