"""The one-row overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.functions.exprs import freshness, settled
from hostlens.operators.hosts import cpu_total, memory_total, reading_age
from hostlens.operators.keys import in_receipt
from hostlens.operators.snapshot import latest_samples
from hostlens.params import Params


def kpi_summary(
    samples: DataFrame,
    registry: DataFrame,
    alerts: DataFrame,
    now: float,
    params: Params = Params(),
    window: int | None = None,
) -> DataFrame:
    """Host, process, alert and load figures.

    Load covers processes heard of within ``offline_after``; samples received covers
    the window.
    """
    lookback = params.window if window is None else window
    status = freshness(reading_age(now), params.stale_after, params.offline_after)
    hosts = registry.select(status.alias("status")).agg(
        F.count_if(F.col("status") == "live").alias("live_hosts"),
        F.count("*").alias("total_hosts"),
        F.count_if(F.col("status") == "stale").alias("stale_hosts"),
        F.count_if(F.col("status") == "offline").alias("offline_hosts"),
    )
    latest = latest_samples(samples, now, max(params.offline_after, lookback))
    load = latest.filter(F.lit(float(now)) - F.col("received_at") <= params.offline_after).agg(
        F.struct(
            F.count_if(F.lower("state") == "running").alias("running"),
            settled(cpu_total(), 2).alias("cpu"),
            settled(memory_total(), 2).alias("memory"),
        )
    )
    received = in_receipt(samples, now - lookback).agg(F.count("*"))
    active = alerts.filter(F.col("status") == "active").agg(F.count("*"))
    rows = hosts.withColumns(
        {"__load": load.scalar(), "samples_received": received.scalar(), "active_alerts": active.scalar()}
    )
    healthy = F.floor(F.col("live_hosts") / F.col("total_hosts") * 100 + 0.5)
    return rows.select(
        "live_hosts",
        "total_hosts",
        "stale_hosts",
        "offline_hosts",
        F.col("__load.running").alias("total_running_processes"),
        "active_alerts",
        F.col("__load.cpu").alias("cpu_percent"),
        F.col("__load.memory").alias("memory_percent"),
        "samples_received",
        F.when(F.col("total_hosts") > 0, healthy).otherwise(F.lit(0)).alias("healthy_percent"),
    )
