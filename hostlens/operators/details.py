"""Views that put several reports together: overview, one host, one process instance."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.operators.alerts import instance_alerts, recent_alerts
from hostlens.operators.hosts import host_activity, host_registry, host_summary
from hostlens.operators.kpis import kpi_summary
from hostlens.operators.series import metrics_summary
from hostlens.operators.snapshot import instance_current, instance_history, instance_series, latest_samples, resolve_instance, top_processes
from hostlens.params import Params, clamp_window


class Overview(NamedTuple):
    kpis: DataFrame
    hosts: DataFrame
    activity: DataFrame


class HostDetail(NamedTuple):
    summary: DataFrame
    top_cpu: DataFrame
    top_memory: DataFrame
    recent_alerts: DataFrame
    series: DataFrame


class ProcessDetail(NamedTuple):
    current: DataFrame
    history: DataFrame
    alerts: DataFrame
    series: DataFrame


def overview(
    samples: DataFrame,
    alerts: DataFrame,
    now: float,
    params: Params = Params(),
    window: int | None = None,
    registry: DataFrame | None = None,
) -> Overview:
    """KPIs, host summaries and host activity; load looks back at least to the offline limit.

    ``registry`` is the kept host table: with it, hosts whose samples have all been pruned still
    appear and no read of all samples is needed. Without it the hosts of ``samples`` count.
    """
    lookback = clamp_window(window, params.window)
    reach = int(max(params.offline_after, lookback))
    registry = host_registry(samples) if registry is None else registry
    return Overview(
        kpi_summary(samples, registry, alerts, now, params, lookback),
        host_summary(registry, latest_samples(samples, now, reach), alerts, now, params),
        host_activity(registry, samples, now, reach),
    )


def host_detail(
    samples: DataFrame,
    alerts: DataFrame,
    host: str,
    now: float,
    params: Params = Params(),
    window: int | None = None,
    registry: DataFrame | None = None,
) -> HostDetail:
    """One host: summary, top processes, newest alerts and its series; empty for an unknown host.

    ``registry`` is the kept host table, as in ``overview``.
    """
    lookback = clamp_window(window, max(params.window, int(params.offline_after)))
    own = samples.filter(F.col("host") == host)
    warned = alerts.filter(F.col("host") == host)
    latest = latest_samples(own, now, lookback)
    known = host_registry(own) if registry is None else registry.filter(F.col("host") == host)
    return HostDetail(
        host_summary(known, latest, warned, now, params),
        top_processes(latest, "cpu_percent"),
        top_processes(latest, "memory_percent"),
        recent_alerts(warned),
        metrics_summary(own, warned, now, lookback),
    )


def process_detail(
    samples: DataFrame,
    alerts: DataFrame,
    host: str,
    pid: int,
    create_time: float | None,
    now: float,
    lookback: int = 86_400,
) -> ProcessDetail:
    """One process instance; the newest one of the pid when no create time is given."""
    own = samples.filter((F.col("host") == host) & (F.col("pid") == pid))
    key = ["host", "pid", "create_time"]
    if create_time is None:
        wanted = resolve_instance(own)
        own, warned = own.join(wanted, key, "left_semi"), alerts.join(wanted, key, "left_semi")
    else:
        own = own.filter(F.col("create_time") == create_time)
        warned = alerts.filter((F.col("host") == host) & (F.col("pid") == pid) & (F.col("create_time") == create_time))
    history = instance_history(own, now, lookback)
    return ProcessDetail(instance_current(own), history, instance_alerts(warned), instance_series(history))
