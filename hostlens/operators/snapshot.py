"""Latest state, process lists and single-instance histories."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.exprs import instance_id, sample_search
from hostlens.operators.keys import first_per_key, in_receipt, in_time, oldest_per_key, with_instance
from hostlens.params import Params


class Page(NamedTuple):
    """One page of rows and, as a one-row frame, the number of rows before paging."""

    rows: DataFrame
    total: DataFrame


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("seq")]


def latest_samples(samples: DataFrame, now: float, lookback: float = 86_400, host: str | None = None) -> DataFrame:
    """Newest sample per instance among those received within the lookback."""
    recent = in_receipt(samples, now - lookback)
    if host:
        recent = recent.filter(F.col("host") == host)
    return first_per_key(with_instance(recent), ["inst"], newest_first()).drop("inst")


def latest_by_cpu(samples: DataFrame, now: float, lookback: float = 86_400, host: str | None = None) -> DataFrame:
    return latest_samples(samples, now, lookback, host).orderBy(F.desc_nulls_last("cpu_percent"))


def resolve_instance(samples: DataFrame, host: str | None = None, pid: int | None = None) -> DataFrame:
    """Newest instance of each ``(host, pid)``."""
    rows = samples
    if host is not None:
        rows = rows.filter(F.col("host") == host)
    if pid is not None:
        rows = rows.filter(F.col("pid") == pid)
    keys = rows.select("host", "pid", "create_time", "timestamp", "seq")
    return first_per_key(keys, ["host", "pid"], newest_first()).select("host", "pid", "create_time")


def instance_current(samples: DataFrame) -> DataFrame:
    """Newest sample per instance, however old."""
    rows = first_per_key(with_instance(samples), ["inst"], newest_first()).drop("inst")
    return rows.withColumn("instance_id", instance_id())


def instance_history(
    samples: DataFrame,
    now: float,
    lookback: float = 2_592_000,
    limit: int = 5000,
    slice_seconds: float = Params.slice_seconds,
) -> DataFrame:
    """The oldest ``limit`` samples of each instance within the lookback, numbered in time order."""
    recent = with_instance(in_time(samples, now - lookback))
    return oldest_per_key(recent, "inst", ["timestamp", "seq"], limit, slice_seconds, "position").drop("inst")


def instance_series(history: DataFrame) -> DataFrame:
    """Long form of a history: cpu, memory, read_io and write_io points."""
    return history.select(
        "host",
        "pid",
        "create_time",
        "timestamp",
        F.expr(
            "stack(4, 'cpu', cpu_percent, 'memory', memory_percent,"
            " 'read_io', cast(read_bytes AS double), 'write_io', cast(write_bytes AS double)) AS (series, value)"
        ),
    )


# The columns a process list may be sorted by.
SORTS = {
    "process_name": F.lower,
    "host": F.lower,
    "pid": F.col,
    "cpu_percent": F.col,
    "memory_percent": F.col,
    "memory_rss": F.col,
    "read_bytes": F.col,
    "write_bytes": F.col,
    "received_at": F.col,
}


def sort_order(sort: str, order: str) -> list[Column]:
    """Requested sort, CPU for unknown names; the newest arrival first among equals."""
    name = sort if sort in SORTS else "cpu_percent"
    key = SORTS[name](name)
    first = key.desc_nulls_last() if order.lower() == "desc" else key.asc_nulls_first()
    return [first, F.desc("seq")]


def active_instances(alerts: DataFrame) -> DataFrame:
    return with_instance(alerts.filter(F.col("status") == "active")).select("inst").distinct()


def matching_processes(
    samples: DataFrame,
    alerts: DataFrame,
    now: float,
    search: str = "",
    host: str | None = None,
    cpu_min: float | None = None,
    memory_min: float | None = None,
    state: str | None = None,
    alert_only: bool = False,
    lookback: float = 3600,
) -> DataFrame:
    """Latest samples passing every given filter, with ``has_active_alert``."""
    rows = with_instance(latest_samples(samples, now, lookback, host))
    if search:
        rows = rows.filter(sample_search(search))
    if cpu_min is not None:
        rows = rows.filter(F.col("cpu_percent") >= cpu_min)
    if memory_min is not None:
        rows = rows.filter(F.col("memory_percent") >= memory_min)
    if state:
        rows = rows.filter(F.lower("state") == state.lower())
    active = active_instances(alerts)
    if alert_only:
        return rows.join(active, "inst", "left_semi").withColumn("has_active_alert", F.lit(1)).drop("inst")
    flagged = rows.join(active.withColumn("__active", F.lit(1)), "inst", "left")
    return flagged.withColumn("has_active_alert", F.coalesce("__active", F.lit(0))).drop("inst", "__active")


def list_processes(
    samples: DataFrame,
    alerts: DataFrame,
    now: float,
    *,
    sort: str = "cpu_percent",
    order: str = "desc",
    page: int = 1,
    page_size: int = 50,
    **filters,
) -> Page:
    rows = matching_processes(samples, alerts, now, **filters)
    paged = rows.orderBy(*sort_order(sort, order)).offset((page - 1) * page_size).limit(page_size)
    return Page(paged, rows.agg(F.count("*").alias("total")))


def top_processes(latest: DataFrame, metric: str = "cpu_percent", k: int = 8) -> DataFrame:
    """The ``k`` largest readings per host, nulls last."""
    return first_per_key(latest, ["host"], [F.desc_nulls_last(metric), F.desc("seq")], k, "rank")
