"""Filtered, ordered and paged lists, and the cross-entity search."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.functions.exprs import alert_search, contains_like, sample_search
from hostlens.operators.alerts import newest_alerts_first
from hostlens.operators.keys import in_time
from hostlens.operators.snapshot import Page, list_processes, newest_first
from hostlens.schemas import ALERT_STATUSES, SEVERITIES


class Cut(NamedTuple):
    """Which part of an ordered list is wanted: some rows from a place on, or behind the last row of the page before.

    ``after`` holds that row's values of the order's columns. Such a page costs the same wherever it lies, and rows that
    arrive meanwhile neither repeat nor hide any.
    """

    size: int
    skip: int = 0
    after: tuple | None = None


#: Columns whose values are words of a list; a filter by any other word selects nothing and is left out.
WORDS = {"status": ALERT_STATUSES, "severity": SEVERITIES}


def _meeting(rows: DataFrame, equal: Mapping[str, object], *more: Column | None) -> DataFrame:
    """Rows whose columns have the given values (empty ones ask for nothing) and that meet the further conditions."""
    asked = {n: v for n, v in equal.items() if v not in (None, "") and v in WORDS.get(n, (v,))}
    conditions = [F.col(n) == v for n, v in asked.items()] + [c for c in more if c is not None]
    return rows.filter(reduce(and_, conditions)) if conditions else rows


def _behind(columns: list[str], last: tuple) -> Column:
    """Rows that come after the given one in the falling order of the columns."""
    later = F.lit(False)
    for name, value in reversed(list(zip(columns, last, strict=True))):
        later = (F.col(name) < value) | ((F.col(name) == value) & later)
    return later


def _page(rows: DataFrame, order: list[Column], cut: Cut) -> Page:
    return Page(rows.orderBy(*order).offset(cut.skip).limit(cut.size), rows.agg(F.count("*").alias("total")))


def history(
    samples: DataFrame, cut: Cut = Cut(500), between: tuple[float | None, float | None] = (None, None), text: str = "", **equal: object
) -> Page:
    """Stored samples with the given values, newest first; time bounds are inclusive.

    With ``cut.after``, a (timestamp, seq), the total counts what is left, and days after it are not read.
    """
    start, end = between
    if cut.after is not None:
        end = min(cut.after[0], end) if end is not None else cut.after[0]
    behind = _behind(["timestamp", "seq"], cut.after) if cut.after is not None else None
    found = _meeting(in_time(samples, start, end), equal, sample_search(text) if text else None, behind)
    return _page(found, newest_first(), cut)


def alerts_with(alerts: DataFrame, since: float | None = None, text: str = "", **equal: object) -> DataFrame:
    """Alerts with the given values that were triggered at ``since`` or later."""
    late = F.col("triggered_at") >= since if since is not None else None
    return _meeting(alerts, equal, late, alert_search(text) if text else None)


def list_alerts(alerts: DataFrame, cut: Cut = Cut(100), **wanted: object) -> Page:
    return _page(alerts_with(alerts, **wanted), newest_alerts_first(), cut)


def search_hosts(hosts: DataFrame, needle: str, wildcards: bool = False) -> DataFrame:
    """Hosts whose name contains the needle, ignoring case; ``%`` and ``_`` count only on request."""
    plain = F.lower("host").contains(needle.lower())
    return hosts.filter(contains_like(needle, "host") if wildcards else plain).orderBy(F.lower("host"), "host")


def global_search(samples: DataFrame, hosts: DataFrame, alerts: DataFrame, query: str, now: float) -> DataFrame:
    """First 3 hosts, 4 processes and 3 alerts for a query of at least two characters."""
    needle = query.strip()
    enabled = F.lit(len(needle) >= 2)
    found_hosts = search_hosts(hosts, needle).limit(3).select(
        F.lit("host").alias("kind"), F.col("host").alias("label"), "host", F.lit(None).cast("long").alias("pid"),
        F.struct(F.lower("host").alias("a"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("c")).alias("__order"),
    )
    processes = list_processes(samples, alerts, now, search=needle, page_size=4).rows.select(
        F.lit("process").alias("kind"), F.col("process_name").alias("label"), "host", "pid",
        F.struct(
            F.lit("").alias("a"), F.coalesce(-F.col("cpu_percent"), F.lit(float("inf"))).alias("b"), (-F.col("seq")).alias("c")
        ).alias("__order"),
    )
    # Descending over the whole alert key among equal trigger times.
    key = newest_alerts_first()
    ranked = list_alerts(alerts, Cut(3), text=needle).rows
    ranked = ranked.withColumn("__n", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*key)))
    found_alerts = ranked.select(
        F.lit("alert").alias("kind"), F.col("rule_name").alias("label"), "host", "pid",
        F.struct(F.lit("").alias("a"), F.lit(0.0).alias("b"), F.col("__n").cast("long").alias("c")).alias("__order"),
    )
    rows = found_hosts.unionByName(processes).unionByName(found_alerts).filter(enabled)
    position = F.row_number().over(W.partitionBy("kind").orderBy("__order"))
    return rows.select("kind", position.alias("position"), "label", "host", "pid")


def page_info(total: DataFrame, page: int, page_size: int) -> DataFrame:
    """Number of pages and the shown range, from a one-row total."""
    count = F.col("total")
    first, last = F.lit((page - 1) * page_size + 1), F.least(F.lit(page * page_size).cast("long"), count)
    dash = F.lit("–")
    return total.select(
        "total",
        F.lit(page).alias("page"),
        F.greatest(F.lit(1).cast("long"), F.ceil(count / page_size)).alias("max_page"),
        F.when(count > 0, F.concat(first.cast("string"), dash, last.cast("string")))
        .otherwise("0")
        .alias("showing"),
    )
