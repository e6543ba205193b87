"""Scalar column expressions. All run inside the JVM; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"

# Display names of metrics and operators.
REPORT_LABELS = {
    "cpu_percent": "CPU",
    "memory_percent": "Memory",
    "memory_rss": "Memory RSS",
    "read_bytes": "Read I/O",
    "write_bytes": "Write I/O",
}
SHORT_LABELS = {**REPORT_LABELS, "memory_rss": "RSS"}
OPERATOR_SYMBOLS = {"gt": ">", "gte": "≥", "lt": "<", "lte": "≤", "eq": "="}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of ``key`` in a small table, or ``key`` itself."""
    first, *rest = table.items()
    chain = reduce(lambda c, kv: c.when(key == kv[0], kv[1]), rest, F.when(key == first[0], first[1]))
    return chain.otherwise(key)


def matches(operator: Column, value: Column, threshold: Column) -> Column:
    """Whether ``value <operator> threshold`` holds; false for unknown operators."""
    return (
        F.when(operator == "gt", value > threshold)
        .when(operator == "gte", value >= threshold)
        .when(operator == "lt", value < threshold)
        .when(operator == "lte", value <= threshold)
        .when(operator == "eq", value == threshold)
        .otherwise(F.lit(False))
    )


def freshness(age: Column, stale_after: float, offline_after: float) -> Column:
    return F.when(age <= stale_after, "live").when(age <= offline_after, "stale").otherwise("offline")


def bucket(time: Column, width: float) -> Column:
    """Start of the epoch-aligned bucket that holds ``time``."""
    return (F.floor(time / F.lit(float(width))) * F.lit(int(width))).cast("double")


def instance_id() -> Column:
    return F.format_string("%s:%d:%.6f", F.col("host"), F.col("pid"), F.col("create_time"))


def alert_id() -> Column:
    """Text id of an alert: unique because trigger times strictly increase per key."""
    parts = [F.col("rule_id"), F.col("host"), *(F.col(c).cast("string") for c in ("pid", "create_time", "triggered_at"))]
    return F.concat_ws("|", *parts)


def settled(value: Column, digits: int) -> Column:
    """Rounded the same way whatever order the parts of a sum arrived in."""
    return F.round(F.round(value, 9), digits)


# --- numbers as text -------------------------------------------------------

def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def one_decimal(value: Column) -> Column:
    """``value`` with one decimal, rounded from its exact binary value, ties to even.

    ``20 * value`` splits into a rounded product and its exact error; the error
    decides the cases where the product alone looks like a tie.
    """
    def tenths(size: Column) -> Column:
        split = size * F.lit(134217729.0)
        high = split - (split - size)
        product = size * F.lit(20.0)
        error = (high * F.lit(20.0) - product) + (size - high) * F.lit(20.0)
        below = F.floor(product / F.lit(2.0))
        rest = product - below * F.lit(2)
        tie_up = F.when(error == 0, below % 2 == 1).otherwise(error > 0)
        return below + F.when(rest == 1, tie_up).otherwise(rest > 1).cast("long")

    def text(n: Column) -> Column:
        return F.concat(F.floor(n / F.lit(10)).cast("string"), F.lit("."), (n % 10).cast("string"))

    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, _bound(_bound(F.abs(value.cast("double")), tenths), text))


def signed_one_decimal(value: Column) -> Column:
    return F.concat(F.when(value < 0, "").otherwise("+"), one_decimal(value))


def general_number(value: Column) -> Column:
    """Six significant digits without trailing zeros, as C's ``%g`` prints."""
    text = F.format_string("%g", value.cast("double"))
    mantissa = F.regexp_replace(F.regexp_replace(F.split(text, "e").getItem(0), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exponent = F.regexp_extract(text, r"(e.*)$", 1)
    return F.concat(mantissa, exponent)


def grouped_number(value: Column, digits: int = 0) -> Column:
    """Thousands-separated number, dash for null."""
    return F.coalesce(F.format_number(F.round(value.cast("double"), digits), digits), F.lit(DASH))


def _unit_steps(number: Column, units: list[str]) -> tuple[Column, Column]:
    """The number in the first unit that brings it below 1024 (the last unit takes any), and that unit."""
    scaled, unit = number / F.lit(float(1024 ** len(units))), F.lit(units[-1])
    for power in range(len(units) - 1, 0, -1):
        part = number / F.lit(float(1024**power))
        scaled = F.when(part < 1024, part).otherwise(scaled)
        unit = F.when(part < 1024, units[power - 1]).otherwise(unit)
    return F.when(number < 1024, number).otherwise(scaled), F.when(number < 1024, "B").otherwise(unit)


def _report_number(metric_is_percent: Column, metric_is_bytes: Column, value: Column) -> Column:
    scaled, unit = _unit_steps(value, ["KB", "MB", "GB"])
    number = F.when(metric_is_bytes, scaled).otherwise(value)
    # Byte counts drop the fraction from 10 on, and below 1 KB; past the last unit they keep it.
    whole = metric_is_bytes & ((value < 1024) | ((scaled >= 10) & (scaled < 1024)))
    suffix = F.when(metric_is_percent, "%").when(metric_is_bytes, F.concat(F.lit(" "), unit)).otherwise("")
    digits = _bound(number, lambda n: F.when(whole, n.cast("long").cast("string")).otherwise(one_decimal(n)))
    return F.concat(digits, suffix)


def report_bytes(value: Column) -> Column:
    return _bound(value.cast("double"), lambda v: _report_number(F.lit(False), F.lit(True), v))


def format_bytes(value: Column) -> Column:
    """Byte count for display, up to TB, rounded."""
    scaled, unit = _unit_steps(value.cast("double"), ["KB", "MB", "GB", "TB"])
    digits = F.when((scaled < 10) & (unit != "B"), grouped_number(scaled, 1)).otherwise(grouped_number(scaled, 0))
    return F.when(value.isNull(), DASH).otherwise(F.concat(digits, F.lit(" "), unit))


def format_value(metric: Column, value: Column) -> Column:
    """Metric value as it reads in incident reports."""
    percent = metric.isin("cpu_percent", "memory_percent")
    counted = metric.isin("memory_rss", "read_bytes", "write_bytes")
    text = _bound(value.cast("double"), lambda v: _report_number(percent, counted, v))
    return F.when(value.isNull(), DASH).otherwise(text)


def display_value(metric: Column, value: Column) -> Column:
    """Metric value as it reads in rule cards and tables."""
    return (
        F.when(metric.isin("cpu_percent", "memory_percent"), F.concat(grouped_number(value, 1), F.lit("%")))
        .when(metric.isin("memory_rss", "read_bytes", "write_bytes"), format_bytes(value))
        .otherwise(grouped_number(value, 1))
    )


# --- labels ---------------------------------------------------------------

def metric_label(metric: Column) -> Column:
    return _lookup(metric, REPORT_LABELS)


def short_metric_label(metric: Column) -> Column:
    return _lookup(metric, SHORT_LABELS)


def operator_symbol(operator: Column) -> Column:
    return F.coalesce(_lookup(operator, OPERATOR_SYMBOLS), F.lit(DASH))


def rule_condition_text(metric: Column, operator: Column, threshold: Column) -> Column:
    return F.concat_ws(" ", short_metric_label(metric), operator_symbol(operator), display_value(metric, threshold))


def duration_text(seconds: Column) -> Column:
    n = F.coalesce(seconds.cast("double"), F.lit(0.0))
    return (
        F.when(n == 0, "immediately")
        .when(n < 60, F.concat(grouped_number(n), F.lit(" sec")))
        .when(n < 3600, F.concat(grouped_number(n / 60, 1), F.lit(" min")))
        .otherwise(F.concat(grouped_number(n / 3600, 1), F.lit(" hr")))
    )


def value_state(metric: Column, value: Column) -> Column:
    """Health band. 80/50 for CPU, 60/30 for memory."""
    n = F.coalesce(value.cast("double"), F.lit(0.0))
    cpu = F.when(n >= 80, "critical").when(n >= 50, "elevated").otherwise("normal")
    memory = F.when(n >= 60, "critical").when(n >= 30, "elevated").otherwise("normal")
    return F.when(metric == "cpu_percent", cpu).when(metric == "memory_percent", memory).otherwise("normal")


# --- clocks ---------------------------------------------------------------

def event_time(seconds: Column) -> Column:
    """Epoch seconds as a timestamp, for watermarks and event-time windows only."""
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def fmt_time(seconds: Column) -> Column:
    """Clock time of day, dash for null."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.floor(seconds)), "HH:mm:ss"), F.lit(DASH))


def utc_iso(seconds: Column) -> Column:
    micros = F.round(seconds * 1_000_000).cast("long")
    stamp = F.timestamp_micros(micros)
    return F.concat(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros % 1_000_000 == 0, "").otherwise(F.date_format(stamp, ".SSSSSS")),
        F.lit("+00:00"),
    )


def relative_time(seconds: Column, now: float) -> Column:
    age = F.greatest(F.lit(0.0), F.floor(F.lit(float(now)) - seconds + 0.5).cast("double"))

    def ago(width: int, unit: str) -> Column:
        return F.concat(F.floor(age / width).cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(seconds.isNull() | (seconds == 0), "never")
        .when(age < 5, "just now")
        .when(age < 60, ago(1, "s"))
        .when(age < 3600, ago(60, "m"))
        .when(age < 86400, ago(3600, "h"))
        .otherwise(ago(86400, "d"))
    )


# --- text search ----------------------------------------------------------

def contains_like(needle: str, *columns: str) -> Column:
    """Case-insensitive substring test over several columns.

    ``%`` and ``_`` in the needle stay wildcards; a backslash is an ordinary
    character.
    """
    pattern = "%" + needle.replace("\\", "\\\\") + "%"
    tests = [F.col(name).cast("string").ilike(pattern) for name in columns]
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))


def sample_search(needle: str) -> Column:
    return contains_like(needle, "host", "process_name", "username", "pid")


def alert_search(needle: str) -> Column:
    return contains_like(needle, "host", "process_name", "pid", "rule_name", "metric")
