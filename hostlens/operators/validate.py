"""Checks of samples and hosts against the data model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.checks import errors_of, no_control, number_in, stripped, text_in
from hostlens.schemas import MAX_CPU, MAX_EPOCH, MAX_LONG, MAX_PID

SAMPLE_FIELDS = [
    "pid", "process_name", "username", "create_time", "timestamp", "cpu_percent", "memory_percent",
    "memory_rss", "read_bytes", "write_bytes", "state",
]


def whole_number(value: Column) -> Column:
    """Integer value of a number or numeral; null when it has a fraction or is no number."""
    text = value.cast("string")
    number = text.try_cast("double")
    fits = (number == F.floor(number)) & (F.abs(number) < float(MAX_LONG))
    return F.coalesce(text.try_cast("bigint"), F.when(fits, number.try_cast("bigint")))


def positive_time(value: Column) -> Column:
    return value.isNotNull() & (value > 0) & (value <= MAX_EPOCH)


def clean_fields(raw: Callable[[str], Column], absent: Callable[[str], Column]) -> dict[str, Column]:
    """Typed and stripped fields of one sample; ``cpu_given`` tells an unreadable CPU from none."""
    return {
        "pid": whole_number(raw("pid")),
        "process_name": stripped(raw("process_name")),
        "username": stripped(raw("username")),
        **{n: raw(n).try_cast("double") for n in ("create_time", "timestamp", "cpu_percent", "memory_percent")},
        **{n: whole_number(raw(n)) for n in ("memory_rss", "read_bytes", "write_bytes")},
        "state": F.when(absent("state"), "running").otherwise(stripped(raw("state"))),
        "cpu_given": raw("cpu_percent").isNotNull(),
    }


def field_errors(field: Callable[[str], Column]) -> Column:
    """Names of the cleaned fields that break a rule."""
    good = {
        "pid": number_in(field("pid"), 0, MAX_PID),
        "process_name": text_in(field("process_name"), 1, 512) & no_control(field("process_name")),
        "username": field("username").isNull() | (F.length(field("username")) <= 512),
        "create_time": positive_time(field("create_time")),
        "timestamp": positive_time(field("timestamp")),
        "cpu_percent": ~field("cpu_given") | number_in(field("cpu_percent"), 0, MAX_CPU),
        "memory_percent": number_in(field("memory_percent"), 0, 100),
        **{n: number_in(field(n), 0, MAX_LONG) for n in ("memory_rss", "read_bytes", "write_bytes")},
        "state": field("state").isNotNull() & (F.length(field("state")) <= 32),
    }
    return errors_of(good)


def valid_host(host: Column) -> Column:
    return F.coalesce(text_in(host, 1, 255) & no_control(host), F.lit(False))


def validate_samples(df: DataFrame) -> DataFrame:
    """Flat samples with cleaned fields, ``errors`` (names of bad fields) and ``valid``."""
    fields = clean_fields(F.col, lambda name: F.col(name).isNull())
    rows = df.withColumns({**fields, "host": stripped(F.col("host"))})
    bad_host = F.when(valid_host(F.col("host")), F.array().cast("array<string>")).otherwise(F.array(F.lit("host")))
    rows = rows.withColumn("errors", F.concat(field_errors(F.col), bad_host)).drop("cpu_given")
    return rows.withColumn("valid", F.size("errors") == 0)
