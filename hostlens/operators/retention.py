"""Retention and the upgrade of tables written by older versions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.operators.ingest import dedup_samples
from hostlens.operators.keys import in_time
from hostlens.schemas import SAMPLE


class Pruned(NamedTuple):
    kept: DataFrame
    deleted: DataFrame


def prune_samples(samples: DataFrame, now: float, days: float = 30) -> Pruned:
    """Samples at or after the cutoff, and how many lie before it.

    On a table partitioned by ``date`` only the day that holds the cutoff is read twice.
    """
    cutoff = now - days * 86_400
    expired = in_time(samples, end=cutoff).filter(F.col("timestamp") < cutoff)
    return Pruned(in_time(samples, cutoff), expired.agg(F.count("*").alias("deleted_count")))


def with_compat_fields(df: DataFrame) -> DataFrame:
    """Adds ``user``, the old name of ``username``."""
    return df if "user" in df.columns else df.withColumn("user", F.col("username"))


def upgrade_samples(df: DataFrame, now: float) -> DataFrame:
    """Brings an older sample table to the current columns, one row per identity."""
    known = set(df.columns)
    defaults = {
        "username": F.lit(None),
        "memory_rss": F.lit(0),
        "state": F.lit("running"),
        "received_at": F.lit(None),
    }
    rows = df
    for name, value in defaults.items():
        if name not in known:
            rows = rows.withColumn(name, value.cast(SAMPLE[name].dataType))
    if "user" in known:
        rows = rows.withColumn("username", F.coalesce("username", "user")).drop("user")
    arrival = rows.withColumn("received_at", F.coalesce("received_at", "timestamp", F.lit(float(now))))
    # Lowest arrival number wins here, whatever the receipt times say.
    ranked = arrival.withColumn("__received", F.col("received_at")).withColumn("received_at", F.lit(0.0))
    kept = dedup_samples(ranked).withColumn("received_at", F.col("__received")).drop("__received")
    return kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SAMPLE.fields])


