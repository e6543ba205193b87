"""Normalising, de-duplicating and accepting samples."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.operators.keys import first_per_key, numbered, with_instance
from hostlens.schemas import IDENTITY, MAX_BATCH, SAMPLE_COLUMNS

ARRIVAL = ["received_at", "seq"]
# Partition columns of a sample table: the day of receipt and the day of the sample's own clock.
DAYS = ["received_date", "date"]


def dedup_samples(df: DataFrame) -> DataFrame:
    """First arrival per sample identity."""
    return first_per_key(df, IDENTITY, ARRIVAL)


def event_date(timestamp: str = "timestamp") -> Column:
    return F.to_date(F.timestamp_seconds(F.floor(timestamp)))


def accept_samples(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Insert-or-ignore: the first arrival of every identity that is not stored yet.

    A stored table partitioned by ``date`` is read only for the dates of the new rows.
    """
    first = dedup_samples(new)
    if stored is None:
        return first
    keys = IDENTITY
    if "date" in stored.columns:
        dates = new.agg(F.collect_set(event_date()).alias("dates")).scalar()
        stored = stored.filter(F.array_contains(dates, F.col("date")))
        first = first.withColumn("date", event_date())
        keys = ["date", *IDENTITY]
    return first.join(stored.select(*keys), keys, "left_anti").select(*new.columns)


def append_samples(new: DataFrame, table: str, batch: int, stored: DataFrame | None = None) -> DataFrame:
    """Writes the accepted rows of one batch below ``table`` and returns them as stored.

    A repeated run of the same batch replaces its own files.
    """
    write_samples(accept_samples(new, stored), f"{table}/ingest_batch={batch}", mode="overwrite")
    return new.sparkSession.read.schema(new.schema).parquet(f"{table}/ingest_batch={batch}")


def write_samples(df: DataFrame, path: str, mode: str = "append") -> None:
    """A folder per receipt day and event day, so that reads by either clock prune; inside, rows are sorted by
    instance and time so that row groups prune.

    Nearly all samples are received on the day they were taken: the two clocks together make few more folders
    than one. The rebalance gathers an instance's day but splits what is too large for one task.
    """
    (
        df.withColumns({"received_date": event_date("received_at"), "date": event_date()})
        .hint("rebalance", *DAYS, *IDENTITY[:3])
        .sortWithinPartitions(*DAYS, *IDENTITY)
        .write.mode(mode)
        .partitionBy(*DAYS)
        .parquet(path)
    )


def ingest_receipts(new: DataFrame, accepted: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Per batch: accepted and duplicate rows, and alerts its accepted samples triggered."""
    marks = accepted.select("batch_id", *IDENTITY[:3], F.col("timestamp").alias("triggered_at"))
    sent = new.groupBy("batch_id", "host").agg(F.count("*").alias("sent"))
    taken = marks.groupBy("batch_id").agg(F.count("*").alias("accepted"))
    receipts = sent.join(taken, "batch_id", "left")
    triggered = F.lit(0).cast("long")
    if alerts is not None:
        firing = [*IDENTITY[:3], "triggered_at"]
        fired = marks.join(alerts.select(*firing), firing).groupBy("batch_id").agg(F.count("*").alias("fired"))
        receipts = receipts.join(fired, "batch_id", "left")
        triggered = F.coalesce("fired", triggered)
    taken_count = F.coalesce("accepted", F.lit(0))
    return receipts.select(
        "batch_id",
        "host",
        taken_count.alias("accepted"),
        (F.col("sent") - taken_count).alias("duplicates"),
        triggered.alias("alerts_triggered"),
    )


def normalize_samples(df: DataFrame) -> DataFrame:
    """Stored form of accepted rows: unreadable CPU becomes null, blank state ``running``."""
    cpu = F.col("cpu_percent")
    if df.schema["cpu_percent"].dataType.typeName() == "string":
        cpu = cpu.try_cast("double")
    return df.withColumns(
        {"cpu_percent": cpu, "state": F.coalesce(F.nullif("state", F.lit("")), F.lit("running"))}
    )


def normalize_observations(df: DataFrame) -> DataFrame:
    """Clamps raw observations of the agent and drops rows without a create time."""
    def floor_zero(name: str) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(name), F.lit(0).cast("long")))

    memory = F.coalesce("memory_percent", F.lit(0.0))
    return df.filter(F.coalesce("create_time", F.lit(0.0)) > 0).withColumns(
        {
            "process_name": F.coalesce(F.nullif("process_name", F.lit("")), F.lit("unknown")),
            "cpu_percent": F.when(F.col("cpu_percent").isNotNull(), F.greatest(F.lit(0.0), "cpu_percent")),
            "memory_percent": F.greatest(F.lit(0.0), F.least(F.lit(100.0), memory)),
            "memory_rss": floor_zero("memory_rss"),
            "read_bytes": floor_zero("read_bytes"),
            "write_bytes": floor_zero("write_bytes"),
            "state": F.coalesce(F.nullif("state", F.lit("")), F.lit("running")),
        }
    )


def mask_cpu_baseline(df: DataFrame, cycle_seconds: float | None = None) -> DataFrame:
    """Nulls the CPU reading of an instance's first observation after any cycle without it.

    A cycle is a distinct timestamp of a host (or a bucket of ``cycle_seconds``).
    Presence is kept as one row per instance and cycle, and looked up in the host's
    previous cycle by an equi-join, so no task sees a whole host or instance.
    """
    stamp = F.col("timestamp")
    cycle = stamp if cycle_seconds is None else F.floor(stamp / F.lit(float(cycle_seconds))) * F.lit(float(cycle_seconds))
    rows = with_instance(df).withColumn("__cycle", cycle.cast("string"))
    present = rows.groupBy("inst", "__cycle").agg(
        F.first("host").alias("__host"), F.min("timestamp").alias("__first_at")
    )
    cycles = rows.select("host", "__cycle").distinct()
    previous = cycles.select(
        F.col("host").alias("__host"),
        "__cycle",
        F.lag("__cycle").over(W.partitionBy("host").orderBy(F.col("__cycle").cast("double"))).alias("__previous"),
    )
    seen = present.select("inst", F.col("__cycle").alias("__previous"), F.lit(True).alias("__seen"))
    primed = (
        present.join(previous, ["__host", "__cycle"])
        .join(seen, ["inst", "__previous"], "left")
        .filter(F.col("__seen").isNull())
        .select("inst", "__cycle", "__first_at")
    )
    return (
        rows.join(primed, ["inst", "__cycle"], "left")
        .withColumn(
            "cpu_percent", F.when(F.coalesce(stamp != F.col("__first_at"), F.lit(True)), F.col("cpu_percent"))
        )
        .select(*df.columns)
    )


class Admission(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def batch_verdict(size: Column, all_valid: Column, max_samples: int) -> Column:
    """Why a whole batch is turned away; null when it is taken."""
    return (
        F.when((size == 0) | (size > MAX_BATCH) | ~all_valid, "invalid").when(size > max_samples, "too_large")
    )


def admit_batches(df: DataFrame, max_samples: int = 500) -> Admission:
    """Takes a batch whole or not at all. Needs ``batch_id`` and ``valid``."""
    verdicts = df.groupBy("batch_id").agg(F.count("*").alias("batch_size"), F.bool_and("valid").alias("__all_valid"))
    verdicts = verdicts.select(
        "batch_id", "batch_size", batch_verdict(F.col("batch_size"), F.col("__all_valid"), max_samples).alias("reason")
    )
    rows = df.join(verdicts, "batch_id")
    return Admission(
        rows.filter(F.col("reason").isNull()).drop("reason", "batch_size"), rows.filter(F.col("reason").isNotNull())
    )


def chunk_batches(df: DataFrame, size: int = 100, cycle: str = "timestamp", pid_span: int = 1024) -> DataFrame:
    """Splits each cycle of a host into batches of at most ``size`` samples, in pid order."""
    part = F.floor(F.col("pid") / pid_span)
    rows = numbered(df, ["host", cycle], part, ["pid", "create_time", *ARRIVAL], "__row")
    body = [c for c in SAMPLE_COLUMNS if c in df.columns and c != "host"]
    return (
        rows.withColumn("chunk", F.floor((F.col("__row") - 1) / size))
        .groupBy("host", cycle, "chunk")
        .agg(
            F.count("*").alias("sample_count"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("__row", F.struct(*body).alias("s")))), lambda x: x["s"]
            ).alias("samples"),
        )
    )
