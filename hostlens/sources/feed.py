"""Process-sample feed derived from the ``events`` table.

Every event becomes one sample; 30 days are compressed to 43 minutes, and hosts
are squeezed by different amounts so that live, stale and offline hosts occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.ingest import dedup_samples
from hostlens.schemas import RULE_COLUMNS, SAMPLE_COLUMNS

# Fixed values of the feed.
BASE = 1_704_067_200
SPAN = 2_592
NOW = float(BASE + SPAN)
PRUNE_SECONDS = 1_296
CYCLE_SECONDS = 120
SLICE_SECONDS = 432.0

# The rules evaluated over the feed.
RULES = [
    ("cpu-hot", "CPU hot", "cpu_percent", "gt", 80.0, 0.0, 2, "webhook", 60.0, "critical", True),
    ("mem-long", "memory long", "memory_percent", "gte", 20.0, 60.0, 1, "webhook", 120.0, "warning", True),
    ("rss-low", "RSS low", "memory_rss", "lt", 52_428_800.0, 0.0, 3, "email", 0.0, "warning", True),
    ("cpu-any", "CPU any", "cpu_percent", "gt", 50.0, 0.0, 1, "none", 300.0, "info", True),
    ("cpu-idle", "cpu idle", "cpu_percent", "lte", 30.0, 30.0, 2, "none", 600.0, "info", True),
    ("off", "switched off", "cpu_percent", "gt", 50.0, 0.0, 1, "none", 300.0, "info", False),
]


def raw_samples(events: DataFrame, squeezed: bool = True) -> DataFrame:
    """One sample per event, plus a late copy of every twentieth with a changed CPU reading."""
    offset = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(BASE * 1_000_000)).cast("double") / F.lit(1e9)
    squeeze = (F.lit(SPAN) - F.col("user_id") % 12 * 100).cast("double") / F.lit(float(SPAN)) if squeezed else F.lit(1.0)
    kind, late = F.col("event_type"), F.col("event_id") % 50 == 0
    first = (
        events.withColumn("__o", offset * squeeze)
        .withColumn("__k", F.get_json_object("props", "$.k").cast("long"))
        .withColumn("timestamp", F.lit(float(BASE)) + F.col("__o"))
        .select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("host-"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")).alias("host"),
            F.col("user_id").alias("pid"),
            F.concat(F.lit("proc-"), (F.col("user_id") % 25).cast("string"), F.lit(".exe")).alias("process_name"),
            F.when(
                F.col("user_id") % 9 != 0, F.concat(F.lit("user-"), (F.col("user_id") % 5).cast("string"))
            ).alias("username"),
            (F.lit(float(BASE)) + F.floor(F.col("__o") / 1296) * F.lit(1296.0)).alias("create_time"),
            "timestamp",
            (F.col("timestamp") + F.when(late, 120.0).otherwise((F.col("event_id") % 7) * F.lit(0.5))).alias(
                "received_at"
            ),
            F.when(kind != "signup", F.col("value")).alias("cpu_percent"),
            F.least(F.lit(100.0), F.col("value") * F.lit(0.6)).alias("memory_percent"),
            ((F.col("__k") + 1) * 1_048_576).alias("memory_rss"),
            (F.col("event_id") * 1024).alias("read_bytes"),
            (F.col("__k") * 4096).alias("write_bytes"),
            F.when(kind == "view", "running")
            .when(kind == "click", "Running")
            .when(kind == "purchase", "sleeping")
            .when(kind == "error", "stopped")
            .otherwise("")
            .alias("state"),
        )
    )
    # A copy is emitted next to its original, so the events are read once.
    copies = F.when(F.col("seq") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    is_copy = F.col("__copy") == 1
    return (
        first.withColumn("__copy", F.explode(copies))
        .withColumn("seq", F.when(is_copy, -1 - F.col("seq")).otherwise(F.col("seq")))
        .withColumn("received_at", F.col("received_at") + F.when(is_copy, 5.0).otherwise(0.0))
        .withColumn(
            "cpu_percent",
            F.when(is_copy, F.coalesce("cpu_percent", F.lit(0.0)) + 1).otherwise(F.col("cpu_percent")),
        )
        .select(*SAMPLE_COLUMNS)
    )


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def feed(spark: SparkSession, folder: str) -> DataFrame:
    return raw_samples(read_events(spark, folder))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """The accepted samples: one row per identity, blank states filled."""
    return dedup_samples(feed(spark, folder)).withColumn(
        "state", F.coalesce(F.nullif("state", F.lit("")), F.lit("running"))
    )


def rules(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(RULE_COLUMNS, row)]) for row in RULES])
    return spark.range(1).select(F.inline(rows))


def rule_log(events: DataFrame) -> DataFrame:
    """Rule edits derived from the events: one rule id per user, one edit per event."""
    kind = F.col("event_type")
    op = (
        F.when(kind.isin("signup", "purchase"), "create").when(kind == "error", "delete").otherwise("update")
    )
    return events.select(
        F.col("event_id").alias("change_seq"),
        (F.lit(float(BASE)) + F.col("event_id")).alias("changed_at"),
        op.alias("op"),
        F.concat(F.lit("rule-"), F.col("user_id").cast("string")).alias("rule_id"),
        F.concat(F.lit("Rule "), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("user_id") % 2 == 0, "cpu_percent").otherwise("memory_percent").alias("metric"),
        F.when(F.col("event_id") % 3 == 0, "gt").otherwise("lte").alias("operator"),
        F.col("value").alias("threshold"),
        F.lit(0.0).alias("duration"),
        ((F.col("event_id") % 3) + 1).cast("int").alias("consecutive_samples"),
        F.lit("none").alias("action"),
        F.lit(300.0).alias("cooldown"),
        F.when(F.col("user_id") % 5 == 0, "critical").otherwise("warning").alias("severity"),
        (kind != "view").alias("enabled"),
    )
