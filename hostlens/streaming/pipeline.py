"""Continuous ingest and the streams that read the accepted samples.

Envelopes are admitted, de-duplicated against the table and written once by batch number: a
repeated batch leaves what is complete as it is, so streams that follow the table see no row
twice. Everything else streams from that table.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostlens.functions.exprs import event_time, settled
from hostlens.operators.alerts import alerts_from_transitions
from hostlens.operators.ingest import accept_samples, ingest_receipts, write_samples
from hostlens.operators.keys import first_per_key, instance_key, instance_parts
from hostlens.operators.outbox import notification_outbox, write_outbox
from hostlens.schemas import IDENTITY, INSTANCE, SAMPLE
from hostlens.sources.envelopes import envelope_samples, next_number, parse_envelopes, stream_lines
from hostlens.sources.stored import LOG_SCHEMA, read_current
from hostlens.streaming.alerting import CHANGES, RULE_FIELDS, SAMPLE_FIELDS, STATE_OUTPUT, AlertProcessor

RETENTION = "30 days"


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """The accepted samples of a table folder."""
    return spark.read.schema(LOG_SCHEMA).parquet(folder)


def stream_table(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def _write_once(rows: DataFrame, folder: str, write: Callable[[DataFrame, str, str], None]) -> None:
    """Writes rows to folder unless a write there was completed before; an unfinished one is replaced."""
    spark = rows.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        write(rows, folder, "overwrite")


def _as_parquet(rows: DataFrame, folder: str, mode: str) -> None:
    rows.write.mode(mode).parquet(folder)


def _ingest_batch(table: str, max_samples: int, replay: bool):
    def ingest(lines: DataFrame, number: int) -> None:
        spark = lines.sparkSession
        folder = f"{table}/samples"
        envelopes = parse_envelopes(lines, max_samples, replay).persist()
        try:
            order = f"{table}/order/ingest_batch="
            offset = spark.read.parquet(f"{order}{number - 1}").first().next if number else 0
            _write_once(next_number(envelopes, offset), f"{order}{number}", _as_parquet)
            new = envelope_samples(envelopes, offset)
            stored = None
            if number > 0:
                stored = read_current(spark, table, before=number)
            _write_once(accept_samples(new, stored), f"{folder}/ingest_batch={number}", write_samples)
            accepted = read_table(spark, folder).filter(F.col("ingest_batch") == number)
            _write_once(ingest_receipts(new, accepted), f"{table}/receipts/ingest_batch={number}", _as_parquet)
            rejected = envelopes.filter(F.col("reason").isNotNull()).select("batch_id", "host", "reason", "value")
            _write_once(rejected, f"{table}/rejected/ingest_batch={number}", _as_parquet)
        finally:
            envelopes.unpersist()

    return ingest


def stream_ingest(
    spark: SparkSession, source: str, table: str, checkpoint: str, max_files: int = 1, max_samples: int = 500, replay: bool = False,
    every: str | None = None,
) -> StreamingQuery:
    """Reads the envelope files under ``source`` into ``table``: those present, or at an interval for good.

    Table and checkpoint belong together: a batch number that is complete in the table is not written again.
    """
    return (
        stream_lines(spark, source, max_files)
        .writeStream.foreachBatch(_ingest_batch(table, max_samples, replay))
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def on_server_clock(samples: DataFrame, horizon: str) -> DataFrame:
    """With a watermark on the time of receipt: a host's clock, however wrong, makes no other host's rows late."""
    return samples.withColumn("received_time", event_time(F.col("received_at"))).withWatermark("received_time", horizon)


def stream_dedup(samples: DataFrame, horizon: str = RETENTION) -> DataFrame:
    """One row per identity, that of the earliest trigger, with state for the horizon of receipt time."""
    return on_server_clock(samples, horizon).dropDuplicatesWithinWatermark(IDENTITY).drop("received_time")


def alert_seeds(states: DataFrame) -> DataFrame:
    """Alert states (as from ``alert_states``) as the start of a stream: one row per instance.

    Of active alerts without further state it is enough to give their key and ``active_triggered_at``: their next match updates
    them and nothing fires twice.
    """
    given = {"true_since": "double", "consecutive_samples": "bigint", "last_sample_at": "double", "cooldown_until": "double"}
    rows = states.withColumns({n: F.lit(None).cast(kind) for n, kind in given.items() if n not in states.columns})
    entry = F.struct(
        "rule_id",
        F.col("true_since"),
        F.coalesce("consecutive_samples", F.lit(0).cast("bigint")).alias("run"),
        F.col("last_sample_at").alias("last_at"),
        F.coalesce("cooldown_until", F.lit(0.0)).alias("quiet_until"),
        F.col("active_triggered_at").alias("triggered_at"),
    )
    heard = F.max(F.coalesce("last_sample_at", "active_triggered_at", F.lit(0.0))).alias("received")
    return rows.groupBy(instance_key().alias("inst")).agg(F.collect_list(entry).alias("entries"), heard)


def stream_alerts(
    samples: DataFrame,
    rules: DataFrame,
    expire_after: float | None = None,
    grace: float = 3_600.0,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Alert transitions as samples arrive; state per instance holds one entry per rule.

    The rules, some 20,000 at most (``MAX_BYTES`` when packed), are shipped to every task with the processor and are those of
    the start of the query: ``follow_alerts`` starts one per pass. ``expire_after`` seconds of receipt time without a sample end an instance and free its state,
    ``grace`` seconds after the newest receipt of all; by default state is kept. ``seeds`` (see ``alert_seeds``) are
    the state of a query that starts without a checkpoint.
    """
    known = [row.asDict() for row in rules.select(*RULE_FIELDS).collect()]
    processor = AlertProcessor(known, expire_after)
    sample = F.to_json(F.struct(*SAMPLE_FIELDS, *sorted({rule["metric"] for rule in known})))
    keyed = samples.select(instance_key().alias("inst"), sample.alias("sample"), "received_at")
    if expire_after is not None:
        # The server's clock: no host's clock can make others' rows late.
        keyed = keyed.withColumn("received_time", event_time(F.col("received_at")))
        keyed = keyed.withWatermark("received_time", f"{int(grace * 1000)} milliseconds")
    keyed = keyed.drop("received_at")
    start = {"initialState": seeds.groupBy("inst")} if seeds is not None else {}
    mode = "None" if expire_after is None else "EventTime"
    packed = keyed.groupBy("inst").transformWithState(processor, STATE_OUTPUT, outputMode="Update", timeMode=mode, **start)
    changes = packed.select("inst", F.inline(F.from_json("changes", CHANGES)))
    return changes.select(
        "rule_id", *[c.alias(n) for n, c in instance_parts().items()],
        "triggered_at", "transition", "seen_at", "value", "process_name", "username",
    )


def alert_state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream of alerts holds after its last trigger: one row per instance and rule."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "alerts").load()
    rows = rows.select("key.inst", F.inline("value.entries"), F.col("value.received").alias("received"))
    return rows.select(*[c.alias(n) for n, c in instance_parts().items()], *[c for c in rows.columns if c != "inst"])


def follow_alerts(
    samples: Callable[[], DataFrame],
    rules: Callable[[], DataFrame],
    folder: str,
    checkpoint: str,
    going_on: Callable[[], bool],
    pause: float = 5.0,
    **options: object,
) -> None:
    """Pass after pass over what has arrived, each with the rules as they are then, while ``going_on()``.

    All passes share one checkpoint: state goes on, a new rule starts without state, a deleted one loses its own.
    """
    while going_on():
        start_changes(stream_alerts(samples(), rules(), **options), folder, checkpoint).awaitTermination()
        time.sleep(pause)


def streamed_receipts(receipts: DataFrame, accepted: DataFrame, transitions: DataFrame) -> DataFrame:
    """The receipts of the ingest stream with the alerts that each batch's accepted samples triggered.

    A batch is answered when its alerts are evaluated: run it over batches that the alert stream has passed.
    """
    firing = [*INSTANCE, "triggered_at"]
    fired = transitions.filter(F.col("transition") == "triggered").select(*firing)
    marks = accepted.select("batch_id", "host", "pid", "create_time", F.col("timestamp").alias("triggered_at"))
    counts = marks.join(fired, firing).groupBy("batch_id").agg(F.count("*").alias("fired"))
    rows = receipts.drop("alerts_triggered").join(counts, "batch_id", "left")
    return rows.withColumn("alerts_triggered", F.coalesce("fired", F.lit(0).cast("long"))).drop("fired")


def stream_hosts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("host").agg(
        F.min("received_at").alias("first_seen"),
        F.max("received_at").alias("last_seen"),
        F.count("*").alias("sample_count"),
    )


def stream_metric_series(samples: DataFrame, width: int, grace: str = "1 day") -> DataFrame:
    """Sums of tumbling buckets, for each day of receipt by itself: see ``combined_series``.

    A day's sums are final, and their state is dropped, ``grace`` after that day of the server's clock. So a bucket may
    get rows for ever, and no row is late for having an old or a wrong clock.
    """
    timed = on_server_clock(samples, grace).withColumn("event_time", event_time(F.col("timestamp")))
    bucket = F.floor(F.unix_micros("event_time") / F.lit(width * 1_000_000)) * F.lit(float(width))
    return (
        timed.groupBy(F.window("received_time", "1 day").alias("day"), bucket.alias("bucket"))
        .agg(
            F.sum("cpu_percent").alias("cpu_sum"),
            F.count("cpu_percent").alias("cpu_rows"),
            F.sum("memory_percent").alias("memory_sum"),
            F.count("memory_percent").alias("memory_rows"),
            F.count("*").alias("activity"),
        )
        .select("bucket", F.col("day.start").cast("long").alias("received_day"), "cpu_sum", "cpu_rows", "memory_sum", "memory_rows", "activity")
    )


def combined_series(sums: DataFrame) -> DataFrame:
    """The series from the newest sums of every bucket and day of receipt."""
    mean = lambda n: settled(F.coalesce(F.sum(f"{n}_sum") / F.nullif(F.sum(f"{n}_rows"), F.lit(0)), F.lit(0.0)), 3).alias(n)
    return sums.groupBy("bucket").agg(mean("cpu"), mean("memory"), F.sum("activity").alias("activity"))


def stream_latest(samples: DataFrame) -> DataFrame:
    """Newest sample per instance."""
    columns = [f.name for f in SAMPLE.fields]
    newest = F.max(F.struct("timestamp", "seq", F.struct(*columns).alias("row")))
    return samples.groupBy(instance_key().alias("inst")).agg(newest.alias("newest")).select("inst", "newest.row.*")


def _trigger(every: str | None) -> dict:
    """All that is there and then the end, or without end at an interval such as "10 seconds"."""
    return {"availableNow": True} if every is None else {"processingTime": every}


def start_changes(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes the changed rows of every trigger to ``folder/epoch=<n>`` (safe to repeat)."""
    def write(changes: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{folder}/epoch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def newest_rows(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row per key of a change folder."""
    return first_per_key(changes, keys, [F.desc("epoch")]).drop("epoch")


def stream_outbox(
    transitions: DataFrame, rules: DataFrame, folder: str, checkpoint: str, every: str | None = None, **configured: bool
) -> StreamingQuery:
    """Per trigger: first the transition log, then the messages of newly triggered alerts in order."""
    def write(changes: DataFrame, number: int) -> None:
        log = f"{folder}/transitions/epoch={number}"
        changes.write.mode("overwrite").parquet(log)
        fresh = changes.sparkSession.read.schema(changes.schema).parquet(log).filter(F.col("transition") == "triggered")
        messages = notification_outbox(alerts_from_transitions(fresh, rules), **configured)
        write_outbox(messages, f"{folder}/outbox/epoch={number}")

    return (
        transitions.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )
