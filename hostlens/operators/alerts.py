"""Threshold alerts with duration, consecutive-sample and cooldown gates.

Per rule and instance, samples are taken in arrival order. A sample whose metric is
null, or that is not newer than every earlier one, is ignored. A run of matching
samples plus the sample that ends it is an *island*; an island fires at most once, at
its first sample that meets the count, duration and cooldown gates.

The work is cut so that no task holds the samples of a whole instance:

1. Samples are shuffled by (instance, receipt-time slice); order-dependent steps run
   inside a slice (``preceding_max`` carries the newest time seen across slices).
2. Each slice emits *fragments*: its pieces of islands. Pieces that lie inside the
   slice and cannot fire are dropped. An island whose first candidate comes after the
   cooldown that the clear before it could have started is *settled*: it fires whatever
   came before. Runs from one settled island to the next inside a slice depend on
   nothing else and form groups of their own (``route``), spread over all tasks.
3. What is left, a few rows per slice unless a rule flaps faster than its cooldown, is
   grouped per (rule, instance) and joined into islands across slices. The cooldown is
   folded only over the islands between two settled ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.functions.exprs import alert_id, matches
from hostlens.operators.ingest import ARRIVAL
from hostlens.operators.keys import first_per_key, instance_parts, preceding_max, with_instance
from hostlens.operators.rules import enabled_rules, inline_rules, rule_array, rules_frame
from hostlens.params import Params
from hostlens.schemas import ALERT_COLUMNS, ALERT_KEY, ALERT_STATUSES, INSTANCE, METRICS, SEVERITIES

GATES = ["rule_id", "metric", "operator", "threshold", "duration", "consecutive_samples", "cooldown"]
KEY = ["inst", "rule_id"]
GROUP = [*KEY, "route"]


class _Rules:
    """The enabled rules, read once: as rows when few, as a frame in any case."""

    def __init__(self, rules: DataFrame):
        self.inlined = inline_rules(rules)
        few = self.inlined is not None and self.inlined
        self.frame = rules_frame(rules.sparkSession, self.inlined) if few else enabled_rules(rules)


    def expand(self, rows: DataFrame, kept: list[str], readings: dict[str, Column]) -> DataFrame:
        """Each row once per rule whose metric has a reading in it, with the gates of the rule."""
        if self.inlined:
            rows = rows.select(*kept, *[c.alias(m) for m, c in readings.items()], F.inline(rule_array(self.inlined, GATES)))
            value = F.coalesce(*[F.when(F.col("metric") == m, F.col(m)) for m in readings])
            return rows.withColumn("value", value).filter(F.col("value").isNotNull()).drop(*readings)
        # No rules, or too many to carry in the plan: one row per metric, joined to the rules by metric.
        points = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in readings.items()])
        long = rows.select(*kept, F.inline(points)).filter(F.col("value").isNotNull())
        return long.join(self.frame.select(*GATES), "metric")

    @property
    def metrics(self) -> list[str]:
        return sorted({r["metric"] for r in self.inlined}) if self.inlined else list(METRICS)


def _metric_rows(samples: DataFrame, rules: _Rules, slice_seconds: float) -> DataFrame:
    """One row per sample and enabled rule that looks at it: value, time and whether it matches."""
    used, stamp = rules.metrics, F.col("timestamp")
    rows = with_instance(samples).select(
        "inst", *ARRIVAL, "timestamp", "process_name", "username", *used,
        F.floor(F.col("received_at") / F.lit(float(slice_seconds))).alias("slice"),
    )
    seen = {f"__seen_{m}": F.when(F.col(m).isNotNull(), stamp) for m in used}
    rows = preceding_max(rows, ["inst"], "slice", ARRIVAL, seen)

    def in_order(metric: str) -> Column:
        newest = F.col(f"__seen_{metric}")
        return F.when(newest.isNull() | (stamp > newest), F.col(metric).cast("double"))

    kept = ["inst", "slice", "timestamp", "process_name", "username"]
    expanded = rules.expand(rows, kept, {m: in_order(m) for m in used})
    hit = matches(F.col("operator"), F.col("value"), F.col("threshold"))
    return expanded.withColumn("hit", hit).drop("metric", "operator", "threshold")


def _with_piece(rows: DataFrame) -> DataFrame:
    """Numbers the island pieces inside each slice: the clearing sample closes a piece.

    Of several non-matching samples in a row only the first closes anything; the rest go.
    """
    in_slice = W.partitionBy("inst", "slice", "rule_id").orderBy("timestamp")
    closed = F.coalesce(F.count_if(~F.col("hit")).over(in_slice.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"piece": closed, "__hit_before": F.lag("hit").over(in_slice)})
    return rows.filter(F.col("hit") | F.coalesce("__hit_before", F.lit(True))).drop("__hit_before")


def _fragments(rows: DataFrame) -> DataFrame:
    """One row per island piece, joined up across slices by ``island``."""
    hit, stamp = F.col("hit"), F.col("timestamp")
    gates = ["duration", "consecutive_samples", "cooldown"]
    pieces = rows.groupBy("inst", "slice", "rule_id", "piece", *gates).agg(
        F.sort_array(F.collect_list(F.when(hit, stamp))).alias("hits"),
        F.max(F.when(~hit, stamp)).alias("cleared"),
        F.max(F.struct(stamp.alias("seen_at"), "value")).alias("last"),
        F.max(F.when(hit, F.struct(stamp.alias("seen_at"), "process_name", "username"))).alias("who"),
    )
    hits = F.col("hits")
    held = F.get(hits, F.size(hits) - 1) - F.get(hits, F.lit(0))
    can_fire = (F.size(hits) >= F.col("consecutive_samples")) & (held >= F.col("duration"))
    # The first piece of a slice may go on from the slice before, an unclosed one into the slice after.
    pieces = pieces.filter((F.col("piece") == 0) | F.col("cleared").isNull() | can_fire)
    pieces = _with_route(pieces)
    earlier = W.partitionBy(*GROUP).orderBy("slice", "piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumns(
        {
            "island": F.coalesce(F.count("cleared").over(earlier), F.lit(0)),
            "previous_clear": F.max("cleared").over(earlier),
        }
    )
    within = W.partitionBy(*GROUP, "island").orderBy("slice", "piece")
    return pieces.withColumns(
        {
            "hits_before": F.coalesce(
                F.sum(F.size("hits")).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ),
            "since": F.min(F.get("hits", F.lit(0))).over(within.rowsBetween(W.unboundedPreceding, 0)),
        }
    )


def _with_route(pieces: DataFrame) -> DataFrame:
    """Names the runs of pieces inside a slice that depend on nothing outside of it."""
    in_slice = W.partitionBy("inst", "slice", "rule_id").orderBy("piece")
    since, needed, duration = F.get("hits", F.lit(0)), F.col("consecutive_samples"), F.col("duration")
    candidate = F.get(F.filter("hits", lambda at, i: (i + 1 >= needed) & (at - since >= duration)), F.lit(0))
    clear_before = F.max("cleared").over(in_slice.rowsBetween(W.unboundedPreceding, -1))
    inner = (F.col("piece") > 0) & F.col("cleared").isNotNull()
    settled = inner & F.coalesce(candidate >= clear_before + F.col("cooldown"), F.lit(False))
    rows = pieces.withColumn("__settled", settled)
    rows = rows.withColumn("__run", F.count_if("__settled").over(in_slice.rowsBetween(W.unboundedPreceding, 0)))
    last_run = F.max("__run").over(W.partitionBy("inst", "slice", "rule_id"))
    # The last run of a slice hands its cooldown to the next slice, if there is one to hand over.
    alone = inner & (F.col("__run") > 0) & ((F.col("__run") < last_run) | (F.col("cooldown") == 0))
    name = F.concat_ws(":", F.col("slice").cast("string"), F.col("__run").cast("string"))
    return rows.withColumn("route", F.when(alone, name).otherwise("")).drop("__settled", "__run")


def _islands(fragments: DataFrame) -> DataFrame:
    """One row per island that may fire, with its firing candidates.

    ``near`` holds the candidates inside the cooldown that the clear before the island
    could have started; ``beyond`` is the first candidate after it.
    """
    needed, since, before = F.col("consecutive_samples"), F.col("since"), F.col("hits_before")
    duration, limit = F.col("duration"), F.col("previous_clear") + F.col("cooldown")
    gated = F.filter(
        "hits", lambda at, i: (before + i + 1 >= needed) & (at - since >= duration)
    )
    rows = fragments.withColumn("__gated", gated).withColumn("__limit", limit)
    rows = rows.withColumns(
        {
            "near": F.filter("__gated", lambda at: F.col("__limit").isNotNull() & (at < F.col("__limit"))),
            "beyond": F.get(F.filter("__gated", lambda at: F.col("__limit").isNull() | (at >= F.col("__limit"))), F.lit(0)),
        }
    )
    return (
        rows.groupBy(*GROUP, "island")
        .agg(
            F.array_sort(F.flatten(F.collect_list("near"))).alias("near"),
            F.min("beyond").alias("beyond"),
            F.max("cleared").alias("cleared"),
            F.max("last").alias("last"),
            F.max("who").alias("who"),
            F.first("cooldown").alias("cooldown"),
        )
        .filter((F.size("near") > 0) | F.col("beyond").isNotNull())
    )


def _fired(islands: DataFrame) -> DataFrame:
    """Islands that fire, with ``fired_at``."""
    chain = F.count("beyond").over(W.partitionBy(*GROUP).orderBy("island").rowsBetween(W.unboundedPreceding, 0))
    body = ["island", "near", "beyond", "cleared", "last", "who", "cooldown"]
    chains = (
        islands.withColumn("chain", chain)
        .groupBy(*GROUP, "chain")
        .agg(F.array_sort(F.collect_list(F.struct(*body))).alias("run"))
    )
    kind = chains.schema["run"].dataType.elementType.simpleString()
    start = F.expr(f"named_struct('quiet_until', 0D, 'fired', cast(array() AS array<struct<at:double,row:{kind}>>))")

    def step(state: Column, island: Column) -> Column:
        free = F.get(F.filter(island["near"], lambda at: at >= state["quiet_until"]), F.lit(0))
        # A candidate beyond the cooldown fires in any case; its exact time is settled below.
        fires = island["beyond"].isNotNull() | free.isNotNull()
        at = F.when(island["beyond"].isNull(), free)
        entry = F.array(F.struct(at.alias("at"), island.alias("row")))
        return F.when(
            fires,
            F.struct(
                F.coalesce(island["cleared"] + island["cooldown"], state["quiet_until"]).alias("quiet_until"),
                F.concat(state["fired"], entry).alias("fired"),
            ),
        ).otherwise(state)

    folded = chains.withColumn("state", F.aggregate("run", start, step))
    entering = F.coalesce(
        F.lag("state.quiet_until").over(W.partitionBy(*GROUP).orderBy("chain")), F.lit(0.0)
    )
    rows = folded.select(*GROUP, entering.alias("quiet_until"), F.col("state.fired").alias("fired"))
    rows = rows.select(*GROUP, "quiet_until", F.inline("fired")).select(*GROUP, "quiet_until", "at", "row.*")
    in_cooldown = F.get(F.filter("near", lambda t: t >= F.col("quiet_until")), F.lit(0))
    return rows.withColumn("fired_at", F.coalesce("at", in_cooldown, "beyond"))


def _alert_columns(fired: DataFrame, rules: _Rules) -> DataFrame:
    rows = fired.join(rules.frame.drop("cooldown"), "rule_id")
    return rows.select(
        "rule_id",
        F.col("name").alias("rule_name"),
        *[c.alias(n) for n, c in instance_parts().items()],
        F.col("who.process_name").alias("process_name"),
        F.col("who.username").alias("username"),
        "metric",
        "operator",
        "threshold",
        F.col("last.value").alias("current_value"),
        "severity",
        F.when(F.col("cleared").isNull(), "active").otherwise("resolved").alias("status"),
        F.col("fired_at").alias("triggered_at"),
        F.col("last.seen_at").alias("last_seen"),
        F.col("cleared").alias("resolved_at"),
        "action",
    ).select(*ALERT_COLUMNS)


def evaluate_alerts(
    samples: DataFrame, rules: DataFrame, slice_seconds: float = Params.slice_seconds
) -> DataFrame:
    """The complete alert history of accepted samples under one rule set."""
    known = _Rules(rules)
    rows = _with_piece(_metric_rows(samples, known, slice_seconds))
    return _alert_columns(_fired(_islands(_fragments(rows))), known)


def alert_states(samples: DataFrame, rules: DataFrame, slice_seconds: float = Params.slice_seconds) -> DataFrame:
    """State after the last sample, per rule and instance."""
    known = _Rules(rules)
    fragments = _fragments(_with_piece(_metric_rows(samples, known, slice_seconds)))
    newest = fragments.groupBy(*KEY).agg(
        F.max(
            F.struct(
                "slice",
                "piece",
                F.col("cleared").isNull().alias("open"),
                "since",
                (F.col("hits_before") + F.size("hits")).alias("run"),
            )
        ).alias("last")
    )
    times = {m: F.max(F.when(F.col(m).isNotNull(), F.col("timestamp"))).alias(m) for m in known.metrics}
    seen = with_instance(samples).groupBy("inst").agg(*times.values())
    seen = known.expand(seen, ["inst"], {m: F.col(m) for m in times}).select(*KEY, F.col("value").alias("last_sample_at"))
    alerts = (
        _fired(_islands(fragments))
        .groupBy(*KEY)
        .agg(
            F.max(F.col("cleared") + F.col("cooldown")).alias("cooldown_until"),
            F.max(F.when(F.col("cleared").isNull(), F.col("fired_at"))).alias("active_triggered_at"),
        )
    )
    is_open = F.col("last.open") & (F.col("last.run") > 0)
    return (
        newest.join(seen, KEY)
        .join(alerts, KEY, "left")
        .select(
            "rule_id",
            *[c.alias(n) for n, c in instance_parts().items()],
            F.when(is_open, F.col("last.since")).alias("true_since"),
            F.when(is_open, F.col("last.run")).otherwise(0).cast("long").alias("consecutive_samples"),
            "last_sample_at",
            F.coalesce("cooldown_until", F.lit(0.0)).alias("cooldown_until"),
            "active_triggered_at",
        )
    )


def alert_transitions(samples: DataFrame, rules: DataFrame, slice_seconds: float = Params.slice_seconds) -> DataFrame:
    """Every change of every alert: triggered, updated (later matches) and resolved.

    Samples meet the alert of their island by an equi-join on the island piece.
    """
    rows = _with_piece(_metric_rows(samples, _Rules(rules), slice_seconds))
    fragments = _fragments(rows)
    fired = _fired(_islands(fragments)).select(*GROUP, "island", "fired_at")
    piece = ["inst", "slice", "rule_id", "piece"]
    alerting = fragments.select(*piece, "route", "island").join(fired, [*GROUP, "island"]).select(*piece, "fired_at")
    events = rows.join(alerting, piece).filter(F.col("timestamp") >= F.col("fired_at"))
    kind = (
        F.when(~F.col("hit"), "resolved").when(F.col("timestamp") == F.col("fired_at"), "triggered").otherwise("updated")
    )
    return events.select(
        "rule_id",
        *[c.alias(n) for n, c in instance_parts().items()],
        F.col("fired_at").alias("triggered_at"),
        kind.alias("transition"),
        F.col("timestamp").alias("seen_at"),
        "value",
        "process_name",
        "username",
    )


def alerts_from_transitions(log: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert rows as the newest transition of each alert leaves them."""
    matched = F.when(F.col("transition") != "resolved", F.struct("seen_at", "process_name", "username"))
    folded = log.groupBy(*ALERT_KEY).agg(
        F.max(matched).alias("who"),
        F.max(F.struct("seen_at", "value")).alias("last"),
        F.max(F.when(F.col("transition") == "resolved", F.col("seen_at"))).alias("resolved_at"),
    )
    described = rules.select(
        "rule_id", F.col("name").alias("rule_name"), "metric", "operator", "threshold", "severity", "action"
    )
    return (
        folded.join(described, "rule_id")
        .withColumns(
            {
                "process_name": F.col("who.process_name"),
                "username": F.col("who.username"),
                "current_value": F.col("last.value"),
                "last_seen": F.col("last.seen_at"),
                "status": F.when(F.col("resolved_at").isNull(), "active").otherwise("resolved"),
            }
        )
        .select(*ALERT_COLUMNS)
    )


# --- reports over alerts -----------------------------------------------------

def newest_alerts_first() -> list[Column]:
    """Trigger time, then the rest of the alert key so that the order is total."""
    return [F.desc(name) for name in ["triggered_at", "rule_id", *INSTANCE]]


def with_alert_id(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("alert_id", alert_id())


def get_alert(alerts: DataFrame, identifier: str) -> DataFrame:
    return with_alert_id(alerts).filter(F.col("alert_id") == identifier)


def get_alert_state(states: DataFrame, rule_id: str, host: str, pid: int, create_time: float) -> DataFrame:
    return states.filter(
        (F.col("rule_id") == rule_id)
        & (F.col("host") == host)
        & (F.col("pid") == pid)
        & (F.col("create_time") == create_time)
    )


def active_alert_for(alerts: DataFrame, rule_id: str, host: str, pid: int, create_time: float) -> DataFrame:
    return (
        alerts.filter((F.col("rule_id") == rule_id) & (F.col("host") == host) & (F.col("pid") == pid))
        .filter((F.col("create_time") == create_time) & (F.col("status") == "active"))
        .orderBy(F.desc("triggered_at"))
        .limit(1)
    )


def recent_alerts(alerts: DataFrame, k: int = 8) -> DataFrame:
    """Newest ``k`` alerts per host."""
    return first_per_key(alerts, ["host"], newest_alerts_first(), k, "rank")


def instance_alerts(alerts: DataFrame, k: int = 100) -> DataFrame:
    """Newest ``k`` alerts per process instance."""
    return first_per_key(with_instance(alerts), ["inst"], newest_alerts_first(), k, "rank").drop("inst")


def alerts_summary(alerts: DataFrame) -> DataFrame:
    """Counts by severity and by status; the known words appear even at zero."""
    counts = (
        alerts.groupBy("severity", "status")
        .agg(F.count("*").alias("n"))
        .select("n", F.expr("stack(2, 'severity', severity, 'status', status) AS (dimension, word)"))
    )
    words = [("severity", w) for w in SEVERITIES] + [("status", w) for w in ALERT_STATUSES]
    zero = F.array(*[F.struct(F.lit(0).cast("long").alias("n"), F.lit(d).alias("dimension"), F.lit(w).alias("word")) for d, w in words])
    known = alerts.sparkSession.range(1).select(F.inline(zero))
    return counts.unionByName(known).groupBy("dimension", "word").agg(F.sum("n").alias("alerts"))
