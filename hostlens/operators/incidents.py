"""Reconstruction of the window before each alert, for all alerts in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.functions.exprs import (
    alert_id,
    fmt_time,
    format_value,
    general_number,
    matches,
    metric_label,
    one_decimal,
    signed_one_decimal,
)
from hostlens.operators.keys import first_per_key, with_instance
from hostlens.params import clamp_incident_window
from hostlens.schemas import ALERT_KEY, METRICS

# Default window, samples analysed and timeline rows per incident.
WINDOW = 60
SAMPLE_CAP = 1_000
TIMELINE_POINTS = 24


def _keyed(alerts: DataFrame) -> DataFrame:
    return with_instance(alerts).withColumn("alert_id", alert_id())


def _newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("seq")]


def _window_pairs(alerts: DataFrame, samples: DataFrame, window: int) -> DataFrame:
    """Each alert with the samples of its instance in the window that ends at the trigger.

    Time is cut into window-sized cells, an alert looks into the two it can touch: an
    equi-join on (instance, cell) instead of all pairs of an instance. It is a merge join: Spark judges a table of alerts by the
    size of its files, and laid out in cells with long keys it takes many times that as a broadcast.
    """
    width = F.lit(float(window))
    cell = F.floor(F.col("timestamp") / width)
    wanted = _keyed(alerts).select(
        "alert_id", "inst", "create_time", "metric", "operator", "threshold", "triggered_at",
        F.explode(
            F.sequence(F.floor((F.col("triggered_at") - window) / width), F.floor(F.col("triggered_at") / width))
        ).alias("__cell"),
    )
    points = with_instance(samples).select(
        "inst", cell.alias("__cell"), "timestamp", "seq", *METRICS, "state"
    )
    return (
        wanted.hint("merge").join(points, ["inst", "__cell"])
        .filter(F.col("timestamp").between(F.col("triggered_at") - window, F.col("triggered_at")))
        .drop("__cell")
    )


def _selected_metric() -> Column:
    return F.coalesce(*[F.when(F.col("metric") == m, F.col(m).cast("double")) for m in METRICS])


def incident_samples(alerts: DataFrame, samples: DataFrame, window: int = WINDOW, cap: int = SAMPLE_CAP) -> DataFrame:
    """The newest ``cap`` window samples per alert; ``newest`` counts back from the trigger."""
    pairs = _window_pairs(alerts, samples, clamp_incident_window(window))
    return first_per_key(pairs, ["alert_id"], _newest_first(), cap, "newest").withColumn("value", _selected_metric())


def _facts(alerts: DataFrame, samples: DataFrame, window: int, cap: int, points: int | None = None) -> DataFrame:
    """Everything the summary and the evidence texts need: one row per alert; with ``points`` also its timeline."""
    window = clamp_incident_window(window)
    kept = incident_samples(alerts, samples, window, cap)
    backwards = W.partitionBy("alert_id").orderBy(*_newest_first()).rowsBetween(W.unboundedPreceding, 0)
    holds = F.coalesce(matches(F.col("operator"), F.col("value"), F.col("threshold")), F.lit(False))
    kept, more = kept.withColumn("misses", F.count_if(~holds).over(backwards)), []
    if points is not None:
        kept, shown = _placed(kept, points), F.when(F.col("position").isNotNull(), F.struct(*_timeline_columns()))
        more = [F.array_sort(F.collect_list(shown)).alias("timeline")]
    point = F.struct("timestamp", "value", "memory_rss", "memory_percent", "state")
    stamp = F.col("timestamp")
    folded = kept.groupBy("alert_id").agg(
        F.count("*").alias("sample_count"),
        F.max(F.when(F.col("newest") == 1, point)).alias("current"),
        F.max(F.when(F.col("newest") == 2, point)).alias("previous"),
        F.max(F.when(F.col("value").isNotNull(), F.struct("value", (-stamp).alias("earlier")))).alias("peak"),
        F.min(stamp).alias("first_at"),
        F.min(F.when(F.col("misses") == 0, stamp)).alias("run_start"),
        *more,
    )
    totals = _window_pairs(alerts, samples, window).groupBy("alert_id").agg(F.count("*").alias("total"))
    now_value = F.col("current.value")
    holds_now = matches(F.col("operator"), now_value, F.col("threshold"))
    duration = F.when(now_value.isNotNull() & holds_now, F.greatest(F.lit(0.0), F.col("current.timestamp") - F.col("run_start")))
    return (
        _keyed(alerts)
        .join(folded, "alert_id", "left")
        .join(totals, "alert_id", "left")
        .withColumns(
            {
                "sample_count": F.coalesce("sample_count", F.lit(0)),
                "total_samples_in_window": F.coalesce("total", F.lit(0)),
                "window_seconds": F.lit(window),
                "window_start": F.col("triggered_at") - window,
                "window_end": F.col("triggered_at"),
                "value_now": now_value,
                "value_before": F.col("previous.value"),
                "peak_value": F.col("peak.value"),
                "peak_timestamp": -F.col("peak.earlier"),
                "delta": now_value - F.col("previous.value"),
                "memory_delta_bytes": F.col("current.memory_rss") - F.col("previous.memory_rss"),
                "memory_delta_percent": F.col("current.memory_percent") - F.col("previous.memory_percent"),
                "duration_seconds": F.when(now_value.isNotNull(), F.coalesce(duration, F.lit(0.0))),
                "holds_now": F.coalesce(holds_now, F.lit(False)),
            }
        )
    )


def _summary_columns() -> list[Column]:
    return [
        *[F.col(c) for c in ("metric", "operator", "threshold", "window_seconds", "window_start", "window_end")],
        F.col("sample_count"),
        F.col("total_samples_in_window"),
        F.col("value_before").alias("previous_value"),
        F.col("value_now").alias("current_value"),
        F.col("peak_value"),
        F.col("peak_timestamp"),
        F.col("delta"),
        F.col("memory_delta_bytes"),
        F.col("duration_seconds"),
        (F.col("sample_count") < 2).alias("is_insufficient"),
        F.col("previous.timestamp").alias("previous_timestamp"),
        F.coalesce("current.timestamp", "triggered_at").alias("current_timestamp"),
    ]


def incident_summary(
    alerts: DataFrame, samples: DataFrame, window: int = WINDOW, cap: int = SAMPLE_CAP
) -> DataFrame:
    return _facts(alerts, samples, window, cap).select(*ALERT_KEY, *_summary_columns())


def incident_header(alerts: DataFrame) -> DataFrame:
    """The alert and process blocks of an incident."""
    age = F.greatest(F.lit(0.0), F.col("triggered_at") - F.col("create_time"))
    return alerts.select(
        "*",
        F.col("create_time").alias("started_at"),
        fmt_time(F.col("create_time")).alias("started_time"),
        age.alias("age_seconds_at_alert"),
    )


def incident_timeline(
    alerts: DataFrame,
    samples: DataFrame,
    window: int = WINDOW,
    cap: int = SAMPLE_CAP,
    points: int = TIMELINE_POINTS,
) -> DataFrame:
    """At most ``points`` evenly picked samples per alert, always with the last one."""
    kept = _placed(incident_samples(alerts, samples, window, cap), points)
    return kept.filter(F.col("position").isNotNull()).select("alert_id", *_timeline_columns())


def _placed(kept: DataFrame, points: int) -> DataFrame:
    """The samples of each alert with their position in its timeline, null if they are not shown."""
    count = F.count("*").over(W.partitionBy("alert_id"))
    kept = kept.withColumn("__n", count).withColumn("__index", F.col("__n") - F.col("newest"))
    picks = F.sequence(F.lit(0), F.lit(points - 2))
    step = F.col("__n") / F.lit(float(points))
    sampled = F.get(F.filter(picks, lambda i: (i * step).cast("long") == F.col("__index")), F.lit(0))
    position = (
        F.when(F.col("__n") <= points, F.col("__index"))
        .when(F.col("newest") == 1, F.lit(points - 1))
        .otherwise(sampled)
    )
    return kept.withColumn("position", position)


def _timeline_columns() -> list[Column]:
    is_alert = F.col("newest") == 1
    is_start = (F.col("__index") == 0) & (F.abs(F.col("timestamp") - F.col("create_time")) < 5)
    return [
        F.col("position").cast("int").alias("position"),
        F.col("timestamp"),
        fmt_time(F.col("timestamp")).alias("time"),
        *[F.col(m) for m in METRICS],
        F.col("state"),
        is_alert.alias("is_alert"),
        is_start.alias("is_start"),
        F.when(is_alert, "Alert triggered").when(is_start, "Process started").otherwise("").alias("label"),
    ]


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _with_shown(facts: DataFrame) -> DataFrame:
    """Adds the formatted values the sentences use, each formatted once."""
    metric, percent = F.col("metric"), F.lit("memory_percent")
    return facts.withColumns(
        {
            "shown_now": format_value(metric, F.col("value_now")),
            "shown_before": format_value(metric, F.col("value_before")),
            "shown_peak": format_value(metric, F.col("peak_value")),
            "shown_memory_before": format_value(percent, F.col("previous.memory_percent")),
            "shown_memory_now": format_value(percent, F.col("current.memory_percent")),
        }
    )


def _evidence_texts() -> Column:
    # The wording of the evidence sentences.
    metric, count = F.col("metric"), F.col("sample_count")
    now, before, peak = F.col("value_now"), F.col("value_before"), F.col("peak_value")
    label = metric_label(metric)

    shown_now, shown_before, shown_peak = (F.col(f"shown_{n}") for n in ("now", "before", "peak"))

    def whole(value: Column) -> Column:
        return value.cast("long").cast("string")

    def up_or_down(change: Column) -> Column:
        return F.when(change > 0, "increased").otherwise("decreased")

    window = F.col("window_seconds").cast("string")
    few, enough = count < 2, count >= 2
    delta = F.col("delta")
    bound = _text("(", general_number(F.col("threshold")), " ", F.col("operator"), ")")
    peak_at = _text("Peak ", label, " reached ", shown_peak, " at ", fmt_time(F.col("peak_timestamp")), " during the incident window.")
    peak_moved = F.abs(F.col("peak_timestamp") - F.col("current.timestamp")) > 1
    memory, percent = F.col("memory_delta_bytes"), F.col("memory_delta_percent")
    memory_moved = F.coalesce(F.abs(memory) > 1024, F.lit(False))
    born, fired = F.col("create_time"), F.col("triggered_at")
    born_inside = born.between(F.col("window_start"), F.col("window_end"))
    state = F.col("current.state")
    lines = [
        F.when(few, _text("Insufficient telemetry to determine the cause. Only ", count.cast("string"),
                          " sample(s) available in the ", window, " second window.")),
        F.when((count == 1) & now.isNotNull(), _text("Single observation for this process instance: ", label, " at ",
                                                     shown_now, " at ", fmt_time(F.col("current.timestamp")), ".")),
        F.when(count == 0, F.lit("No samples were recorded for this process instance in the incident window.")),
        F.when(few & now.isNotNull(), _text("Current ", label, " was ", shown_now, " at alert time.")),
        F.when(enough & now.isNotNull() & before.isNotNull(),
               F.when(F.abs(delta) > 0.01,
                      _text(label, " usage ", up_or_down(delta), " from ", shown_before, " to ", shown_now,
                            " before the alert (change of ", signed_one_decimal(delta), " points)."))
               .otherwise(_text(label, " remained at ", shown_now, " (previous ", shown_before, ")."))),
        F.when(enough & now.isNotNull() & before.isNull(),
               _text("Current ", label, " was ", shown_now,
                     " at alert time; previous reading was unavailable (None).")),
        F.when(enough & peak.isNotNull(),
               F.when(before.isNotNull() & ~peak.eqNullSafe(now), peak_at)
               .when(before.isNull(), _text("Peak ", label, " reached ", shown_peak, " during the incident window."))
               .when((peak == now) & peak_moved, peak_at)),
        F.when(enough & (F.col("duration_seconds") > 0),
               _text(label, " remained above the configured threshold ", bound, " for approximately ",
                     whole(F.col("duration_seconds")), " seconds before the alert.")),
        F.when(enough & (F.col("duration_seconds") == 0) & F.col("holds_now"),
               _text(label, " crossed the threshold ", bound, " at the alert sample; no sustained duration was observed in the ",
                     window, "s window.")),
        F.when(enough & memory_moved,
               _text("Memory (RSS) ", up_or_down(memory), " by ", one_decimal(F.abs(memory) / F.lit(1048576.0)),
                     " MB during the incident window (from ", F.col("previous.memory_rss").cast("string"), " to ",
                     F.col("current.memory_rss").cast("string"), " bytes).")),
        F.when(enough & ~memory_moved & (F.abs(percent) > 0.5),
               _text("Memory usage ", up_or_down(percent), " from ",
                     F.col("shown_memory_before"), " to ", F.col("shown_memory_now"), " during the same period.")),
        F.when(enough & born_inside,
               _text("The process started at ", fmt_time(born), " within the incident window; only ", whole(fired - born),
                     " seconds of history were available before the alert.")),
        F.when(enough & ~born_inside & (F.col("first_at") - born < 10),
               _text("Process started at ", fmt_time(born),
                     "; incident window includes data from shortly after start.")),
        F.when(enough & (F.coalesce(state, F.lit("")) != ""), _text("Process state at alert time was '", state, "'.")),
    ]
    found = F.array_compact(F.array(*lines))
    fallback = F.array(F.lit("No clear change was observed in the available telemetry before the alert."))
    return F.array_distinct(F.when(enough & (F.size(found) == 0), fallback).otherwise(found))


def incident_evidence(
    alerts: DataFrame, samples: DataFrame, window: int = WINDOW, cap: int = SAMPLE_CAP
) -> DataFrame:
    """Evidence sentences in order, one row each."""
    facts = _with_shown(_facts(alerts, samples, window, cap))
    return facts.select(*ALERT_KEY, F.posexplode(_evidence_texts()).alias("position", "text"))


def incident_documents(
    alerts: DataFrame, samples: DataFrame, window: int = WINDOW, cap: int = SAMPLE_CAP
) -> DataFrame:
    """One nested document per alert: incident, process, summary, timeline, evidence, window."""
    facts = _with_shown(_facts(incident_header(alerts), samples, window, cap, TIMELINE_POINTS))
    texts = facts.withColumn("summary", F.struct(*_summary_columns())).withColumn("evidence", _evidence_texts())
    process = ["host", "pid", "create_time", "process_name", "username", "started_at", "started_time", "age_seconds_at_alert"]
    incident = [c for c in alerts.columns if c != "alert_id"]
    return (
        texts.select(
            "alert_id",
            F.struct(*incident).alias("incident"),
            F.struct(*process).alias("process"),
            "summary",
            F.coalesce("timeline", F.array().cast(facts.schema["timeline"].dataType)).alias("timeline"),
            "evidence",
            F.struct(
                F.col("summary.window_start").alias("start"),
                F.col("summary.window_end").alias("end"),
                F.col("summary.window_seconds").alias("seconds"),
            ).alias("window"),
        )
    )
