from pyspark.sql import functions as F

from helpers import CREATED, rule, rules, sample, samples, series
from hostlens.operators import alerts as al
from hostlens.operators import incidents as inc
from hostlens.schemas import ALERT


def alert_at(spark, at, **values):
    row = {
        "rule_id": "r1", "rule_name": "High CPU", "host": "h1", "pid": 101, "process_name": "worker.exe",
        "username": "operator", "create_time": CREATED, "metric": "cpu_percent", "operator": "gt", "threshold": 80.0,
        "current_value": 85.0, "severity": "critical", "status": "active", "triggered_at": at, "last_seen": at,
        "resolved_at": None, "action": "none", **values,
    }
    return spark.createDataFrame([tuple(row[n] for n in ALERT.fieldNames())], ALERT)


def texts(spark, alerts, frame, window=60):
    return [r.text for r in inc.incident_evidence(alerts, frame, window).orderBy("position").collect()]


def test_previous_peak_delta_and_marks(spark):
    frame = series(spark, [10.0, 20.0, 30.0, 40.0, 50.0, 85.0], start=CREATED - 9, step=10.0)
    alerts = alert_at(spark, CREATED + 51)
    got = inc.incident_summary(alerts, frame).first()
    assert (got.previous_value, got.current_value, got.peak_value, got.delta, got.sample_count) == (50, 85, 85, 35, 6)
    assert (got.duration_seconds, got.is_insufficient, got.current_timestamp) == (0.0, False, CREATED + 51)
    rows = inc.incident_timeline(alerts, frame).orderBy("position").collect()
    assert [r.label for r in rows] == ["Process started", "", "", "", "", "Alert triggered"]
    assert texts(spark, alerts, frame)[0] == (
        "CPU usage increased from 50.0% to 85.0% before the alert (change of +35.0 points)."
    )


def test_reused_pid_is_not_mixed_in(spark):
    old = [sample(0, cpu_percent=90.0, timestamp=CREATED + 5, create_time=CREATED - 500)]
    new = [sample(i + 1, cpu_percent=c, timestamp=CREATED + 10 * (i + 1)) for i, c in enumerate([10.0, 20.0, 30.0, 85.0])]
    got = inc.incident_summary(alert_at(spark, CREATED + 40), samples(spark, old + new)).first()
    assert (got.previous_value, got.peak_value, got.sample_count) == (30, 85, 4)


def test_single_and_missing_samples_are_insufficient(spark):
    alerts = alert_at(spark, CREATED + 30)
    one = samples(spark, [sample(0, cpu_percent=85.0, timestamp=CREATED + 30)])
    got = inc.incident_summary(alerts, one).first()
    assert got.is_insufficient and got.previous_value is None and got.sample_count == 1
    assert texts(spark, alerts, one) == [
        "Insufficient telemetry to determine the cause. Only 1 sample(s) available in the 60 second window.",
        "Single observation for this process instance: CPU at 85.0% at 22:13:50.",
        "Current CPU was 85.0% at alert time.",
    ]
    none = one.filter("pid < 0")
    got = inc.incident_summary(alerts, none).first()
    assert (got.sample_count, got.total_samples_in_window, got.current_timestamp) == (0, 0, CREATED + 30)
    assert texts(spark, alerts, none)[1:] == [
        "No samples were recorded for this process instance in the incident window."
    ]
    document = inc.incident_documents(alerts, none).first()
    assert document.timeline == [] and len(document.evidence) == 2


def test_sustained_run_memory_and_state_sentences(spark):
    rows = [
        sample(i, cpu_percent=c, timestamp=CREATED + 100 + 10 * i, memory_rss=m, memory_percent=4.0 + i)
        for i, (c, m) in enumerate([(10.0, 1000), (90.0, 1000), (95.0, 1000), (85.0, 1000 + 3 * 1048576)])
    ]
    alerts = alert_at(spark, CREATED + 130)
    assert texts(spark, alerts, samples(spark, rows)) == [
        "CPU usage decreased from 95.0% to 85.0% before the alert (change of -10.0 points).",
        "Peak CPU reached 95.0% at 22:15:20 during the incident window.",
        "CPU remained above the configured threshold (80 gt) for approximately 20 seconds before the alert.",
        "Memory (RSS) increased by 3.0 MB during the incident window (from 1000 to 3146728 bytes).",
        "Process state at alert time was 'running'.",
    ]


def test_null_breaks_the_trailing_run_and_no_previous_value_is_said(spark):
    rows = [sample(i, cpu_percent=c, timestamp=CREATED + 100 + 10 * i, state="") for i, c in enumerate([90.0, None, 85.0])]
    alerts = alert_at(spark, CREATED + 120)
    frame = samples(spark, rows)
    got = inc.incident_summary(alerts, frame).first()
    assert (got.previous_value, got.duration_seconds, got.peak_value, got.peak_timestamp) == (None, 0.0, 90.0, CREATED + 100)
    assert texts(spark, alerts, frame) == [
        "Current CPU was 85.0% at alert time; previous reading was unavailable (None).",
        "Peak CPU reached 90.0% during the incident window.",
        "CPU crossed the threshold (80 gt) at the alert sample; no sustained duration was observed in the 60s window.",
    ]
    quiet = samples(spark, [sample(i, cpu_percent=None, timestamp=CREATED + 100 + i, state="") for i in range(3)])
    assert texts(spark, alert_at(spark, CREATED + 102), quiet) == [
        "No clear change was observed in the available telemetry before the alert."
    ]


def test_long_timeline_is_sampled_evenly_with_the_last_row(spark):
    count = 100
    frame = series(spark, [50.0] * count, start=CREATED + 1000)
    rows = inc.incident_timeline(alert_at(spark, CREATED + 1000 + count), frame, 3600).orderBy("position").collect()
    step = count / 24
    wanted = [int(i * step) for i in range(24)]
    wanted[-1] = count - 1
    assert [int(r.timestamp - CREATED - 1001) for r in rows] == wanted
    assert [r.position for r in rows] == list(range(24))


def test_cap_counts_and_the_newest_samples_win(spark):
    frame = series(spark, [float(i) for i in range(30)], start=CREATED + 1000)
    got = inc.incident_summary(alert_at(spark, CREATED + 1030), frame, 60, cap=10).first()
    assert (got.sample_count, got.total_samples_in_window, got.current_value) == (10, 30, 29.0)


def test_all_alerts_at_once(spark):
    frame = series(spark, [90.0, 10.0] * 30)
    alerts = al.evaluate_alerts(frame, rules(spark, rule(consecutive_samples=1, cooldown=0.0)), 7.0)
    got = inc.incident_summary(alerts, frame, 10).orderBy("triggered_at").collect()
    assert len(got) == 30
    assert [g.sample_count for g in got[:7]] == [1, 3, 5, 7, 9, 11, 11]
    assert inc.incident_documents(alerts, frame, 10).filter(F.size("timeline") > 0).count() == 30


def test_alerts_are_not_broadcast_to_the_samples(spark, tmp_path):
    """A small file of alerts grows many times over when it is laid out in cells: the driver must not gather it."""
    alert_at(spark, CREATED + 40).write.parquet(f"{tmp_path}/alerts")
    series(spark, [10.0, 85.0], step=20.0).write.parquet(f"{tmp_path}/samples")
    alerts, frame = spark.read.parquet(f"{tmp_path}/alerts"), spark.read.parquet(f"{tmp_path}/samples")
    plan = inc.incident_samples(alerts, frame)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    document = inc.incident_documents(alerts, frame).first()
    shown = inc.incident_timeline(alerts, frame).orderBy("position").drop("alert_id").collect()
    assert document.timeline == shown and len(shown) == 2
