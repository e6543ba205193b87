import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helpers import CREATED, rule, rules, sample, samples
from hostlens.operators import alerts as al
from hostlens.operators import hosts as ho
from hostlens.operators import keys, kpis, search, series
from hostlens.operators import outbox as ob
from hostlens.operators import rules as ru
from hostlens.operators import snapshot as sn
from hostlens.params import Params, activity_bucket, clamp_incident_window, clamp_window, series_bucket
from hostlens.schemas import ALERT, RULE
from test_incidents import alert_at

NOW = CREATED + 1000


def latest_states(spark, states):
    rows = [sample(i, pid=p, state=s, timestamp=NOW - 20 + t, received_at=NOW - 20 + t) for i, (p, t, s) in enumerate(states)]
    frame = samples(spark, rows)
    return kpis.kpi_summary(frame, ho.host_registry(frame), spark.createDataFrame([], ALERT), NOW).first()


def test_running_processes(spark):
    assert latest_states(spark, [(1, 0, "running"), (2, 0, "Running"), (3, 0, "sleeping"), (4, 0, "stopped")]).total_running_processes == 2
    assert latest_states(spark, [(1, 0, "sleeping"), (1, 1, "running")]).total_running_processes == 1
    assert latest_states(spark, [(1, 0, "unknown"), (2, 0, "idle")]).total_running_processes == 0


def test_empty_kpis(spark):
    frame = samples(spark, [sample()]).filter("false")
    row = kpis.kpi_summary(frame, ho.host_registry(frame), spark.createDataFrame([], ALERT), NOW).first()
    assert (row.total_hosts, row.healthy_percent, row.cpu_percent, row.samples_received) == (0, 0, 0.0, 0)


def host_case(spark):
    rows = [
        sample(1, host="Live", pid=1, received_at=NOW - 10, cpu_percent=None, memory_percent=70.0),
        sample(2, host="Live", pid=2, received_at=NOW - 10, cpu_percent=30.0, memory_percent=60.0),
        sample(3, host="stale", pid=1, received_at=NOW - 100),
        sample(4, host="Off", pid=1, received_at=NOW - 950),
    ]
    frame = samples(spark, rows)
    alerts = alert_at(spark, NOW - 10, host="Live", pid=2)
    return frame, ho.host_registry(frame), alerts


def test_host_summary_zeroes_offline_hosts_and_caps_memory(spark):
    frame, registry, alerts = host_case(spark)
    latest = sn.latest_samples(frame, NOW, 3600)
    got = {r.host: r for r in ho.host_summary(registry, latest, alerts, NOW).collect()}
    live, off = got["Live"], got["Off"]
    assert (live.status, live.process_count, live.cpu_percent, live.memory_percent, live.active_alert_count) == ("live", 2, 30.0, 100.0, 1)
    assert got["stale"].status == "stale"
    assert (off.status, off.process_count, off.cpu_percent) == ("offline", 0, 0.0)
    long = {r.host: r for r in ho.host_summary(registry, latest, alerts, NOW, Params(offline_after=2000)).collect()}
    assert (long["Off"].status, long["Off"].process_count) == ("stale", 0)
    cards = [r.host for r in ho.host_cards(ho.host_summary(registry, latest, alerts, NOW), 2).collect()]
    assert cards == ["Live", "Off"]


def test_activity_grid_is_dense(spark):
    frame, registry, _ = host_case(spark)
    rows = ho.host_activity(registry, frame, NOW, 720).orderBy("host", "position").collect()
    assert len(rows) == 39
    live = [r for r in rows if r.host == "Live"]
    assert sum(r.value for r in live) == 2 and live[0].height is None and max(r.height for r in live[1:]) == 18
    assert all(r.height == 3 for r in live[1:] if r.value == 0)
    assert all(b.timestamp - a.timestamp == 60 for a, b in zip(live, live[1:]))


def test_process_list_sorting_filters_and_pages(spark):
    rows = [sample(i, pid=i, process_name=n, cpu_percent=c, memory_percent=float(i)) for i, (n, c) in
            enumerate([("Beta", 5.0), ("alpha", None), ("gamma", 9.0), ("Delta", 9.0)])]
    frame = samples(spark, rows)
    alerts = alert_at(spark, NOW, pid=2).unionByName(alert_at(spark, NOW, pid=3, status="resolved"))

    def pids(**options):
        page = sn.list_processes(frame, alerts, NOW, lookback=5000, **options)
        return [r.pid for r in page.rows.collect()], page.total.first().total

    assert pids() == ([3, 2, 0, 1], 4)
    assert pids(sort="nonsense", order="asc") == ([1, 0, 3, 2], 4)
    assert pids(sort="process_name", order="asc") == ([1, 0, 3, 2], 4)
    assert pids(page=2, page_size=3) == ([1], 4)
    assert pids(cpu_min=9) == ([3, 2], 2)
    assert pids(memory_min=1.5, alert_only=True) == ([2], 1)
    assert pids(search="ELT", state="RUNNING") == ([3], 1)
    flags = {r.pid: r.has_active_alert for r in sn.list_processes(frame, alerts, NOW, lookback=5000).rows.collect()}
    assert flags == {0: 0, 1: 0, 2: 1, 3: 0}
    info = search.page_info(sn.list_processes(frame, alerts, NOW, lookback=5000).total, 2, 3).first()
    assert (info.max_page, info.showing) == (2, "4–4")


def test_history_and_instances(spark):
    rows = [sample(i, timestamp=CREATED + i, create_time=CREATED + (0 if i < 5 else 4.5)) for i in range(10)]
    frame = samples(spark, rows)
    page = search.history(frame, search.Cut(2, 1), (CREATED + 2, CREATED + 7), host="h1", pid=101)
    assert [r.seq for r in page.rows.collect()] == [6, 5] and page.total.first().total == 6
    assert sn.resolve_instance(frame, "h1", 101).first().create_time == CREATED + 4.5
    assert {r.seq for r in sn.instance_current(frame).collect()} == {4, 9}
    for width in (2.0, 1e6):
        kept = sn.instance_history(frame, NOW, limit=3, slice_seconds=width).collect()
        assert sorted(r.seq for r in kept) == [0, 1, 2, 5, 6, 7]
    points = sn.instance_series(frame)
    assert points.count() == 40
    flat = series.series_bounds(points).filter("series = 'cpu'").first()
    assert (flat.low, flat.high) == (11.5, 13.5)


def test_metric_buckets_ignore_nulls(spark):
    rows = [sample(i, timestamp=CREATED + t, cpu_percent=c) for i, (t, c) in enumerate([(0, None), (1, 10.0), (2, 20.0), (61, None)])]
    got = series.metric_series(samples(spark, rows), CREATED + 100, 3600).orderBy("bucket").collect()
    assert [(r.cpu, r.activity) for r in got] == [(15.0, 3), (0.0, 1)]


def test_global_search(spark):
    frame, registry, alerts = host_case(spark)
    found = search.global_search(frame, registry, alerts, " LIVE ", NOW).orderBy("kind", "position").collect()
    assert [(r.kind, r.label, r.pid) for r in found] == [
        ("alert", "High CPU", 2), ("host", "Live", None), ("process", "worker.exe", 2), ("process", "worker.exe", 1)
    ]
    assert search.global_search(frame, registry, alerts, " l ", NOW).count() == 0


def test_delivery_order(spark):
    alerts = alert_at(spark, CREATED + 3).unionByName(alert_at(spark, CREATED + 1, action="webhook"))
    alerts = alerts.unionByName(alert_at(spark, CREATED + 200, action="email")).unionByName(alert_at(spark, CREATED + 1, rule_id="q", action="webhook"))
    rows = ob.notification_outbox(alerts, email_configured=False).orderBy("delivery_seq").collect()
    assert [(r.delivery_seq, r.rule_id, r.delivery, r.subject) for r in rows] == [
        (1, "q", "ready", None), (2, "r1", "ready", None), (3, "r1", "not_configured", "Alert: High CPU")
    ]
    assert rows[0].body.startswith('{"event":"alert.triggered","alert":{"alert_id":"q|h1|101|')


def test_clamps():
    assert [clamp_window(v, 3600) for v in (None, 5, 10**9)] == [3600, 60, 604_800]
    assert [clamp_incident_window(v) for v in (1, 60, 10**6)] == [10, 60, 3600]
    assert (series_bucket(60), series_bucket(3600), activity_bucket(600), activity_bucket(3600)) == (10, 60, 60, 300)


def test_rule_log(spark):
    log = [
        (1, "create", "a", 10.0), (2, "create", "a", 20.0), (3, "update", "a", 30.0), (4, "update", "b", 40.0),
        (5, "create", "b", 50.0), (6, "delete", "b", 0.0), (7, "delete", "b", 0.0), (8, "create", "b", 80.0), (9, "create", "c", 1.0), (10, "delete", "c", 0.0),
    ]
    rows = [tuple(rule(rule_id=i, threshold=t).values()) + (seq, CREATED + seq, op) for seq, op, i, t in log]
    schema = ", ".join(f"{n} {RULE[n].dataType.simpleString()}" for n in rule()) + ", change_seq bigint, changed_at double, op string"
    frame = spark.createDataFrame(rows, schema)
    for width in (3, 100_000):
        ru.LOG_SLICE, saved = width, ru.LOG_SLICE
        try:
            book = ru.current_rules(frame)
            got = {r.rule_id: (r.threshold, r.created_at - CREATED, r.updated_at - CREATED) for r in book.rules.collect()}
            rejects = {(r.change_seq, r.reason) for r in book.rejects.collect()}
        finally:
            ru.LOG_SLICE = saved
        assert got == {"a": (30.0, 1, 3), "b": (80.0, 8, 8)}
        assert rejects == {(2, "already_exists"), (4, "not_found"), (7, "not_found")}


def test_rule_validation_and_listing(spark):
    good = rule(rule_id="ok.1", name=" B ")
    bad = rule(rule_id=".x", name=" ", metric="gpu", operator="ne", threshold=-1.0, duration=1e6, consecutive_samples=0,
               action="call", cooldown=1e6, severity="fatal")
    rows = {r.rule_id: r for r in ru.validate_rules(rules(spark, good, bad)).collect()}
    assert rows["ok.1"].valid and rows["ok.1"].name == "B"
    assert rows[".x"].errors == [
        "rule_id", "name", "metric", "operator", "threshold", "duration", "consecutive_samples", "action", "cooldown", "severity"
    ]
    book = rules(spark, rule(rule_id="1", name="b"), rule(rule_id="2", name="A"), rule(rule_id="3", name="0", enabled=False))
    assert [r.rule_id for r in ru.list_rules(book).collect()] == ["2", "1", "3"]
    assert ru.get_rule(book, "3").count() == 1 and ru.list_rules(book, enabled=False).count() == 1


def test_states_follow_their_rules(spark):
    frame = samples(spark, [sample()])
    states = al.alert_states(frame, rules(spark, rule(rule_id="a"), rule(rule_id="b")), 60.0)
    assert [r.rule_id for r in ru.surviving_states(states, rules(spark, rule(rule_id="b"))).collect()] == ["b"]


def test_sliced_helpers_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), i, rng.randint(0, 50)) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, t bigint, v int")
    sliced = keys.preceding_max(frame.withColumn("s", F.floor(F.col("t") / 7)), ["k"], "s", ["t"], {"m": F.col("v")})
    plain = frame.withColumn("m", F.max("v").over(W.partitionBy("k").orderBy("t").rowsBetween(W.unboundedPreceding, -1)))
    assert {tuple(r) for r in sliced.select("k", "t", "m").collect()} == {tuple(r) for r in plain.select("k", "t", "m").collect()}
    counted = keys.numbered(frame, [], F.floor(F.col("t") / 9), ["t"], "n")
    assert [r.n for r in counted.orderBy("t").collect()] == list(range(1, 401))
    oldest = keys.oldest_per_key(frame.withColumn("timestamp", F.col("t").cast("double")), "k", ["t"], 20, 11.0, "n")
    full = {(r.k, r.t) for r in frame.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("t"))).filter("n <= 20").collect()}
    assert {(r.k, r.t) for r in oldest.collect()} == full


def test_overview_keeps_hosts_whose_samples_were_pruned(spark):
    from hostlens.operators import details

    rows = samples(spark, [sample(0, host="old", received_at=CREATED), sample(1, host="new", received_at=CREATED + 5000)])
    registry, left = ho.host_registry(rows), rows.filter("host = 'new'")
    alerts = spark.createDataFrame([], ALERT)
    hosts = details.overview(left, alerts, CREATED + 5001, registry=registry).hosts
    assert {r.host for r in hosts.collect()} == {"old", "new"}
    one = details.host_detail(left, alerts, "old", CREATED + 5001, registry=registry).summary
    assert [r.host for r in one.collect()] == ["old"]


def test_pages_behind_a_row(spark):
    """Rows that arrive between two pages, and rows of equal time, neither repeat nor hide any."""
    rows = [sample(i, pid=i, timestamp=CREATED + i // 3) for i in range(20)]
    frame, seen, last = samples(spark, rows), [], None
    for _ in range(4):
        page = search.history(frame, search.Cut(6, after=last), host="h1").rows.collect()
        seen += [r.seq for r in page]
        last = (page[-1].timestamp, page[-1].seq)
        frame = frame.unionByName(samples(spark, [sample(100 + len(seen), timestamp=CREATED + 50)]))
    assert seen == list(range(19, -1, -1))
    assert search.history(frame, search.Cut(6, after=(CREATED, 0))).total.first().total == 0


def test_filters_by_unknown_words_are_left_out(spark):
    alerts = spark.createDataFrame([("active", "info", "h1", 5.0), ("resolved", "critical", "h2", 6.0)], "status string, severity string, host string, triggered_at double")
    found = lambda **wanted: [r.host for r in search.alerts_with(alerts, **wanted).orderBy("host").collect()]
    assert found(status="all", severity="loud") == found(host="", status=None) == ["h1", "h2"]
    assert found(status="active") == ["h1"] and found(severity="critical", since=6.0) == ["h2"] and found(since=6.5) == []
