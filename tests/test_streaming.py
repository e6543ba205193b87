import random

from helpers import CREATED, alert_tuples, frame_tuples, rule, rules, sample, samples, sequential, series
from hostlens.operators.alerts import alerts_from_transitions
from hostlens.session import configure
from hostlens.streaming import pipeline as st
from test_alerts import random_case


def test_alert_state_is_carried_across_triggers(spark, tmp_path):
    """The same rows in arrival order, cut into three files, give the alerts of the sequential walk."""
    configure(spark, streaming=True)
    rows, items = random_case(21)
    rows.sort(key=lambda r: (r["received_at"], r["seq"]))
    alerts, _, log = sequential(rows, items)
    book = rules(spark, *items)
    table, changes, checkpoint = (str(tmp_path / n) for n in ("table", "changes", "checkpoint"))
    third = len(rows) // 3 + 1
    for n in range(3):
        part = rows[n * third : (n + 1) * third]
        random.Random(n).shuffle(part)
        frame = samples(spark, [tuple(r.values()) for r in part])
        frame.selectExpr("'b' AS batch_id", "*").write.parquet(f"{table}/ingest_batch={n}/date=2023-11-14")
        stream = st.stream_alerts(st.stream_table(spark, table), book)
        st.start_changes(stream, changes, checkpoint).awaitTermination()
    moves = spark.read.parquet(changes)
    assert {tuple(r) for r in moves.select("rule_id", "host", "pid", "create_time", "triggered_at", "transition", "seen_at").collect()} == set(log)
    assert frame_tuples(alerts_from_transitions(moves, book)) == alert_tuples(alerts)


def test_deleted_rules_lose_their_state_and_disabled_rules_keep_it(spark, tmp_path):
    from helpers import CREATED, rule, sample

    configure(spark, streaming=True)
    table, changes, checkpoint = (str(tmp_path / n) for n in ("table", "changes", "checkpoint"))
    kept, gone = rule(rule_id="kept"), rule(rule_id="gone")
    books = [[kept, gone], [{**kept, "enabled": False}], [kept, gone]]
    for n, items in enumerate(books):
        frame = samples(spark, [sample(n, cpu_percent=90.0, timestamp=CREATED + n)])
        frame.selectExpr("'b' AS batch_id", "*").write.parquet(f"{table}/ingest_batch={n}/date=2023-11-14")
        stream = st.stream_alerts(st.stream_table(spark, table), rules(spark, *items))
        st.start_changes(stream, changes, checkpoint).awaitTermination()
    fired = {r.rule_id: r.triggered_at for r in spark.read.parquet(changes).collect()}
    assert fired == {"kept": CREATED + 2}


def test_a_repeated_batch_leaves_the_table_as_it_is(spark, tmp_path):
    from helpers import CREATED, sample
    from hostlens.sources.envelopes import to_envelopes

    configure(spark, streaming=True)
    rows = samples(spark, [sample(n, timestamp=CREATED + n) for n in range(3)])
    lines = to_envelopes(rows.selectExpr("0 AS chunk", "*"), ["chunk"]).select("value")
    lines.write.text(str(tmp_path / "in"))
    table, files = str(tmp_path / "table"), lambda: sorted(str(p) for p in (tmp_path / "table").rglob("*.parquet"))
    for again in ("first", "second"):  # another checkpoint: the same batch number once more
        st.stream_ingest(spark, str(tmp_path / "in"), table, str(tmp_path / again), replay=True).awaitTermination()
        known = files() if again == "first" else known
    assert files() == known and st.read_table(spark, f"{table}/samples").count() == 3
    hosts = st.stream_hosts(st.read_table(spark, f"{table}/samples")).collect()
    assert [r.sample_count for r in hosts] == [3]


def _stream_case(spark, tmp_path, batches, book, **options):
    """Feeds the batches one trigger each; transitions and the state after every one."""
    configure(spark, streaming=True)
    table, changes, checkpoint = (str(tmp_path / n) for n in ("table", "changes", "checkpoint"))
    held = []
    for n, rows in enumerate(batches):
        samples(spark, rows).selectExpr("'b' AS batch_id", "*").write.parquet(f"{table}/ingest_batch={n}/date=2023-11-14")
        stream = st.stream_alerts(st.stream_table(spark, table), book, **options)
        st.start_changes(stream, changes, checkpoint).awaitTermination()
        held.append({(r.pid, r.rule_id) for r in st.alert_state_rows(spark, checkpoint).collect()})
    moves = spark.read.parquet(changes).collect()
    return held, sorted((r.pid, r.transition, r.seen_at - CREATED) for r in moves)


def test_state_of_silent_instances_expires(spark, tmp_path):
    """State goes when the horizon and the grace have passed; living instances keep theirs; off by default."""
    hot = lambda n, pid, at: sample(n, pid=pid, cpu_percent=90.0, timestamp=CREATED + at)
    batches = [
        [hot(0, 1, 10), hot(1, 2, 10), hot(2, 3, 10)],
        [hot(3, 2, 200), hot(4, 3, 230)],  # 1 is away for 220 s, less than horizon and grace
        [hot(5, 2, 420), hot(6, 3, 330)],
        [hot(7, 1, 450), hot(8, 3, 440)],  # 1 comes back and starts anew; 2 was away for 220 s within the rows
    ]
    book = rules(spark, rule())
    held, moves = _stream_case(spark, tmp_path / "on", batches, book, expire_after=210.0, grace=50.0)
    key = lambda *pids: {(p, "cpu-hot") for p in pids}
    assert held == [key(1, 2, 3), key(1, 2, 3), key(2, 3), key(1, 2, 3)]
    # A second match in a row fires: of 2 at 200 (190 s on), not at 420 (away for 220 s); of 3 not at 230; of 1 not at 450.
    assert [m for m in moves if m[0] == 3] == [(3, "triggered", 330.0), (3, "updated", 440.0)]
    assert [m for m in moves if m[0] != 3] == [(2, "triggered", 200.0)]
    held, moves = _stream_case(spark, tmp_path / "off", batches, book)
    assert held[-1] == key(1, 2, 3) and (1, "triggered", 450.0) in moves and (2, "updated", 420.0) in moves


def test_a_restart_without_checkpoint_fires_nothing_twice(spark, tmp_path):
    """Active alerts alone are enough as seeds: the next match updates them, a clear resolves them."""
    book = rules(spark, rule(consecutive_samples=1))
    active = spark.createDataFrame(
        [("cpu-hot", "h1", 101, CREATED, CREATED + 5), ("gone", "h1", 101, CREATED, CREATED + 5), ("cpu-hot", "h1", 7, CREATED, CREATED + 6)],
        "rule_id string, host string, pid long, create_time double, active_triggered_at double",
    )
    rows = [[sample(0, cpu_percent=90.0), sample(1, pid=8, cpu_percent=90.0)], [sample(2, cpu_percent=1.0, timestamp=CREATED + 20)]]
    held, moves = _stream_case(spark, tmp_path, rows, book, seeds=st.alert_seeds(active))
    assert moves == [(8, "triggered", 10.0), (101, "resolved", 20.0), (101, "updated", 10.0)]
    assert held[-1] == {(101, "cpu-hot"), (7, "cpu-hot"), (8, "cpu-hot")}
    fired = {(r.pid, r.triggered_at - CREATED) for r in spark.read.parquet(str(tmp_path / "changes")).collect()}
    assert fired == {(8, 10.0), (101, 5.0)}


def test_twenty_thousand_rules_and_a_new_one_between_passes(spark, tmp_path):
    configure(spark, streaming=True)
    table, changes, checkpoint = (str(tmp_path / n) for n in ("table", "changes", "checkpoint"))
    many = [rule(rule_id=f"r{i}", threshold=float(i % 200), consecutive_samples=1) for i in range(20_000)]
    books, passes = [rules(spark, *many), rules(spark, *many, rule(rule_id="new", threshold=1.0, consecutive_samples=1))], []

    def going_on():
        if len(passes) == 2:
            return False
        n = len(passes)
        rows = [sample(n, cpu_percent=9.5, timestamp=CREATED + n)]
        samples(spark, rows).selectExpr("'b' AS batch_id", "*").write.parquet(f"{table}/ingest_batch={n}/date=2023-11-14")
        passes.append(n)
        return True

    st.follow_alerts(lambda: st.stream_table(spark, table), lambda: books[len(passes) - 1], changes, checkpoint, going_on, pause=0.0)
    moves = spark.read.parquet(changes)
    assert moves.filter("transition = 'triggered' and seen_at = 1.7e9").count() == 1_000
    assert moves.filter("transition = 'updated'").count() == 1_000
    assert [r.rule_id for r in moves.filter("transition = 'triggered' and seen_at > 1.7e9").collect()] == ["new"]


def test_streamed_receipts_count_alerts(spark):
    receipts = spark.createDataFrame([("a", "h1", 2, 0, 0), ("b", "h1", 1, 1, 0)], "batch_id string, host string, accepted long, duplicates long, alerts_triggered long")
    accepted = samples(spark, [sample(0), sample(1, timestamp=CREATED + 11), sample(2, timestamp=CREATED + 12)])
    accepted = accepted.selectExpr("CASE WHEN seq < 2 THEN 'a' ELSE 'b' END AS batch_id", "*")
    moves = spark.createDataFrame(
        [(f"r{i}", "h1", 101, CREATED, CREATED + at, kind) for i, (at, kind) in enumerate([(10, "triggered"), (11, "triggered"), (10, "updated")])],
        "rule_id string, host string, pid long, create_time double, triggered_at double, transition string",
    )
    rows = {r.batch_id: r.alerts_triggered for r in st.streamed_receipts(receipts, accepted, moves).collect()}
    assert rows == {"a": 2, "b": 0}


def test_a_wrong_clock_makes_no_other_row_late(spark, tmp_path):
    """One host's clock stands in 2099, another's days back; copies come in later triggers."""
    configure(spark, streaming=True)
    table, day = str(tmp_path / "table"), 86_400.0
    row = lambda n, **v: sample(n, received_at=CREATED + 100 * n, **v)
    batches = [
        [row(0), row(1, host="h2", timestamp=4_102_000_000.0)],
        [row(2, pid=5, cpu_percent=3.5), row(3, cpu_percent=99.0), row(4, host="h3", timestamp=CREATED - 200 * day)],
        [row(5, host="h2", timestamp=4_102_000_000.0, cpu_percent=1.0), row(6, timestamp=CREATED + 11, cpu_percent=None)],
    ]
    for n, rows in enumerate(batches):
        samples(spark, rows).selectExpr("'b' AS batch_id", "*").write.parquet(f"{table}/ingest_batch={n}/date=2023-11-14")
        for name, stream in (("dedup", st.stream_dedup(st.stream_table(spark, table), "1 hour")), ("series", st.stream_metric_series(st.stream_table(spark, table), 60, "1 hour"))):
            st.start_changes(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    once = spark.read.parquet(str(tmp_path / "dedup")).collect()
    assert sorted((r.seq, r.cpu_percent) for r in once) == [(0, 12.5), (1, 12.5), (2, 3.5), (4, 12.5), (6, None)]
    sums = st.newest_rows(spark.read.parquet(str(tmp_path / "series")), ["bucket", "received_day"])
    rows = {r.bucket: r for r in st.combined_series(sums).collect()}
    assert sum(r.activity for r in rows.values()) == 7 and len(rows) == 3
    near = rows[(CREATED + 10) // 60 * 60]
    assert (near.activity, near.cpu) == (4, round((12.5 + 3.5 + 99.0) / 3, 3))


def test_samples_and_changes_cross_to_the_workers_packed(spark, tmp_path):
    """A trigger's rows go to the workers as a key and one text each, and come back as one text for a thousand changes."""
    readings = [float("nan"), 90.0, 10.0] + [90.0] * 1_500
    series(spark, readings).write.parquet(f"{tmp_path}/samples")
    known = rules(spark, rule(consecutive_samples=1, cooldown=0.0))
    stream = st.stream_alerts(st.stream_table(spark, f"{tmp_path}/samples"), known)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "to_json" in plan and "from_json" in plan
    st.start_changes(stream, f"{tmp_path}/changes", f"{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/changes").groupBy("host", "pid", "create_time", "transition").count().collect()
    assert {(r.host, r.pid, r.create_time, r.transition, r["count"]) for r in rows} == {
        ("h1", 101, CREATED, "triggered", 2), ("h1", 101, CREATED, "resolved", 1), ("h1", 101, CREATED, "updated", 1_499),
    }
