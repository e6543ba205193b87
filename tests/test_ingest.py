import json

import pytest
from pyspark.sql import functions as F

from helpers import CREATED, sample, samples
from hostlens.operators import ingest as ing
from hostlens.operators import retention
from hostlens.operators.validate import validate_samples
from hostlens.sources import envelopes as en
from hostlens.sources import spool as sp


def test_identity_and_pid_reuse(spark):
    first = samples(spark, [sample(1)])
    again = samples(spark, [sample(2, received_at=CREATED + 99), sample(3, create_time=CREATED + 1)])
    taken = ing.accept_samples(again, first).collect()
    assert [r.seq for r in taken] == [3]


def test_first_arrival_wins(spark):
    rows = [sample(5, received_at=CREATED + 30, cpu_percent=1.0), sample(9, received_at=CREATED + 20, cpu_percent=2.0),
            sample(7, received_at=CREATED + 20, cpu_percent=3.0)]
    assert ing.dedup_samples(samples(spark, rows)).first().cpu_percent == 3.0


def test_receipts_count_copies_per_batch(spark):
    rows = [sample(i, pid=p) for i, p in enumerate([1, 1, 2, 2, 3])]
    new = samples(spark, rows).withColumn("batch_id", F.when(F.col("seq") < 3, "a").otherwise("b"))
    got = {r.batch_id: (r.accepted, r.duplicates) for r in ing.ingest_receipts(new, ing.accept_samples(new)).collect()}
    assert got == {"a": (2, 1), "b": (1, 1)}


def test_written_batches_are_read_back_and_may_be_repeated(spark, tmp_path):
    table = str(tmp_path / "samples")
    new = samples(spark, [sample(1), sample(2, pid=7), sample(3, pid=7)])
    for _ in range(2):
        assert ing.append_samples(new, table, 0).count() == 2
    stored = spark.read.parquet(table)
    assert ing.append_samples(samples(spark, [sample(4), sample(5, pid=8)]), table, 1, stored).count() == 1
    assert spark.read.parquet(table).count() == 3


@pytest.mark.parametrize("field, value", [
    ("pid", -1), ("pid", 4_294_967_296), ("process_name", "   "), ("process_name", "a\x01b"), ("process_name", "x" * 513),
    ("create_time", 0.0), ("timestamp", 4_102_444_801.0), ("cpu_percent", 1000.5), ("cpu_percent", float("nan")),
    ("memory_percent", 100.1), ("memory_percent", None), ("memory_rss", -5), ("state", "s" * 33),
    ("username", "u" * 513), ("host", " "), ("host", "h" * 256),
])
def test_bad_fields_are_named(spark, field, value):
    row = validate_samples(samples(spark, [sample(1, received_at=1.0, **{field: value})])).first()
    assert row.errors == [field] and not row.valid


def test_good_edges_pass_and_texts_are_stripped(spark):
    row = validate_samples(
        samples(spark, [sample(1, pid=4_294_967_295, process_name="\t a b \n", cpu_percent=None, username=None, memory_percent=100.0)])
    ).first()
    assert row.valid and row.process_name == "a b" and row.cpu_percent is None


def test_batches_are_taken_whole(spark):
    rows = validate_samples(samples(spark, [sample(1), sample(2, pid=-1), sample(3), sample(4), sample(5)]))
    rows = rows.withColumn("batch_id", F.when(F.col("seq") < 3, "bad").when(F.col("seq") == 3, "good").otherwise("big"))
    admission = ing.admit_batches(rows, max_samples=1)
    assert [r.seq for r in admission.accepted.collect()] == [3]
    assert {(r.seq, r.reason) for r in admission.rejected.collect()} == {
        (1, "invalid"), (2, "invalid"), (4, "too_large"), (5, "too_large")
    }


def entry(**values):
    body = {"pid": 1, "process_name": "p", "create_time": 10, "timestamp": 20.5, "memory_percent": 1, "memory_rss": 2,
            "read_bytes": 3, "write_bytes": 4}
    body.update(values)
    return {k: v for k, v in body.items() if v != "absent"}


def parsed(spark, *lines, **options):
    frame = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in lines], "value string")
    return en.parse_envelopes(frame, **options)


def test_envelopes_resolve_old_names_only_when_the_new_are_absent(spark):
    rows = en.envelope_samples(parsed(
        spark,
        {"hostname": "old", "processes": [entry(process_name="absent", name="legacy", user="u")]},
        {"host": "new", "hostname": "x", "metrics": [entry(name="ignored", username=None, user="ignored")]},
    )).orderBy("host").collect()
    assert [(r.host, r.process_name, r.username, r.state) for r in rows] == [
        ("new", "p", None, "running"), ("old", "legacy", "u", "running")
    ]
    assert rows[0].cpu_percent is None and rows[0].pid == 1 and rows[0].timestamp == 20.5


def test_admission_does_not_parse_samples_again(spark, tmp_path):
    """The filter on the reason stands above the parsed samples; below them it would parse them for each use of the reason."""
    (tmp_path / "lines").write_text(json.dumps({"host": "h", "samples": [entry()]}) + "\n")
    plan = en.envelope_samples(en.read_envelopes(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line.split("[")[0].split("(")[0]]
    assert any("reason" in line for line in filters) and not any("variant" in line for line in filters)


def test_envelope_reasons(spark):
    lines = [
        "{broken", {"host": "h", "samples": []}, {"samples": [entry()]}, {"host": "h", "samples": [entry(pid=1.5)]},
        {"host": "h", "samples": [entry(cpu_percent="much")]}, {"host": "h", "samples": [entry(state=None)]},
        {"host": "h", "samples": [entry(), entry()]}, {"host": " h ", "samples": [entry(pid="7", state="")]},
    ]
    got = {r.value: r.reason for r in parsed(spark, *lines, max_samples=1).collect()}
    wanted = ["invalid"] * 6 + ["too_large", None]
    assert [got[x if isinstance(x, str) else json.dumps(x)] for x in lines] == wanted
    kept = en.envelope_samples(parsed(spark, *lines, max_samples=1)).collect()
    assert [(r.host, r.pid, r.state) for r in kept] == [("h", 7, "running")]


def test_spool_keeps_the_newest_readable_lines(spark, tmp_path):
    def line(n):
        return json.dumps({"host": "h", "samples": [{"n": n}]})

    path = tmp_path / "spool.jsonl"
    path.write_text("\n".join([line(1), "{torn", line(2), '["host"]', '{"host": "h"}', line(3), line(4)]) + "\n")
    kept = sp.read_spool(spark, str(path), 2)
    values = [r.value for r in kept.orderBy(F.desc("newest")).collect()]
    assert values == [line(3), line(4)]
    sp.compact_spool(kept, str(tmp_path / "out"))
    assert sp.read_spool(spark, str(tmp_path / "out"), 200).count() == 2
    new = spark.createDataFrame([(0, line(9))], "position int, value string")
    assert [r.value for r in sp.replay_order(kept, new).collect()] == [line(3), line(4), line(9)]
    sp.compact_spool(kept.filter("false"), str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("spool_id=*")) == []


def test_spools_keep_their_id_over_many_compactions(spark, tmp_path):
    (tmp_path / "a 100%+b").mkdir()
    for name in ("one", "two"):
        lines = [json.dumps({"host": name, "samples": [{"n": n}]}) for n in range(4)]
        (tmp_path / "a 100%+b" / f"{name} =.jsonl").write_text("\n".join(lines) + "\n")
    kept = sp.read_spool(spark, str(tmp_path / "a 100%+b"))
    first = {tuple(r) for r in kept.collect()}
    assert len({r[0] for r in first}) == 2 and len(first) == 8
    for turn in range(20):
        path = str(tmp_path / f"turn{turn}")
        sp.compact_spool(kept, path)
        kept = sp.read_spool(spark, path)
    assert {tuple(r) for r in kept.collect()} == first


def test_event_ids_beyond_a_billion_stay_apart_from_copies(spark):
    from hostlens.sources import feed as fd

    at = "timestamp_micros(1704067200000000 + id * 1000000)"
    columns = ["id + 1000000000 * (id % 3) AS event_id", f"{at} AS ts", "id AS user_id", "'view' AS event_type", "1D AS value", """'{"k": 1}' AS props"""]
    events = spark.range(400).selectExpr(*columns).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows = fd.raw_samples(events)
    assert rows.filter("seq >= 0").count() == 400
    assert rows.count() > 400 and rows.select("seq").distinct().count() == rows.count()


def test_chunks_follow_pid_order(spark):
    rows = samples(spark, [sample(i, pid=p) for i, p in enumerate([9, 3000, 1, 5, 2000, 7, 2])])
    got = {r.chunk: [s.pid for s in r.samples] for r in ing.chunk_batches(rows, size=3).collect()}
    assert got == {0: [1, 2, 5], 1: [7, 9, 2000], 2: [3000]}


def test_first_reading_and_reading_after_a_gap_are_masked(spark):
    times = {1: [1, 2, 4, 5], 2: [1, 2, 3, 4, 5]}
    rows = [sample(p * 10 + t, pid=p, timestamp=CREATED + t, cpu_percent=float(t)) for p, ts in times.items() for t in ts]
    got = ing.mask_cpu_baseline(samples(spark, rows)).orderBy("pid", "timestamp").collect()
    assert [(r.pid, r.cpu_percent) for r in got] == [
        (1, None), (1, 2.0), (1, None), (1, 5.0), (2, None), (2, 2.0), (2, 3.0), (2, 4.0), (2, 5.0)
    ]


def test_retention_is_strict_and_repeatable(spark):
    now, day = CREATED, 86_400
    rows = samples(spark, [sample(i, pid=i, timestamp=now - age * day) for i, age in enumerate([40, 35, 30, 10, 1])])
    kept, deleted = retention.prune_samples(rows, now, 30)
    assert sorted(r.pid for r in kept.collect()) == [2, 3, 4] and deleted.first().deleted_count == 2
    assert retention.prune_samples(kept, now, 30).deleted.first().deleted_count == 0
    dated = rows.withColumn("date", ing.event_date())
    kept, deleted = retention.prune_samples(dated, now, 30)
    assert kept.count() == 3 and deleted.first().deleted_count == 2


def test_upgrade_keeps_the_lowest_arrival(spark):
    old = samples(spark, [sample(2), sample(1, cpu_percent=1.0)]).withColumnRenamed("username", "user").drop("received_at", "state")
    rows = retention.with_compat_fields(retention.upgrade_samples(old, CREATED)).collect()
    assert [(r.seq, r.username, r.user, r.state, r.received_at) for r in rows] == [
        (1, "operator", "operator", "running", CREATED + 10)
    ]


def test_payload_cannot_set_clock_or_order(spark, tmp_path):
    def line(name, **extra):
        return json.dumps({"host": "h", "samples": [{"pid": 1, "create_time": CREATED, "timestamp": CREATED + 9, "process_name": name, "cpu_percent": 1.0, "memory_percent": 1.0, "memory_rss": 1, "read_bytes": 1, "write_bytes": 1, **extra}] * 2})

    (tmp_path / "a.jsonl").write_text("\n".join([line("first", received_at="NaN", seq=10**12), line("second", received_at=5.0, seq=-4)]))
    rows = en.envelope_samples(en.read_envelopes(spark, str(tmp_path))).orderBy("seq").collect()
    assert [r.process_name for r in rows] == ["first", "first", "second", "second"]
    assert len({r.seq for r in rows}) == 4 and all(r.received_at > 1.7e9 and r.received_at < 1e11 for r in rows)
    again = en.envelope_samples(en.read_envelopes(spark, str(tmp_path), replay=True)).collect()
    assert {r.seq for r in again} == {10**12, -4}


def _verdicts(spark, cases):
    """Why envelopes with these values are turned away: reason and the names of bad fields."""
    lines = [{"n": n, "host": c.get("host", "h"), "samples": [entry(**{k: v for k, v in c.items() if k != "host"})]} for n, c in enumerate(cases)]
    rows = {json.loads(r.value)["n"]: r for r in parsed(spark, *lines).collect()}
    return [(rows[n].reason, sorted(rows[n].samples[0].errors)) for n in range(len(cases))]


def test_types_of_json_values_decide(spark):
    good = [
        {"pid": "7"}, {"pid": " 7 "}, {"pid": 7.0}, {"pid": True}, {"pid": "7.00"}, {"cpu_percent": "12.5"}, {"cpu_percent": False},
        {"cpu_percent": None}, {"username": None}, {"timestamp": "1e3"}, {"timestamp": ".5"}, {"memory_rss": 2**63 - 1}, {"process_name": " x "},
        {"process_name": "7"}, {"host": " h "}, {"host": "12"}, {"extra": {"a": [1]}}, {"state": "absent"}, {"cpu_percent": "absent"},
    ]
    bad = {
        "pid": [7.5, "7.5", "7e0", "x", None, [7], {"a": 1}, -1, "absent", "0x1", 2**32, ""],
        "process_name": [7, 7.5, True, None, ["x"], {"a": "x"}, "", " ", "a\u0007b", "absent", "x" * 513],
        "username": [7, False, ["u"], "u" * 513], "state": [None, 1, "s" * 33],
        "cpu_percent": ["", "12d", "1f", "NaN", "Infinity", -1, [1], 1001, "0x10"], "timestamp": [0, None, {"a": 1}, "absent", 5e9],
        "memory_rss": [2**63, 1.5, "1e3", None], "memory_percent": [100.5, "much", None],
    }
    assert _verdicts(spark, good) == [(None, [])] * len(good)
    cases = [{name: value} for name, values in bad.items() for value in values]
    assert list(zip(cases, _verdicts(spark, cases))) == [(c, ("invalid", list(c))) for c in cases]
    hosts = [{"host": h} for h in (5, None, True, ["h"], {"a": 1}, "", "  ", "a\u0001")]
    assert _verdicts(spark, hosts) == [("invalid", [])] * len(hosts)


def test_odd_json_texts(spark):
    body = json.dumps(entry())
    lines = {
        '{"host": "h", "samples": [%s, 5]}' % body: "invalid", '{"host": "h", "samples": [null]}': "invalid", '{"host": "h", "samples": {"a": 1}}': "invalid",
        '{"host": "h", "samples": [%s]} trailing' % body: "invalid", '[{"host": "h"}]': "invalid", '"text"': "invalid", "": "invalid", "null": "invalid",
        '{"host": "h", "samples": null, "processes": [%s]}' % body: "invalid", '{"host": null, "hostname": "h", "samples": [%s]}' % body: "invalid",
        '{"host": 1, "host": "h", "samples": [%s]}' % body: None, '{"host": "h", "samples": [%s]}' % body.replace('"pid": 1', '"pid": NaN'): "invalid",
    }
    assert {r.value: r.reason for r in parsed(spark, *lines).collect()} == lines


def test_arrival_numbers_follow_files_blocks_and_lines(spark, tmp_path):
    import os

    def line(file, n):
        return json.dumps({"host": "h", "samples": [entry(process_name=f"{file}-{n}-{i}", create_time=n + 1) for i in range(3)]})

    names = ["late", "early", "middle"]
    for name in names:
        (tmp_path / name).write_text("\n".join([*(line(name, n) for n in range(40)), "{torn"]) + "\n")
    for age, name in enumerate(["early", "middle", "late"]):
        os.utime(tmp_path / name, (1_700_000_000 + age, 1_700_000_000 + age))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        envelopes = en.read_envelopes(spark, str(tmp_path))
        assert envelopes.select("file", "block").distinct().count() > 3
        rows = en.envelope_samples(envelopes, 100).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.process_name for r in rows] == [f"{f}-{n}-{i}" for f in ("early", "middle", "late") for n in range(40) for i in range(3)]
    numbers = [r.seq for r in rows]
    assert numbers == sorted(set(numbers)) and numbers[0] == 100 and numbers[-1] < en.next_number(envelopes, 100).first().next


def test_arrival_numbers_go_on_over_triggers(spark, tmp_path):
    from hostlens.session import configure
    from hostlens.streaming import pipeline as st

    configure(spark, streaming=True)
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    os_path = tmp_path / "in"
    os_path.mkdir()
    for n in range(3):
        bodies = [] if n == 1 else [entry(process_name=f"{n}-{i}", timestamp=20 + n if i else 20) for i in range(2)]
        (os_path / f"{n}.jsonl").write_text(json.dumps({"host": "h", "samples": bodies}) + "\n")
        st.stream_ingest(spark, source, table, checkpoint).awaitTermination()
    rows = st.read_table(spark, f"{table}/samples").orderBy("seq").collect()
    # The copy in the last file keeps its number to itself.
    assert [(r.process_name, r.seq) for r in rows] == [("0-0", 0), ("2-1", 20_001)]
    order = {r.ingest_batch: r.next for r in spark.read.parquet(f"{table}/order").collect()}
    assert order == {0: 10_000, 1: 20_000, 2: 30_000}
