import random

import pytest
from pyspark.sql import functions as F

from helpers import CREATED, alert_tuples, frame_tuples, rule, rules, sample, samples, sequential, series
from hostlens.operators import alerts as al
from hostlens.operators import rules as ru
from hostlens.operators.ingest import dedup_samples
from hostlens.schemas import SAMPLE
from hostlens.sources import feed as fd


def evaluate(spark, frame, *items, slice_seconds=3.0):
    return al.evaluate_alerts(frame, rules(spark, *items), slice_seconds).collect()


def test_triggers_on_the_second_match_and_resolves(spark):
    found = evaluate(spark, series(spark, [90.0, 90.0, 20.0]), rule())
    assert [(a.triggered_at, a.resolved_at, a.status) for a in found] == [(CREATED + 2, CREATED + 3, "resolved")]


def test_reused_pid_does_not_inherit_the_streak(spark):
    rows = [
        sample(0, cpu_percent=90.0, timestamp=CREATED + 1),
        sample(1, cpu_percent=90.0, timestamp=CREATED + 2, create_time=CREATED + 1.5),
    ]
    assert evaluate(spark, samples(spark, rows), rule()) == []


def test_out_of_order_sample_changes_nothing(spark):
    rows = [
        sample(i, cpu_percent=c, timestamp=CREATED + t, received_at=CREATED + 20 + i)
        for i, (t, c) in enumerate([(10, 90.0), (11, 90.0), (5, 10.0)])
    ]
    found = evaluate(spark, samples(spark, rows), rule())
    assert [a.status for a in found] == ["active"]


def test_many_matches_make_one_alert_and_many_clears_one_resolution(spark):
    found = evaluate(spark, series(spark, [90.0] * 8), rule(consecutive_samples=1))
    assert len(found) == 1 and found[0].last_seen == CREATED + 8
    cleared = al.alert_transitions(
        series(spark, [90.0] + [10.0] * 6), rules(spark, rule(consecutive_samples=1)), 3.0
    ).filter("transition = 'resolved'")
    assert cleared.count() == 1


def test_null_reading_neither_breaks_nor_extends_a_streak(spark):
    found = evaluate(spark, series(spark, [90.0, None, 90.0, 20.0]), rule())
    assert [a.triggered_at for a in found] == [CREATED + 3]


def test_duration_counts_from_the_first_match(spark):
    found = evaluate(spark, series(spark, [90.0] * 8), rule(duration=5.0, consecutive_samples=1))
    assert [a.triggered_at for a in found] == [CREATED + 6]


def test_cooldown_blocks_and_the_streak_goes_on_counting(spark):
    values = [90.0, 10.0] + [90.0] * 10
    found = evaluate(spark, series(spark, values), rule(consecutive_samples=1, cooldown=6.0))
    assert [a.triggered_at - CREATED for a in found] == [1, 8]


def test_disabled_rules_and_no_rules_make_no_alerts(spark):
    frame = series(spark, [90.0] * 4)
    assert evaluate(spark, frame, rule(enabled=False)) == []
    states = al.alert_states(frame, rules(spark, rule(enabled=False)), 3.0)
    assert states.collect() == []


def random_case(seed: int):
    rng = random.Random(seed)
    rows, seq = [], 0
    for pid in range(6):
        at = CREATED
        for _ in range(rng.randint(1, 90)):
            at += rng.choice([0.5, 1.0, 1.0, 2.0, 7.0])
            late = rng.choice([0, 0, 0, 0, 3, 12])
            cpu = None if rng.random() < 0.1 else float(rng.randint(0, 100))
            name, user = f"p{rng.randint(0, 3)}", rng.choice([None, "u1", "u2"])
            rows.append(
                dict(
                    zip(
                        SAMPLE.fieldNames(),
                        sample(
                            seq, pid=pid, timestamp=at, received_at=at + late, cpu_percent=cpu, process_name=name,
                            username=user, memory_percent=float(rng.randint(0, 100)), memory_rss=rng.randint(0, 9),
                        ),
                    )
                )
            )
            seq += 1
    items = [
        rule(rule_id="a", threshold=60.0, consecutive_samples=1, cooldown=0.0),
        rule(rule_id="b", threshold=50.0, consecutive_samples=1, cooldown=8.0),
        rule(rule_id="c", operator="lte", threshold=70.0, duration=4.0, consecutive_samples=3, cooldown=25.0),
        rule(rule_id="d", metric="memory_percent", operator="gte", threshold=20.0, duration=3.0, cooldown=5.0),
        rule(rule_id="e", metric="memory_rss", operator="eq", threshold=4.0, consecutive_samples=1, cooldown=100.0),
        rule(rule_id="f", metric="memory_rss", operator="lt", threshold=99.0, consecutive_samples=5),
    ]
    return rows, items


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("slice_seconds", [5.0, 40.0, 1e6])
def test_equals_the_sequential_walk(spark, seed, slice_seconds):
    rows, items = random_case(seed)
    alerts, states, log = sequential(rows, items)
    random.Random(seed).shuffle(rows)
    frame = samples(spark, [tuple(r.values()) for r in rows])
    book = rules(spark, *items)
    assert frame_tuples(al.evaluate_alerts(frame, book, slice_seconds)) == alert_tuples(alerts)
    if slice_seconds != 40.0:
        return
    ours = {
        (r.rule_id, r.host, r.pid, r.create_time): (
            r.true_since, r.consecutive_samples, r.last_sample_at, r.cooldown_until, r.active_triggered_at
        )
        for r in al.alert_states(frame, book, slice_seconds).collect()
    }
    assert ours == {
        k: (s["since"], s["run"], s["last"], s["quiet"], s["alert"] and s["alert"]["fired"]) for k, s in states.items()
    }
    moves = al.alert_transitions(frame, book, slice_seconds)
    assert {tuple(r)[:7] for r in moves.select(*moves.columns[:7]).collect()} == set(log)
    assert frame_tuples(al.alerts_from_transitions(moves, book)) == alert_tuples(alerts)


def test_rule_sets_too_large_for_the_plan_are_joined(spark, monkeypatch):
    rows, items = random_case(9)
    monkeypatch.setattr(ru, "INLINE_RULES", 0)
    frame = samples(spark, [tuple(r.values()) for r in rows])
    found = al.evaluate_alerts(frame, rules(spark, *items), 20.0)
    assert frame_tuples(found) == alert_tuples(sequential(rows, items)[0])


def test_one_hot_instance(spark):
    """One instance holds a third of the rows and flaps faster than one rule's cooldown."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        pid = 1 if i % 3 == 0 else 2 + i % 60
        cpu = float(rng.choice([95, 5]))
        at = CREATED + i * 0.5
        rows.append(dict(zip(SAMPLE.fieldNames(), sample(i, pid=pid, timestamp=at, received_at=at, cpu_percent=cpu))))
    items = [rule(rule_id="x", consecutive_samples=1, cooldown=30.0), rule(rule_id="y", consecutive_samples=1, cooldown=0.0)]
    frame = samples(spark, [tuple(r.values()) for r in rows])
    assert frame_tuples(al.evaluate_alerts(frame, rules(spark, *items), 60.0)) == alert_tuples(sequential(rows, items)[0])


@pytest.mark.parametrize("sf, per_rule", [
    ("0.001", {"cpu-hot": 18, "mem-long": 42, "rss-low": 47, "cpu-any": 71, "cpu-idle": 32}),
    ("0.01", {"cpu-hot": 177, "mem-long": 417, "rss-low": 436, "cpu-any": 683, "cpu-idle": 310}),
])
def test_known_counts_of_the_trimmed_feed(spark, sf, per_rule):
    raw = fd.raw_samples(fd.read_events(spark, f"/root/testdata/sf{sf}"), squeezed=False)
    raw = raw.filter(F.col("timestamp") - fd.BASE <= fd.SPAN - F.col("pid") % 12 * 100)
    found = al.evaluate_alerts(dedup_samples(raw), fd.rules(spark), fd.SLICE_SECONDS)
    assert {r.rule_id: r["count"] for r in found.groupBy("rule_id").count().collect()} == per_rule


def test_alert_reports(spark):
    frame = series(spark, [90.0, 10.0] * 6)
    book = rules(spark, rule(consecutive_samples=1, cooldown=0.0))
    alerts = al.evaluate_alerts(frame, book, 4.0)
    newest = al.recent_alerts(alerts, 3).orderBy("rank").collect()
    assert [a.triggered_at - CREATED for a in newest] == [11, 9, 7]
    identifier = al.with_alert_id(alerts).orderBy("triggered_at").first().alert_id
    assert al.get_alert(alerts, identifier).first().triggered_at == CREATED + 1
    counts = {(r.dimension, r.word): r.alerts for r in al.alerts_summary(alerts).collect()}
    assert counts == {
        ("severity", "info"): 0, ("severity", "warning"): 0, ("severity", "critical"): 6,
        ("status", "active"): 0, ("status", "resolved"): 6,
    }
