"""Small hand-made tables and a sequential walk of the alert rules."""

from __future__ import annotations

from hostlens.schemas import RULE, SAMPLE

CREATED = 1_700_000_000.0


def sample(seq: int = 0, **values) -> tuple:
    row = {
        "seq": seq,
        "host": "h1",
        "pid": 101,
        "process_name": "worker.exe",
        "username": "operator",
        "create_time": CREATED,
        "timestamp": CREATED + 10,
        "cpu_percent": 12.5,
        "memory_percent": 4.0,
        "memory_rss": 50_000_000,
        "read_bytes": 1000,
        "write_bytes": 2000,
        "state": "running",
        **values,
    }
    row.setdefault("received_at", row["timestamp"])
    return tuple(row[name] for name in SAMPLE.fieldNames())


def samples(spark, rows):
    return spark.createDataFrame(rows, SAMPLE)


def series(spark, values, start: float = CREATED, step: float = 1.0, **common):
    """CPU readings of one instance, one per step."""
    return samples(
        spark,
        [sample(i, cpu_percent=v, timestamp=start + (i + 1) * step, **common) for i, v in enumerate(values)],
    )


def rule(**values) -> dict:
    return {
        "rule_id": "cpu-hot",
        "name": "High CPU",
        "metric": "cpu_percent",
        "operator": "gt",
        "threshold": 80.0,
        "duration": 0.0,
        "consecutive_samples": 2,
        "action": "none",
        "cooldown": 60.0,
        "severity": "critical",
        "enabled": True,
        **values,
    }


def rules(spark, *items: dict):
    return spark.createDataFrame([tuple(i[n] for n in RULE.fieldNames()) for i in items], RULE)


TESTS = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
}


def sequential(rows: list[dict], rule_items: list[dict]):
    """Walks the samples one at a time in arrival order: (alerts, states, transitions)."""
    states, alerts, log = {}, [], []
    for row in sorted(rows, key=lambda r: (r["received_at"], r["seq"])):
        for item in rule_items:
            value, at = row[item["metric"]], row["timestamp"]
            if not item["enabled"] or value is None:
                continue
            key = (item["rule_id"], row["host"], row["pid"], row["create_time"])
            state = states.setdefault(key, {"since": None, "run": 0, "last": None, "quiet": 0.0, "alert": None})
            if state["last"] is not None and at <= state["last"]:
                continue
            state["last"] = at
            alert = state["alert"]
            if TESTS[item["operator"]](value, item["threshold"]):
                state["since"] = at if state["since"] is None else state["since"]
                state["run"] += 1
                seen = {"value": float(value), "seen": at, "name": row["process_name"], "user": row["username"]}
                if alert is not None:
                    alert.update(seen)
                    log.append((*key, alert["fired"], "updated", at))
                elif (
                    at - state["since"] >= item["duration"]
                    and state["run"] >= item["consecutive_samples"]
                    and at >= state["quiet"]
                ):
                    state["alert"] = {"key": key, "fired": at, "resolved": None, **seen}
                    alerts.append(state["alert"])
                    log.append((*key, at, "triggered", at))
            else:
                if alert is not None:
                    alert.update(value=float(value), seen=at, resolved=at)
                    log.append((*key, alert["fired"], "resolved", at))
                    state.update(quiet=at + item["cooldown"], alert=None)
                state.update(since=None, run=0)
    return alerts, states, log


def alert_tuples(alerts: list[dict]) -> set:
    return {(*a["key"], a["fired"], a["resolved"], a["seen"], a["value"], a["name"], a["user"]) for a in alerts}


def frame_tuples(frame) -> set:
    return {
        (
            r.rule_id, r.host, r.pid, r.create_time, r.triggered_at, r.resolved_at, r.last_seen, r.current_value,
            r.process_name, r.username,
        )
        for r in frame.collect()
    }
