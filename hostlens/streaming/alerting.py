"""Keyed alert state for Structured Streaming."""

from __future__ import annotations

import json
import math
import sys
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Workers get this module with the processor; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows cross to the workers as JSON texts, samples one by one and changes by the thousand: a field by itself costs a conversion there.
STATE_OUTPUT = "inst string, changes string"
CHANGES = (
    "array<struct<rule_id:string,triggered_at:double,transition:string,seen_at:double,value:double,"
    "process_name:string,username:string>>"
)
CHANGES_A_ROW = 1_000
SAMPLE_FIELDS = ["received_at", "seq", "timestamp", "process_name", "username"]
ENTRY = "struct<rule_id:string,true_since:double,run:bigint,last_at:double,quiet_until:double,triggered_at:double>"
ENTRY_FIELDS = ["true_since", "run", "last_at", "quiet_until", "triggered_at"]
STATE_SCHEMA = f"entries array<{ENTRY}>, received double"

_TESTS = {
    "gt": lambda v, t: v > t,
    "gte": lambda v, t: v >= t,
    "lt": lambda v, t: v < t,
    "lte": lambda v, t: v <= t,
    "eq": lambda v, t: v == t,
}
RULE_FIELDS = ["rule_id", "enabled", "metric", "operator", "threshold", "duration", "consecutive_samples", "cooldown"]
MAX_BYTES = 900_000
_NEW = (None, 0, None, 0.0, None)


class _Sample(NamedTuple):
    received_at: float
    seq: int
    timestamp: float
    process_name: str | None
    username: str | None
    values: dict


def _sample(text: str) -> _Sample:
    fields = json.loads(text)
    return _Sample(*[fields.get(n) for n in SAMPLE_FIELDS], fields)


class AlertProcessor(StatefulProcessor):
    """Per instance one value: the entries (rule, true_since, run, last_at, quiet_until, triggered_at) and the newest receipt time.

    ``triggered_at`` is set while an alert is active. State of rules that no longer exist is removed when the instance
    next reports; disabled rules keep theirs untouched. The state is read and written once per trigger.

    With ``expire_after``, an instance that was not heard of for more than that many seconds of receipt time starts anew: by
    its rows alone, so results do not depend on where triggers lie. A timer frees the state when the watermark gets there.
    """

    def __init__(self, rules: list[dict], expire_after: float | None = None):
        # Spark ships processors of up to a megabyte: the rules are packed to what is needed.
        packed = zlib.compress(json.dumps([[rule[n] for n in RULE_FIELDS] for rule in rules]).encode())
        if len(packed) > MAX_BYTES:
            raise ValueError(f"{len(rules)} rules take {len(packed)} bytes: run one query per part of the rules")
        self.packed = packed
        self.expire_after = expire_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        rules = [dict(zip(RULE_FIELDS, values)) for values in json.loads(zlib.decompress(self.packed))]
        self.known_ids = {rule["rule_id"] for rule in rules}
        self.rules = [rule for rule in rules if rule["enabled"]]
        self.handle = handle
        self.state = handle.getValueState("alerts", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Rows of one trigger come unordered.
        ordered = sorted((_sample(row[1]) for row in rows), key=lambda s: (s.received_at, s.seq))
        held = self.state.get() if self.state.exists() else None
        entries = {e[0]: tuple(e[1:]) for e in held[0] or [] if e[0] in self.known_ids} if held else {}
        received = held[1] if held else None
        changes: list = []
        for part in self._stays(ordered, received):
            if part is not ordered and part[0] is None:
                entries, part = {}, part[1:]
            for rule in self.rules:
                for change in self._follow(rule, part, entries):
                    changes.append(change)
                    if len(changes) == CHANGES_A_ROW:
                        yield Row(inst=key[0], changes=json.dumps(changes))
                        changes = []
        if changes:
            yield Row(inst=key[0], changes=json.dumps(changes))
        newest = max([ordered[-1].received_at] + ([received] if received is not None else []))
        self._keep(entries, newest)

    def _stays(self, rows: list[_Sample], received: float | None) -> Iterator[list]:
        """The rows cut where the instance was away too long; such parts begin with None."""
        if self.expire_after is None:
            yield rows
            return
        part: list = []
        for row in rows:
            if received is not None and row.received_at - received > self.expire_after:
                if part:
                    yield part
                part = [None]
            part.append(row)
            received = row.received_at if received is None else max(received, row.received_at)
        yield part

    def _keep(self, entries: dict, received: float) -> None:
        self.state.update(([(rule_id, *entry) for rule_id, entry in entries.items()], received))
        if self.expire_after is not None:
            self._watch(received)

    def _watch(self, received: float) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(math.floor((received + self.expire_after) * 1000) + 1)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        # Structs inside the rows of an initial state arrive as dictionaries.
        known = {e["rule_id"]: tuple(e[n] for n in ENTRY_FIELDS) for e in initialState.entries or [] if e["rule_id"] in self.known_ids}
        self._keep(known, initialState.received)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])

    def _follow(self, rule: dict, rows: list[_Sample], entries: dict) -> Iterator[dict]:
        since, run, last_at, quiet_until, fired_at = entries.get(rule["rule_id"], _NEW)
        touched, metric, test = False, rule["metric"], _TESTS[rule["operator"]]
        for row in rows:
            value, at = row.values.get(metric), row.timestamp
            if value is None or (last_at is not None and at <= last_at):
                continue
            touched, last_at, kind, alert = True, at, None, fired_at
            # Numbers that are not finite are texts in JSON.
            value = float(value) if isinstance(value, str) else value
            if test(value, rule["threshold"]):
                since, run = (at if since is None else since), run + 1
                if fired_at is not None:
                    kind = "updated"
                elif at - since >= rule["duration"] and run >= rule["consecutive_samples"] and at >= quiet_until:
                    kind, alert, fired_at = "triggered", at, at
            else:
                since, run = None, 0
                if fired_at is not None:
                    kind, quiet_until, fired_at = "resolved", at + rule["cooldown"], None
            if kind:
                yield {
                    "rule_id": rule["rule_id"], "triggered_at": alert, "transition": kind, "seen_at": at, "value": float(value),
                    "process_name": row.process_name, "username": row.username,
                }
        if touched:
            entries[rule["rule_id"]] = (since, run, last_at, quiet_until, fired_at)

    def close(self) -> None:
        pass
