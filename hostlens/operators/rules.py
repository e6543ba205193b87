"""Alert rules: validation, the change log and lookups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.checks import errors_of, number_in, stripped, text_in
from hostlens.operators.keys import preceding_max
from hostlens.schemas import ACTIONS, MAX_LONG, METRICS, OPERATORS, RULE, RULE_COLUMNS, SEVERITIES

# Rule sets up to this size are read to the driver and carried inside the plan.
INLINE_RULES = 1_000
# Width, in change numbers, of the pieces a long rule history is scanned in.
LOG_SLICE = 100_000

RULE_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"


def validate_rules(df: DataFrame) -> DataFrame:
    """Fills defaults, strips texts and adds ``valid`` and ``errors`` (names of bad fields)."""
    # Rule defaults and bounds.
    rows = df.withColumns(
        {
            "rule_id": stripped(F.col("rule_id")),
            "name": stripped(F.col("name")),
            "duration": F.coalesce("duration", F.lit(0.0)),
            "consecutive_samples": F.coalesce("consecutive_samples", F.lit(1)),
            "action": F.coalesce("action", F.lit("none")),
            "cooldown": F.coalesce("cooldown", F.lit(300.0)),
            "severity": F.coalesce("severity", F.lit("warning")),
            "enabled": F.coalesce("enabled", F.lit(True)),
        }
    )
    good = {
        "rule_id": text_in(F.col("rule_id"), 1, 80) & F.col("rule_id").rlike(RULE_ID_PATTERN),
        "name": text_in(F.col("name"), 1, 120),
        "metric": F.col("metric").isin(*METRICS),
        "operator": F.col("operator").isin(*OPERATORS),
        "threshold": number_in(F.col("threshold"), 0, MAX_LONG),
        "duration": number_in(F.col("duration"), 0, 86_400),
        "consecutive_samples": number_in(F.col("consecutive_samples"), 1, 10_000),
        "action": F.col("action").isin(*ACTIONS),
        "cooldown": number_in(F.col("cooldown"), 0, 604_800),
        "severity": F.col("severity").isin(*SEVERITIES),
    }
    return rows.withColumn("errors", errors_of(good)).withColumn("valid", F.size("errors") == 0)


class RuleBook(NamedTuple):
    rules: DataFrame
    rejects: DataFrame


def _life(op: str = "op") -> Column:
    """The last create or delete, as an ordered (change, is-create) pair."""
    return F.when(F.col(op).isin("create", "delete"), F.struct(F.col("change_seq"), (F.col(op) == "create").alias("live")))


def current_rules(log: DataFrame) -> RuleBook:
    """Replays a change log (``change_seq, changed_at, op`` and the rule columns).

    A create of a live id and an update or delete of an unknown id are rejected. An
    update replaces the rule but keeps ``created_at``.
    """
    rows = log.withColumn("__slice", F.floor(F.col("change_seq") / LOG_SLICE))
    rows = preceding_max(rows, ["rule_id"], "__slice", ["change_seq"], {"__life": _life()})
    was_live = F.coalesce(F.col("__life.live"), F.lit(False))
    creates = F.col("op") == "create"
    rejects = rows.filter(creates == was_live).select(
        "change_seq", "rule_id", "op", F.when(creates, "already_exists").otherwise("not_found").alias("reason")
    )
    accepted = rows.filter(creates != was_live).select(*log.columns)
    content = F.struct("change_seq", "changed_at", "op", *[c for c in RULE_COLUMNS if c != "rule_id"])
    birth = F.when(creates, F.struct("change_seq", "changed_at"))
    newest = accepted.groupBy("rule_id").agg(F.max(content).alias("last"), F.max(birth).alias("birth"))
    rules = newest.filter(F.col("last.op") != "delete").select(
        "rule_id",
        *[F.col(f"last.{c}").alias(c) for c in RULE_COLUMNS if c != "rule_id"],
        F.col("birth.changed_at").alias("created_at"),
        F.col("last.changed_at").alias("updated_at"),
    )
    return RuleBook(rules, rejects)


def surviving_states(states: DataFrame, rules: DataFrame) -> DataFrame:
    """Alert states of rules that still exist; alerts themselves are kept on deletion."""
    return states.join(rules.select("rule_id"), "rule_id", "left_semi")


def list_rules(rules: DataFrame, enabled: bool | None = None) -> DataFrame:
    """Enabled rules first, then by name ignoring case."""
    rows = rules if enabled is None else rules.filter(F.col("enabled") == enabled)
    return rows.orderBy(F.desc("enabled"), F.lower("name"), "rule_id")


def get_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.filter(F.col("rule_id") == rule_id)


def enabled_rules(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RULE.fields])


def inline_rules(rules: DataFrame) -> list[Row] | None:
    """The enabled rules, or None when there are more than ``INLINE_RULES`` of them."""
    rows = enabled_rules(rules).limit(INLINE_RULES + 1).collect()
    return rows if len(rows) <= INLINE_RULES else None


def rule_array(rows: list[Row], fields: list[str]) -> Column:
    kinds = {f.name: f.dataType for f in RULE.fields}
    return F.array(*[F.struct(*[F.lit(r[n]).cast(kinds[n]).alias(n) for n in fields]) for r in rows])


def rules_frame(spark: SparkSession, rows: list[Row]) -> DataFrame:
    """The rows as a frame whose (small) size the planner knows."""
    return spark.range(1).select(F.inline(rule_array(rows, RULE_COLUMNS)))
