"""Alert rules as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.validate import whole_number
from hostlens.schemas import RULE, RULE_COLUMNS

# Fixed value: the older name of ``rule_id``.
ID_ALIAS = "id"
_TEXTS = ", ".join(f"{name} string" for name in [*RULE_COLUMNS, ID_ALIAS])


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rule rows from JSON texts (column ``value``); ``id`` stands in only where ``rule_id`` is absent."""
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    rows = lines.select(F.from_json("value", _TEXTS).alias("r"), keys.alias("keys"))
    named = F.when(F.array_contains("keys", "rule_id"), F.col("r.rule_id")).otherwise(F.col(f"r.{ID_ALIAS}"))

    def typed(name: str):
        if name == "rule_id":
            return named
        text, kind = F.col(f"r.{name}"), RULE[name].dataType
        return whole_number(text).cast(kind) if name == "consecutive_samples" else text.try_cast(kind)

    return rows.select(*[typed(name).alias(name) for name in RULE_COLUMNS])


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return parse_rules(spark.read.text(path))
