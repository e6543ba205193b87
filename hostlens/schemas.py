"""Table schemas, allow-lists and bounds."""

from __future__ import annotations

from pyspark.sql import types as T

# The allowed words of the data model.
METRICS = ("cpu_percent", "memory_percent", "memory_rss", "read_bytes", "write_bytes")
OPERATORS = ("gt", "gte", "lt", "lte", "eq")
SEVERITIES = ("info", "warning", "critical")
ALERT_STATUSES = ("active", "resolved")
ACTIONS = ("none", "webhook", "email")

# The allowed ranges of the data model.
MAX_PID = 4_294_967_295
MAX_EPOCH = 4_102_444_800
MAX_LONG = 2**63 - 1
MAX_CPU = 1_000
MAX_BATCH = 10_000

INSTANCE = ["host", "pid", "create_time"]
IDENTITY = [*INSTANCE, "timestamp"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SAMPLE = _struct(
    seq=T.LongType(),
    host=T.StringType(),
    pid=T.LongType(),
    process_name=T.StringType(),
    username=T.StringType(),
    create_time=T.DoubleType(),
    timestamp=T.DoubleType(),
    received_at=T.DoubleType(),
    cpu_percent=T.DoubleType(),
    memory_percent=T.DoubleType(),
    memory_rss=T.LongType(),
    read_bytes=T.LongType(),
    write_bytes=T.LongType(),
    state=T.StringType(),
)

RULE = _struct(
    rule_id=T.StringType(),
    name=T.StringType(),
    metric=T.StringType(),
    operator=T.StringType(),
    threshold=T.DoubleType(),
    duration=T.DoubleType(),
    consecutive_samples=T.IntegerType(),
    action=T.StringType(),
    cooldown=T.DoubleType(),
    severity=T.StringType(),
    enabled=T.BooleanType(),
)

ALERT = _struct(
    rule_id=T.StringType(),
    rule_name=T.StringType(),
    host=T.StringType(),
    pid=T.LongType(),
    process_name=T.StringType(),
    username=T.StringType(),
    create_time=T.DoubleType(),
    metric=T.StringType(),
    operator=T.StringType(),
    threshold=T.DoubleType(),
    current_value=T.DoubleType(),
    severity=T.StringType(),
    status=T.StringType(),
    triggered_at=T.DoubleType(),
    last_seen=T.DoubleType(),
    resolved_at=T.DoubleType(),
    action=T.StringType(),
)

SAMPLE_COLUMNS = SAMPLE.fieldNames()
RULE_COLUMNS = RULE.fieldNames()
ALERT_COLUMNS = ALERT.fieldNames()
# An alert is identified by its rule, instance and trigger time.
ALERT_KEY = ["rule_id", *INSTANCE, "triggered_at"]
