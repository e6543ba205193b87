"""Notifications to deliver, in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.operators.alerts import with_alert_id
from hostlens.operators.keys import numbered
from hostlens.schemas import ALERT_COLUMNS, ALERT_KEY

# Begin of a mail's subject, unless the caller gives another; event name of the messages (a fixed value).
SUBJECT = "Alert: "
EVENT = "alert.triggered"

DELIVERY_ORDER = ["triggered_at", "rule_id", "host", "pid", "create_time"]


def notification_outbox(
    alerts: DataFrame,
    webhook_configured: bool = True,
    email_configured: bool = True,
    minute: float = 60.0,
) -> DataFrame:
    """One message per alert that asks for an action, numbered in delivery order.

    ``delivery`` is ``ready`` or ``not_configured``; the body is JSON.
    """
    rows = with_alert_id(alerts.select(*ALERT_COLUMNS)).filter(F.coalesce("action", F.lit("none")) != "none")
    rows = numbered(rows, [], F.floor(F.col("triggered_at") / F.lit(minute)), DELIVERY_ORDER, "delivery_seq")
    alert = F.struct("alert_id", *ALERT_COLUMNS)
    keep_nulls = {"ignoreNullFields": "false"}
    configured = (
        F.when(F.col("action") == "webhook", F.lit(webhook_configured))
        .when(F.col("action") == "email", F.lit(email_configured))
        .otherwise(F.lit(False))
    )
    event = F.struct(F.lit(EVENT).alias("event"), alert.alias("alert"))
    mail = F.col("action") == "email"
    return rows.select(
        "delivery_seq",
        "alert_id",
        *ALERT_KEY,
        "action",
        F.when(configured, "ready").otherwise("not_configured").alias("delivery"),
        F.when(mail, F.concat(F.lit(SUBJECT), F.coalesce("rule_name", "rule_id"))).alias("subject"),
        F.when(mail, F.to_json(alert, keep_nulls)).otherwise(F.to_json(event, keep_nulls)).alias("body"),
    )


def write_outbox(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in delivery order: file names sort as the messages do."""
    messages.orderBy("delivery_seq").write.mode(mode).json(path)
