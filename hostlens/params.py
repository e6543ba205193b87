"""Limits and windows. Every operator takes what it needs as a plain argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # The default limits of the service this engine stands in for.
    stale_after: float = 90.0
    offline_after: float = 900.0
    window: int = 3_600
    retention_days: int = 30
    max_batch_samples: int = 500
    agent_batch_size: int = 100
    spool_batches: int = 200
    # Ours: width of the receipt-time slices that split long instances between tasks.
    slice_seconds: float = 21_600.0


def clamp_window(value: int | None, default: int, maximum: int = 604_800) -> int:
    """Query window in seconds: the default when absent, else held to 60..maximum."""
    return default if value is None else max(60, min(maximum, int(value)))


def clamp_incident_window(value: int) -> int:
    """Incident window in seconds, held to 10..3600."""
    return max(10, min(3_600, int(value)))


def series_bucket(lookback: int) -> int:
    """Bucket width of the metric and alert series (about 60 points)."""
    return max(10, int(lookback / 60))


def activity_bucket(lookback: int) -> int:
    """Bucket width of the host activity grid (13 points)."""
    return max(60, int(lookback / 12))
