"""The table under upkeep: merged days, retention, versions, followers."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import CREATED, sample, samples
from hostlens.operators import hosts, kpis, snapshot
from hostlens.operators.ingest import append_samples
from hostlens.session import configure
from hostlens.sources import stored
from hostlens.streaming import pipeline as st
from test_tables import plan_of

DAY = 86_400.0


def _append(spark, root, batch, *rows):
    new = samples(spark, [sample(i, timestamp=CREATED + at * DAY, **more) for i, at, more in rows]).withColumn("batch_id", F.lit("b"))
    append_samples(new, f"{root}/samples", batch, stored.read_current(spark, root, batch) if batch else None)


def _seqs(spark, root):
    return sorted(r.seq for r in stored.read_current(spark, root).collect())


def _files(root, part):
    return {str(p) for p in Path(root, part).rglob("*.parquet")}


def test_upkeep_merges_days_and_removes_what_has_expired(spark, tmp_path):
    root = str(tmp_path)
    # Batches meet on day 5; days 0 and 1 expire, 20 stays; the cutoff parts 2 from 3 within a day.
    _append(spark, root, 0, (0, 0.1, {}), (1, 1.1, {}), (2, 2.2, {}), (3, 2.9, {}), (4, 5.1, {}))
    _append(spark, root, 1, (5, 5.2, {}), (6, 20.1, {}), (7, 5.1, {}))  # 7 is a copy of 4
    first = stored.upkeep(spark, root, CREATED + 20.5 * DAY)
    assert first.deleted == 0 and first.version.number == 1 and first.version.covered == 1
    assert _seqs(spark, root) == [0, 1, 2, 3, 4, 5, 6]
    fives = [d for d in first.version.days if d.rows == 2 and d.first > CREATED + 5 * DAY]
    assert len(fives) == 1, "rows of two batches in one folder"
    cutoff = CREATED + 2.5 * DAY
    before = _files(root, "days")
    second = stored.upkeep(spark, root, cutoff + 30 * DAY)
    assert second.deleted == 3 and _seqs(spark, root) == [3, 4, 5, 6]
    # Only the day of the cutoff was written again; whole days left without a new file.
    assert len(_files(root, "days") - before) == 1
    assert {d.folder for d in second.version.days} & {d.folder for d in first.version.days}
    third = stored.upkeep(spark, root, cutoff + 30 * DAY)
    assert third == stored.Upkeep(0, second.version)
    # Copies of stored rows stay out, also where only merged days hold them.
    _append(spark, root, 2, (8, 5.1, {}), (9, 5.3, {}))
    assert _seqs(spark, root) == [3, 4, 5, 6, 9]


def test_days_merge_when_they_have_too_many_folders(spark, tmp_path):
    root = str(tmp_path)
    for batch in range(5):
        _append(spark, root, batch, (batch, 1.0 + batch / 100, {}), (10 + batch, 3.0 + batch, {}))
        version = stored.upkeep(spark, root, CREATED + 9 * DAY, folders=2).version
        per_day = {d.date: sum(x.date == d.date for x in version.days) for d in version.days}
        assert max(per_day.values()) <= 2
    assert _seqs(spark, root) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    assert sum(d.rows for d in version.days) == 10


def test_what_is_not_named_any_more_is_deleted(spark, tmp_path):
    root = str(tmp_path)
    _append(spark, root, 0, (0, 0.0, {}), (1, 5.0, {}))
    stored.upkeep(spark, root, CREATED + 5 * DAY)
    _append(spark, root, 1, (2, 5.5, {}))
    stored.upkeep(spark, root, CREATED + 5 * DAY, folders=1)
    stored.upkeep(spark, root, CREATED + 33 * DAY)
    assert stored.drop_unused(spark, root, versions=3) == []
    reader = stored.read_current(spark, root)
    gone = stored.drop_unused(spark, root, versions=1, log_until=0)
    assert "manifest/1.json" in gone and "samples/ingest_batch=0" in gone and "samples/ingest_batch=1" not in gone
    assert sorted(r.seq for r in reader.collect()) == _seqs(spark, root) == [1, 2]
    assert len(_files(root, "days")) == len(stored.current_version(spark, root).days)


def test_of_two_runs_one_wins(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    _append(spark, root, 0, (0, 0.0, {}))
    real = stored._write_days

    def slow(*args):
        monkeypatch.setattr(stored, "_write_days", real)
        stored.upkeep(spark, root, CREATED + DAY)  # the other run commits first
        return real(*args)

    monkeypatch.setattr(stored, "_write_days", slow)
    with pytest.raises(stored.LostRace):
        stored.upkeep(spark, root, CREATED + DAY)
    assert stored.current_version(spark, root).number == 1 and _seqs(spark, root) == [0]
    assert not [p for p in Path(root, "manifest").iterdir() if "draft" in p.name and not p.name.endswith(".crc")]


def test_unfinished_batches_wait(spark, tmp_path):
    root = str(tmp_path)
    _append(spark, root, 0, (0, 0.0, {}))
    _append(spark, root, 1, (1, 0.1, {}))
    Path(root, "samples/ingest_batch=1/_SUCCESS").unlink()
    assert stored.upkeep(spark, root, CREATED + DAY).version.covered == 0
    assert stored.upkeep(spark, root, CREATED + DAY).version.number == 1
    empty = str(tmp_path / "empty")
    assert stored.upkeep(spark, empty, CREATED).version.number == 0 and stored.drop_unused(spark, empty) == []


def test_a_follower_sees_each_row_once(spark, tmp_path):
    configure(spark, streaming=True)
    root, seen = str(tmp_path / "t"), str(tmp_path / "seen")
    for batch in range(3):
        _append(spark, root, batch, (batch, float(batch), {}), (10 + batch, 8.0, {"pid": batch}))
        stream = st.stream_table(spark, f"{root}/samples").select("seq")
        write = stream.writeStream.format("parquet").option("path", seen).option("checkpointLocation", str(tmp_path / "c"))
        write.trigger(availableNow=True).start().awaitTermination()
        stored.upkeep(spark, root, CREATED + (31 + batch) * DAY, folders=1)
        stored.drop_unused(spark, root, versions=1, log_until=batch - 1)
    assert sorted(r.seq for r in spark.read.parquet(seen).collect()) == [0, 1, 2, 10, 11, 12]
    assert _seqs(spark, root) == [10, 11, 12]  # the cutoff has reached day 3


def test_reads_by_receipt_time_prune_days(spark, tmp_path):
    """Both parts of the table, merged days and log, are filtered by their receipt days."""
    root = str(tmp_path)
    for batch in range(2):
        _append(spark, root, batch, *[(10 * batch + i, float(i + 10 * batch), {"received_at": CREATED + (i + 10 * batch) * DAY + 60}) for i in range(10)])
        if not batch:
            stored.upkeep(spark, root, CREATED + 10 * DAY)
    table, now = stored.read_current(spark, root), CREATED + 20 * DAY
    registry = hosts.host_registry(samples(spark, [sample(1)]))
    alerts = spark.createDataFrame([], "host string, status string")
    latest = snapshot.latest_samples(table, now, 12 * DAY)
    frames = {
        "latest": latest,
        "activity": hosts.host_activity(registry, table, now, int(2 * DAY)),
        "summary": hosts.host_summary(registry, latest, alerts, now),
        "processes": snapshot.top_processes(latest),
    }
    for name, frame in frames.items():
        plan = plan_of(frame)
        assert plan.count("PartitionFilters: [isnotnull(") >= 2 and "(received_date#" in plan, name
    assert latest.select("seq").first().seq == 19
    kpi = kpis.kpi_summary(table, registry, alerts, now, window=int(2 * DAY))
    assert "received_date" in kpi._jdf.queryExecution().optimizedPlan().toString() and kpi.first().samples_received == 2
    by_day = table.filter(F.col("received_date") >= F.lit("2023-12-03")).count()
    assert 0 < by_day < 5
