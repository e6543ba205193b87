from pyspark.sql import functions as F

from helpers import CREATED, sample, samples
from hostlens.operators import search, series
from hostlens.operators.ingest import accept_samples, write_samples
from hostlens.operators.retention import prune_samples


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_reads_prune_days_columns_and_rows(spark, tmp_path):
    path = str(tmp_path / "samples")
    write_samples(samples(spark, [sample(i, timestamp=CREATED + i * 40_000.0) for i in range(10)]), path)
    stored = spark.read.parquet(path)
    page = search.history(stored, between=(CREATED + 100_000, CREATED + 200_000), host="h1")
    assert page.rows.count() == 3
    plan = plan_of(page.total)
    assert "PartitionFilters: [isnotnull(date" in plan and "IsNotNull(host)" in plan
    assert "ReadSchema: struct<host:string,timestamp:double>" in plan
    plan = plan_of(series.metric_series(stored, CREATED + 400_000, 86_400))
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "ReadSchema: struct<timestamp:double,cpu_percent:double,memory_percent:double>" in plan
    kept, deleted = prune_samples(stored, CREATED + 400_000, 2)
    assert kept.count() == 4 and deleted.first().deleted_count == 6
    assert "PartitionFilters: [isnotnull(date" in plan_of(deleted)


def test_acceptance_reads_the_stored_keys_only(spark, tmp_path):
    path = str(tmp_path / "samples")
    write_samples(samples(spark, [sample(1)]), path)
    new = samples(spark, [sample(2), sample(3, pid=5)])
    taken = accept_samples(new, spark.read.parquet(path))
    assert [r.seq for r in taken.collect()] == [3]
    plan = plan_of(taken)
    assert "PartitionFilters: [isnotnull(date" in plan and "array_contains(Subquery" in plan
    assert "ReadSchema: struct<host:string,pid:bigint,create_time:double,timestamp:double>" in plan


def test_first_per_key_is_limited_before_the_shuffle(spark):
    from hostlens.operators.snapshot import latest_samples, top_processes

    frame = samples(spark, [sample(i, pid=i % 3) for i in range(9)])
    latest = latest_samples(frame, CREATED + 100)
    for plan in (plan_of(latest), plan_of(top_processes(latest)), plan_of(accept_samples(frame))):
        assert "row_number(), 1, Partial" in plan
    assert latest.filter(F.col("seq") >= 6).count() == 3


def test_replay_makes_all_slices_in_one_pass(spark, monkeypatch):
    """The feed is laid out in lines once for all slices, and every slice arrives whole."""
    from hostlens.plans import replay as re

    made, folder = [], "/root/testdata/sf0.001"
    plain = re.envelopes
    monkeypatch.setattr(re, "envelopes", lambda *a, **b: made.append(1) or plain(*a, **b))
    run = re.replay(spark, folder)
    assert made == [1]
    sent = spark.read.text(f"{run.root}/incoming").groupBy("slice").count().count()
    assert sent == re.SLICES and run.samples.count() == re.feed.samples(spark, folder).count()
