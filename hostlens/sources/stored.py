"""A sample table under upkeep: an arrival log, merged days, and a manifest that says what is current.

    <root>/samples/ingest_batch=N/received_date=D/date=E    the log, written by the ingest stream and followed by others
    <root>/days/date=E/commit=C/received_date=D             rows of one event day, merged from batches
    <root>/manifest/V.json                                  version V: the last batch it covers, and its day folders

A version is one small file that appears by a rename which fails if the version exists, so of two runs of the upkeep
one wins and the other changes nothing. Readers take the newest version plus the log behind the batch it covers. What a
version no longer names stays on disk until ``drop_unused``, so readers of the version before are not disturbed, and streams
that follow the log see neither merges nor removals.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.keys import in_time
from hostlens.schemas import IDENTITY, SAMPLE

TABLE_SCHEMA = "batch_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SAMPLE.fields)
LOG_SCHEMA = f"{TABLE_SCHEMA}, ingest_batch bigint, received_date date, date date"
DAY_SCHEMA = f"{TABLE_SCHEMA}, ingest_batch bigint, date date, commit string, received_date date"
COLUMNS = ["batch_id", *SAMPLE.fieldNames(), "ingest_batch", "received_date", "date"]


class LostRace(Exception):
    """Another run of the upkeep committed this version first."""


@dataclass(frozen=True)
class Day:
    """One folder of merged rows: all have the event day ``date``."""

    date: str
    commit: str
    rows: int
    first: float
    last: float

    @property
    def folder(self) -> str:
        return f"date={self.date}/commit={self.commit}"


@dataclass(frozen=True)
class Version:
    number: int = 0
    covered: int = -1
    days: list[Day] = field(default_factory=list)


@dataclass(frozen=True)
class Upkeep:
    deleted: int
    version: Version


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder), _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def _numbers(spark: SparkSession, folder: str, before: str, after: str) -> list[int]:
    names = [n for n in _names(spark, folder) if n.startswith(before) and n.endswith(after)]
    return sorted(int(n[len(before) : len(n) - len(after)]) for n in names if n[len(before) : len(n) - len(after)].isdigit())


def read_version(spark: SparkSession, root: str, number: int) -> Version:
    lines = [json.loads(r.value) for r in spark.read.text(f"{root}/manifest/{number}.json").collect()]
    head = next(line for line in lines if "covered" in line)
    return Version(number, head["covered"], [Day(**line) for line in lines if "commit" in line])


def current_version(spark: SparkSession, root: str) -> Version:
    numbers = _numbers(spark, f"{root}/manifest", "", ".json")
    return read_version(spark, root, numbers[-1]) if numbers else Version()


def _publish(spark: SparkSession, root: str, version: Version) -> None:
    """Writes the version under another name and renames it; an existing version is never replaced."""
    target, draft = f"{root}/manifest/{version.number}.json", f"{root}/manifest/.draft-{uuid.uuid4().hex}"
    lines = [json.dumps({"covered": version.covered}), *[json.dumps(asdict(d)) for d in version.days]]
    files = _files(spark, root)
    files.mkdirs(_path(spark, f"{root}/manifest"))
    out = files.create(_path(spark, draft), False)
    try:
        out.write(bytearray("\n".join(lines).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(_path(spark, draft), _path(spark, target), options)
    except Exception as fault:
        files.delete(_path(spark, draft), False)
        if files.exists(_path(spark, target)):
            raise LostRace(target) from fault
        raise


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All batches that are on disk."""
    return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/samples")


def _read_days(spark: SparkSession, root: str, days: list[Day]) -> DataFrame:
    folders = [f"{root}/days/{d.folder}" for d in days]
    return spark.read.schema(DAY_SCHEMA).option("basePath", f"{root}/days").parquet(*folders)


def read_current(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The current rows; with ``before`` those of earlier batches. Filters on ``date`` and ``received_date`` prune both parts."""
    version = current_version(spark, root)
    log = read_log(spark, root).filter(F.col("ingest_batch") > version.covered)
    if before is not None:
        log = log.filter(F.col("ingest_batch") < before)
    parts = [log.select(*COLUMNS)]
    if version.days:
        parts.append(_read_days(spark, root, version.days).select(*COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def complete_batches(spark: SparkSession, root: str) -> list[int]:
    log = f"{root}/samples"
    return [n for n in _numbers(spark, log, "ingest_batch=", "") if "_SUCCESS" in _names(spark, f"{log}/ingest_batch={n}")]


def upkeep(spark: SparkSession, root: str, now: float, days: float = 30, folders: int = 4) -> Upkeep:
    """Merges new batches into days and removes samples older than ``days`` before ``now``.

    Days that lie wholly before the cutoff leave the manifest unread. Read and written again are only the day that
    holds the cutoff, if it has expired rows, and days that would have more than ``folders`` folders. A run
    that finds nothing to do writes no version.
    """
    cutoff = now - days * 86_400
    old = current_version(spark, root)
    batches = [n for n in complete_batches(spark, root) if n > old.covered]
    covered = max(batches, default=old.covered)
    fresh = read_log(spark, root).filter(F.col("ingest_batch").between(old.covered + 1, covered)).select(*COLUMNS) if batches else None
    alive = [d for d in old.days if d.last >= cutoff]
    fresh_dates, fresh_rows = set(), 0
    if fresh is not None:
        for row in fresh.groupBy("date").agg(F.count("*").alias("n")).collect():
            fresh_dates.add(str(row.date))
            fresh_rows += row.n
    per_date = {d: [x for x in alive if x.date == d] for d in {x.date for x in alive}}
    again = [
        day
        for date, held in per_date.items()
        for day in held
        if day.first < cutoff or len(held) + (date in fresh_dates) > folders
    ]
    if not batches and not again and len(alive) == len(old.days):
        return Upkeep(0, old)
    parts = ([fresh] if fresh is not None else []) + ([_read_days(spark, root, again).select(*COLUMNS)] if again else [])
    written = _write_days(spark, root, in_time(reduce(DataFrame.unionByName, parts), cutoff)) if parts else []
    version = Version(old.number + 1, covered, [d for d in alive if d not in again] + written)
    _publish(spark, root, version)
    rows = lambda held: sum(d.rows for d in held)
    return Upkeep(rows(old.days) + fresh_rows - rows(version.days), version)


def _write_days(spark: SparkSession, root: str, rows: DataFrame) -> list[Day]:
    """One more folder for every day of rows. Until a version names them the folders do not count."""
    commit, target = uuid.uuid4().hex, ["date", "commit", "received_date"]
    (
        rows.withColumn("commit", F.lit(commit))
        .hint("rebalance", *target, *IDENTITY[:3])
        .sortWithinPartitions(*target, *IDENTITY)
        .write.mode("append")
        .partitionBy(*target)
        .parquet(f"{root}/days")
    )
    mine = spark.read.schema(DAY_SCHEMA).parquet(f"{root}/days").filter(F.col("commit") == commit)
    sums = mine.groupBy("date").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return [Day(str(r.date), commit, r.n, r["first"], r["last"]) for r in sums.collect()]


def drop_unused(spark: SparkSession, root: str, versions: int = 2, log_until: int | None = None) -> list[str]:
    """Deletes what the newest ``versions`` versions do not name: older versions and their day folders.

    Batches of the log go only up to ``log_until``, the last batch that every follower has read, and only where
    the newest version covers them. Run it when no upkeep is running; returns the names deleted.
    """
    numbers = _numbers(spark, f"{root}/manifest", "", ".json")
    if not numbers:
        return []
    kept = [read_version(spark, root, n) for n in numbers[-versions:]]
    named = {d.folder for v in kept for d in v.days}
    gone = [f"manifest/{n}.json" for n in numbers[:-versions]]
    for date in _names(spark, f"{root}/days"):
        if date.startswith("date="):
            commits = [f"{date}/{c}" for c in _names(spark, f"{root}/days/{date}") if c.startswith("commit=")]
            gone += [f"days/{c}" for c in commits if c not in named]
    if log_until is not None:
        last = min(log_until, kept[-1].covered, *[v.covered for v in kept])
        gone += [f"samples/ingest_batch={n}" for n in _numbers(spark, f"{root}/samples", "ingest_batch=", "") if n <= last]
    files = _files(spark, root)
    for name in gone:
        files.delete(_path(spark, f"{root}/{name}"), True)
    return gone
