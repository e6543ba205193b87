"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # All clock texts are UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Of a key given twice in a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Alert and incident stages do much work per byte: small partitions are worth a task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Aggregations over rows that a window left sorted need no hash table.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # "First k per key" filters are applied before the shuffle for every k up to this
    # one; the longest list kept per key is the 5000-row instance history.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
}

# Fixed when the session is built; they only shorten planning.
BUILDER_SETTINGS = {
    # One alert query compiles more classes than the default cache holds.
    "spark.sql.codegen.cache.maxEntries": "2000",
    # Recording the call site of every column expression doubles plan building time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session_builder(name: str) -> SparkSession.Builder:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **BUILDER_SETTINGS}.items():
        builder = builder.config(key, value)
    return builder


def configure(spark: SparkSession, streaming: bool = False) -> SparkSession:
    for key, value in {**SETTINGS, **(STREAM_SETTINGS if streaming else {})}.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    A machine-local folder is used only in local mode with the setting absent.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return tempfile.gettempdir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/hostlens-{name}-{uuid.uuid4().hex}"


def move_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder, making the folders above the new name; false if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(source)):
        return False
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"{source} was not renamed to {target}")
    return True
