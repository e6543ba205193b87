"""Outage spools: JSON-lines files of envelopes, bounded to the newest batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.operators.keys import first_per_key
from hostlens.params import Params

#: Column that names the folders of compacted spools.
ID_FOLDER = "spool_id"


def read_spool(spark: SparkSession, path: str, last_n: int = Params.spool_batches) -> DataFrame:
    """The newest ``last_n`` readable envelopes of each spool file; ``newest`` counts from the end.

    Lines keep their order by file block and by position inside the block, so a spool
    may be read in pieces. ``spool`` is a short id: that of its folder for a compacted spool, so
    it stays the same however often a spool is compacted, else one made from the file's path.
    """
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, f"/{ID_FOLDER}=([0-9a-f]{{32}})/[^/]*$", 1)
    lines = spark.read.text(path).select(
        "value",
        F.coalesce(F.nullif(folder, F.lit("")), F.left(F.sha2(file, 256), F.lit(32))).alias("spool"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"),
    )
    keys = F.json_object_keys("value")
    kept = lines.filter(F.array_contains(keys, "host") & F.array_contains(keys, "samples"))
    order = [F.desc("__block"), F.desc("__line")]
    return first_per_key(kept, ["spool"], order, last_n, "newest").select("spool", "newest", "value")


def append_spool(spool: DataFrame, new: DataFrame, last_n: int = Params.spool_batches) -> DataFrame:
    """The spools with new envelopes (``spool, position, value``) behind them, cut to the newest ``last_n``."""
    pending = spool.select("spool", F.lit(0).alias("late"), (-F.col("newest")).alias("position"), "value")
    fresh = new.select("spool", F.lit(1).alias("late"), F.col("position").cast("int").alias("position"), "value")
    order = [F.desc("late"), F.desc("position")]
    return first_per_key(pending.unionByName(fresh), ["spool"], order, last_n, "newest").select("spool", "newest", "value")


def compact_spool(spool: DataFrame, path: str) -> None:
    """Writes the kept envelopes, oldest first, one folder per spool; nothing kept leaves none."""
    (
        spool.repartition("spool")
        .sortWithinPartitions("spool", F.desc("newest"))
        .select(F.col("spool").alias(ID_FOLDER), "value")
        .write.mode("overwrite")
        .partitionBy(ID_FOLDER)
        .text(path)
    )


def replay_order(spool: DataFrame, new: DataFrame) -> DataFrame:
    """Spooled envelopes, oldest first, then the new ones (``value, position``)."""
    pending = spool.select(F.lit(False).alias("is_new"), "spool", (-F.col("newest")).alias("position"), "value")
    fresh = new.select(F.lit(True).alias("is_new"), F.lit("").alias("spool"), "position", "value")
    return pending.unionByName(fresh).orderBy("is_new", "spool", "position")
