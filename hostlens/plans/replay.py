"""Replays the feed through the streaming pipeline, slice by slice."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostlens.operators.ingest import ARRIVAL
from hostlens.operators.keys import numbered
from hostlens.params import Params
from hostlens.session import configure, move_folder, work_folder
from hostlens.sources import feed
from hostlens.sources.envelopes import to_envelopes
from hostlens.streaming.pipeline import read_table, stream_ingest, stream_table

SLICES = 3


class Replay(NamedTuple):
    spark: SparkSession
    root: str

    @property
    def table(self) -> str:
        return f"{self.root}/table"

    @property
    def samples(self) -> DataFrame:
        return read_table(self.spark, f"{self.table}/samples")

    @property
    def changes(self) -> str:
        return f"{self.root}/changes"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint-changes"


def envelopes(raw: DataFrame, size: int = Params.agent_batch_size, apart: tuple[str, ...] = ()) -> DataFrame:
    """The feed as envelope lines of at most ``size`` samples in arrival order; rows that differ in ``apart`` share none."""
    rows = numbered(raw, [*apart, "host"], F.floor(F.col("received_at") / 30), ARRIVAL, "__row")
    return to_envelopes(rows.withColumn("chunk", F.floor((F.col("__row") - 1) / size)), [*apart, "chunk"])


def replay(
    spark: SparkSession,
    folder: str,
    follow: Callable[[DataFrame, Replay], StreamingQuery] | None = None,
    slices: int = SLICES,
    stamped: bool = True,
) -> Replay:
    """Feeds receipt-time slices one after another into the ingest stream; after each, runs ``follow``
    on the stream of accepted samples up to the end of what is there.

    Without ``stamped`` receipt times and numbers of the feed do not count: a host's lines stand in one file in order.
    """
    configure(spark, streaming=True)
    run = Replay(spark, work_folder(spark, "replay"))
    raw = feed.feed(spark, folder)
    width = (feed.SPAN + 125) / slices
    # The first and the last slice are open: rows outside the span are replayed too.
    number = F.greatest(F.lit(0), F.least(F.lit(slices - 1), F.floor((F.col("received_at") - feed.BASE) / F.lit(width))))
    # The lines of all slices are made in one pass; a slice's files are handed over whole.
    lines = envelopes(raw.withColumn("slice", number), apart=("slice",))
    if not stamped:
        lines = lines.repartition("host").sortWithinPartitions("slice", "host", "chunk")
    lines.select("slice", "value").write.partitionBy("slice").text(f"{run.root}/made")
    for index in range(slices):
        part = f"slice={index}"
        if not move_folder(spark, f"{run.root}/made/{part}", f"{run.root}/incoming/{part}"):
            lines.select("value").limit(0).write.text(f"{run.root}/incoming/{part}")
        stream_ingest(spark, f"{run.root}/incoming", run.table, f"{run.root}/checkpoint-ingest", max_files=10_000, replay=stamped).awaitTermination()
        if follow is not None:
            follow(stream_table(spark, f"{run.table}/samples"), run).awaitTermination()
    return run
