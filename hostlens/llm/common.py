"""What several operators of this folder share: tables, scratch tables, folds, batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.session import work_folder

#: White space of the text contracts: space and the five ASCII controls from tab on.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read again: it cuts the lineage, survives lost executors
    and is computed once however often it is read."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo parts. A null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def pieces_of(total: int, target: int) -> int:
    """How many parts of about target units hold total units."""
    return max(1, math.ceil(total / target))


def chosen(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named expressions: further columns of the input, whatever their names, cannot clash."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


#: Rows that go to a Python worker at once where several stages share the workers.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Smaller batches for the workers of the session's next jobs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """Hands freed memory back to the system: Spark uses a worker again, with what the task before it held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


def released(batches: Iterator, *caches: dict) -> Iterator:
    """The batches; after the task's last one the caches are emptied and their memory handed back."""
    yield from batches
    for cache in caches:
        cache.clear()
    release()


def cuts(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about most_bytes together (one long text is one slice)."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, size in enumerate(sizes):
        if i > start and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)
