"""Keys, ordered slices and numbering shared by the operators.

Instance keys travel as one string. A double in a partitioning key is wrapped by
Spark, which keeps otherwise equal partitionings from being recognised as such.

One instance may hold a large part of all rows, so nothing ordered runs over a
whole instance in one task. Ordered work is done inside slices of an instance;
what must pass from slice to slice is computed from one small row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def instance_key() -> Column:
    return F.concat_ws(":", F.col("host"), F.col("pid").cast("string"), F.col("create_time").cast("string"))


def with_instance(df: DataFrame) -> DataFrame:
    return df.withColumn("inst", instance_key())


def instance_parts(inst: str = "inst") -> dict[str, Column]:
    """host, pid and create_time read back from the string key (exact)."""
    key = F.col(inst)
    tail = F.substring_index(key, ":", -2)
    return {
        "host": F.expr(f"substr({inst}, 1, length({inst}) - length(substring_index({inst}, ':', -2)) - 1)"),
        "pid": F.substring_index(tail, ":", 1).cast("long"),
        "create_time": F.substring_index(tail, ":", -1).cast("double"),
    }


def _within(df: DataFrame, clock: str, day: str, start: float | None, end: float | None) -> DataFrame:
    for bound, keep in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is not None:
            df = df.filter(keep(F.col(clock), F.lit(float(bound))))
            if day in df.columns:
                df = df.filter(keep(F.col(day), F.to_date(F.timestamp_seconds(F.floor(F.lit(float(bound)))))))
    return df


def in_time(df: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows with ``start <= timestamp <= end``; a table partitioned by ``date`` reads only those days."""
    return _within(df, "timestamp", "date", start, end)


def in_receipt(df: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows with ``start <= received_at <= end``; a table partitioned by ``received_date`` reads only those days."""
    return _within(df, "received_at", "received_date", start, end)


def first_per_key(df: DataFrame, keys: list, order: list, k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. Spark applies the limit before and after the shuffle."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def oldest_per_key(df: DataFrame, key: str, order: list, k: int, width: float, rank: str) -> DataFrame:
    """The ``k`` oldest rows per key, numbered, for a ``k`` that is large.

    Counting rows per time slice first tells which slices can hold one of them, so at
    most ``k`` rows and one slice of a key reach the final ranking.
    """
    rows = df.withColumn("__slice", F.floor(F.col("timestamp") / F.lit(float(width))))
    sizes = rows.groupBy(key, "__slice").agg(F.count("*").alias("__size"))
    earlier = W.partitionBy(key).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    needed = (
        sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
        .filter(F.col("__before") < k)
        .select(key, "__slice")
    )
    return first_per_key(rows.join(needed, [key, "__slice"], "left_semi").drop("__slice"), [key], order, k, rank)


def preceding_max(df: DataFrame, keys: list[str], slice_col: str, order: list, measures: dict[str, Column]) -> DataFrame:
    """Adds, for each measure, its maximum over all earlier rows of the same key.

    Rows are ordered by ``(slice_col, *order)``. Each slice is scanned on its own;
    the maximum of the slices before it arrives by a join with one row per slice.
    """
    scope = [*keys, slice_col]
    per_slice = df.groupBy(*scope).agg(*[F.max(m).alias(name) for name, m in measures.items()])
    earlier_slices = W.partitionBy(*keys).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.select(
        *scope, *[F.max(name).over(earlier_slices).alias(f"__carried_{name}") for name in measures]
    )
    earlier_rows = W.partitionBy(*scope).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.select("*", *[F.max(m).over(earlier_rows).alias(f"__local_{name}") for name, m in measures.items()])
    # The window left the rows partitioned and sorted by the join keys.
    joined = local.join(carried.hint("merge"), scope)
    return joined.select(
        *df.columns, *[F.greatest(f"__local_{name}", f"__carried_{name}").alias(name) for name in measures]
    )


def numbered(df: DataFrame, keys: list[str], part: Column, order: list, name: str) -> DataFrame:
    """Exact row number per key (over everything when ``keys`` is empty), without one task per key.

    ``part`` must be non-decreasing along ``order``. Rows are numbered inside each
    part and shifted by the row count of the parts before it.
    """
    rows = df.withColumn("__part", part)
    scope = [*keys, "__part"]
    sizes = rows.groupBy(*scope).agg(F.count("*").alias("__size"))
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*scope, F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__shift"))
    local = rows.withColumn("__local", F.row_number().over(W.partitionBy(*scope).orderBy(*order)))
    return (
        local.join(shifts.hint("merge"), scope)
        .withColumn(name, F.col("__shift") + F.col("__local"))
        .select(*df.columns, name)
    )
