"""Ingest envelopes: JSON lines ``{"host": ..., "samples": [...]}``, one per batch."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.functions.checks import stripped
from hostlens.operators.ingest import batch_verdict
from hostlens.operators.validate import SAMPLE_FIELDS, field_errors, valid_host, whole_number
from hostlens.schemas import MAX_BATCH

# Older field names that are still read.
SAMPLE_ALIASES = {"process_name": "name", "username": "user"}
HOST_ALIAS = "hostname"
BODY_NAMES = ["samples", "processes", "metrics"]
# Fields of our own for replays: receipt time and arrival number of a sample. They count only where the reader asks
# for a replay; an agent's payload cannot set the server's clock or order.
REPLAY_FIELDS = {"received_at": "double", "seq": "bigint"}

# Where a line stands: its file by age and name, and the block of the file; lines of a block are read in order.
_FROM_FILE = {"modified": "timestamp", "file": "string", "block": "bigint"}
PLACE = [*_FROM_FILE, "part"]

# How whole numbers and numbers may be written as texts.
_WHOLE, _NUMBER = r"^[+-]?[0-9]+(\.0*)?$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_WHOLE_FIELDS = ["pid", "memory_rss", "read_bytes", "write_bytes"]
_NUMBER_FIELDS = ["create_time", "timestamp", "cpu_percent", "memory_percent"]
_NULLABLE = ["username", "cpu_percent"]


def _member(value: Column | str, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _first_given(value: Column | str, names: list[str]) -> Column:
    """The first of the names that is present, be it null: an alias counts only if the name itself is absent."""
    return F.coalesce(*[_member(value, name) for name in names])


def _read(value: Column) -> Column:
    """A JSON value as its text and its type."""
    return F.struct(F.try_variant_get(value, "$", "string").alias("text"), F.schema_of_variant(value).alias("kind"))


def _members(item: Column, replay: bool) -> Column:
    given = [n for n in SAMPLE_FIELDS if n not in SAMPLE_ALIASES]
    renamed = [_first_given(item, [n, old]).alias(n) for n, old in SAMPLE_ALIASES.items()]
    stamps = [(_member(item, n, kind) if replay else F.lit(None).cast(kind)).alias(n) for n, kind in REPLAY_FIELDS.items()]
    return F.struct(*[_member(item, n).alias(n) for n in given], *renamed, *stamps)


def _texts(members: Column) -> Column:
    return F.struct(*[_read(members[n]).alias(n) for n in SAMPLE_FIELDS], *[members[n].alias(n) for n in REPLAY_FIELDS])


class _Field:
    """One JSON value that was read: absent and null are different things."""

    def __init__(self, read: Column):
        self.kind, self.text = read["kind"], read["text"]
        self.absent = self.kind.isNull()
        self.null = self.absent | (self.kind == "VOID")

    def string(self) -> Column:
        return F.when(self.kind == "STRING", self.text)

    def _from_text(self, pattern: str) -> Column:
        text = stripped(self.text)
        number = (self.kind == "BIGINT") | (self.kind == "DOUBLE") | self.kind.startswith("DECIMAL")
        truth = F.when(self.text == "true", "1").otherwise("0")
        return F.when(number, self.text).when(self.kind == "BOOLEAN", truth).when((self.kind == "STRING") & text.rlike(pattern), text)

    def whole(self) -> Column:
        return whole_number(self._from_text(_WHOLE))

    def number(self) -> Column:
        return self._from_text(_NUMBER).try_cast("double")


def _typed(texts: Column) -> Column:
    """The fields of one sample object, typed as JSON gives them; ``unreadable`` names those of a wrong type."""
    fields = {n: _Field(texts[n]) for n in SAMPLE_FIELDS}
    values = {
        n: f.whole() if n in _WHOLE_FIELDS else f.number() if n in _NUMBER_FIELDS else stripped(f.string()) for n, f in fields.items()
    }
    values["state"] = F.when(fields["state"].absent, "running").otherwise(values["state"])
    values["cpu_given"] = ~fields["cpu_percent"].null
    # Of the other fields a null already breaks a rule.
    mistyped = [F.when(~fields[n].null & values[n].isNull(), F.lit(n)) for n in _NULLABLE]
    stamps = [texts[n].alias(n) for n in REPLAY_FIELDS]
    return F.struct(*[c.alias(n) for n, c in values.items()], *stamps, F.array_compact(F.array(*mistyped)).alias("unreadable"))


def _checked(item: Column) -> Column:
    broken = F.array_union(field_errors(lambda name: item[name]), item["unreadable"])
    return F.struct(item.alias("sample"), broken.alias("errors"))


def _placed(lines: DataFrame) -> DataFrame:
    """Lines of files with their place."""
    meta = F.col("_metadata")
    places = [meta.file_modification_time.alias("modified"), meta.file_path.alias("file"), meta.file_block_start.alias("block")]
    return lines.select("value", *places)


def parse_envelopes(lines: DataFrame, max_samples: int = 500, replay: bool = False) -> DataFrame:
    """One row per envelope with its parsed samples and, if it is turned away, the ``reason``.

    A batch is judged inside its own row, so admission needs no shuffle. ``batch_id`` is the digest of the text: a
    retried payload is the same batch. ``line`` grows with the envelope's place in its block of the file. Types are those of
    the JSON text: a number is no name, an object no number; numerals in quotes are numbers, as are true and false.
    Text that is not one JSON object (also with NaN in it, or more text behind it) is an invalid batch.
    """
    lines = lines.withColumns({n: F.lit(None).cast(kind) for n, kind in _FROM_FILE.items() if n not in lines.columns})
    rows = lines.withColumn("json", F.when(F.col("value").rlike(r"\}\s*$"), F.try_parse_json("value")))
    # Each step reads the one before once, so a sample is parsed and typed a single time.
    rows = rows.withColumn("host", _read(_first_given("json", ["host", HOST_ALIAS])))
    rows = rows.withColumn("host", stripped(_Field(F.col("host")).string()))
    no_items = F.array().cast("array<variant>")
    rows = rows.withColumn("items", F.coalesce(F.try_variant_get(_first_given("json", BODY_NAMES), "$", "array<variant>"), no_items))
    rows = rows.withColumn("samples", F.transform("items", lambda item: _members(item, replay)))
    rows = rows.withColumn("samples", F.transform("samples", _texts)).withColumn("samples", F.transform("samples", _typed))
    rows = rows.withColumn("samples", F.transform("samples", _checked)).withColumn("batch_id", F.sha2("value", 256))
    all_valid = F.forall("samples", lambda s: F.size(s["errors"]) == 0) & valid_host(F.col("host"))
    rows = rows.withColumn("reason", batch_verdict(F.size("items"), all_valid, max_samples))
    # The upper half of the line number tells partitions apart, for lines without a place. Lines are numbered last: a filter on
    # the reason is not moved below the number, where the samples would be parsed once for each time the reason names them.
    rows = rows.withColumn("line", F.monotonically_increasing_id()).withColumn("part", F.shiftright("line", 33).cast("int"))
    return rows.select("batch_id", "host", "samples", "reason", "value", *PLACE, "line")


def _blocks(envelopes: DataFrame) -> DataFrame:
    """Per block its first line and its number of lines; only places are read for it."""
    first, last = F.min("line"), F.max("line")
    return envelopes.groupBy(*PLACE).agg(first.alias("first"), (last - first + 1).alias("lines"))


def next_number(envelopes: DataFrame, offset: int = 0) -> DataFrame:
    """Where the numbers of the envelopes that come after these begin."""
    lines = F.coalesce(F.sum("lines"), F.lit(0))
    return _blocks(envelopes).agg((lines * MAX_BATCH + F.lit(offset)).cast("bigint").alias("next"))


def envelope_samples(envelopes: DataFrame, offset: int = 0) -> DataFrame:
    """One row per sample of the admitted envelopes, with its batch and arrival number.

    Numbers rise from ``offset``: files by age, blocks and lines of a file in their order, samples of an envelope in theirs.
    Every line has room for the largest batch. What is summed up over all lines is one row per block of a file.
    """
    now = F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    earlier = W.orderBy(*PLACE).rowsBetween(W.unboundedPreceding, -1)
    starts = _blocks(envelopes).select(
        *[F.col(n).alias(f"at_{n}") for n in PLACE], "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("start")
    )
    rows = envelopes.filter(F.col("reason").isNull())
    rows = rows.join(starts, reduce(and_, [F.col(n).eqNullSafe(F.col(f"at_{n}")) for n in PLACE]))
    number = (F.col("start") + F.col("line") - F.col("first")) * MAX_BATCH + F.lit(offset)
    rows = rows.select("batch_id", "host", number.alias("number"), F.posexplode("samples.sample").alias("position", "sample"))
    return rows.select(
        "batch_id",
        "host",
        *[F.col(f"sample.{n}").alias(n) for n in SAMPLE_FIELDS if n != "state"],
        F.coalesce(F.nullif(F.col("sample.state"), F.lit("")), F.lit("running")).alias("state"),
        F.coalesce("sample.received_at", now).alias("received_at"),
        F.coalesce("sample.seq", F.col("number") + F.col("position")).alias("seq"),
    )


def read_envelopes(spark: SparkSession, path: str, max_samples: int = 500, replay: bool = False) -> DataFrame:
    return parse_envelopes(_placed(spark.read.text(path)), max_samples, replay)


def stream_lines(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """Envelope lines and their places as a stream; they are parsed trigger by trigger."""
    return _placed(spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).text(path))


def to_envelopes(samples: DataFrame, group: list[str]) -> DataFrame:
    """JSON lines of envelopes, one per host and further ``group`` columns; samples in arrival order."""
    sample = F.struct("received_at", "seq", *SAMPLE_FIELDS)
    return (
        samples.groupBy("host", *group)
        .agg(F.array_sort(F.collect_list(sample)).alias("samples"))
        .select("host", *group, F.to_json(F.struct("host", "samples"), {"ignoreNullFields": "false"}).alias("value"))
    )
