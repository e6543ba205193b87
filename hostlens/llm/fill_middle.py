"""Fill-in-the-middle transformation over seekable compressed frames.

A text is cut into units (lines, each with its line feed). Two cuts between units, drawn from a digest of the
document's id, part it into prefix, middle and suffix, which are written in another order behind sentinels.

1. `store` writes each text once as independent zstandard frames of at most `FRAME` bytes, cut between code
   points, with the units, code points and bytes of every frame. Their running sums form the seek table.
2. A cut finds its frame in the running unit counts; that one frame is decompressed to find the exact place.
3. Digests, outputs and rebuilt texts come from frames streamed in the order wanted, so a task never holds more
   of a text than its compressed frames and one open frame.

Forms: `psm` is P prefix S suffix M middle, `spm` is S suffix P prefix M middle, `plain` is the text itself.

Defined cases: a null text counts as empty; empty texts and texts that hold a sentinel stay plain, with null
counts. A null id draws like the empty id. Repeated rows draw alike, each with its own result row; there are no
ties. A text may be as long as a row may be; an empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import chosen, cuts, kept, map_batches

#: Bytes of text in a frame.
FRAME = 1 << 16
LEVEL = 1
SENTINELS = ("<P>", "<S>", "<M>")
#: Prefix of the drawn digest, percent of texts transformed, percent of those in the form spm.
SEED, RATE, SPM_RATE = "7", 100, 50

_STORED = "units long, marked boolean, sizes array<int>, lines array<int>, chars array<int>, bytes array<int>, frames binary"


def _pieces(data: bytes, frame: int) -> Iterator[bytes]:
    """data in pieces of at most frame bytes that end between code points."""
    start = 0
    while start < len(data):
        end = min(start + frame, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[start:end]
        start = end


def store(documents: DataFrame, frame: int = FRAME, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """doc_id and the framed text of every row, written to the shared folder."""
    if frame < 4:
        raise ValueError("a frame must hold any code point")
    marks = [s.encode() for s in sentinels]
    rows = chosen(documents, doc_id=F.col("doc_id"), text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for whole in batches:
            for batch in cuts(whole, "text"):
                columns: list[list] = [[] for _ in range(7)]
                for scalar in batch.column("text").cast(pa.binary()):
                    data = scalar.as_py()
                    pieces = list(_pieces(data, frame))
                    frames = [compressor.compress(p) for p in pieces]
                    lines = [p.count(b"\n") for p in pieces]
                    units = sum(lines) + (data != b"" and not data.endswith(b"\n"))
                    marked = any(m in data for m in marks)
                    chars = [len(p.decode()) for p in pieces]
                    row = (units, marked, [len(f) for f in frames], lines, chars, [len(p) for p in pieces], b"".join(frames))
                    for column, value in zip(columns, row):
                        column.append(value)
                ints = pa.list_(pa.int32())
                kinds = [pa.int64(), pa.bool_(), ints, ints, ints, ints, pa.binary()]
                names = ["doc_id", "units", "marked", "sizes", "lines", "chars", "bytes", "frames"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names)

    return kept(map_batches(rows, framed, f"doc_id {id_type}, {_STORED}"), "frames")


class Framed:
    """One stored text: sought by unit or byte through the running sums of its frames."""

    def __init__(self, row: dict) -> None:
        self.units, self.frames = row["units"], row["frames"]
        self.at, self.lines, self.chars, self.bytes = (
            list(accumulate(row[name], initial=0)) for name in ("sizes", "lines", "chars", "bytes")
        )
        self._open: tuple[int, bytes] = (-1, b"")

    def frame(self, i: int) -> bytes:
        if self._open[0] != i:
            data = memoryview(self.frames)[self.at[i] : self.at[i + 1]]
            self._open = i, zstandard.ZstdDecompressor().decompress(data)
        return self._open[1]

    def cut(self, unit: int) -> tuple[int, int]:
        """The place after that many units, in bytes and in code points."""
        if unit == 0:
            return 0, 0
        if unit == self.units:
            return self.bytes[-1], self.chars[-1]
        # The first frame whose running count of line feeds reaches unit holds the one wanted.
        i = bisect_left(self.lines, unit) - 1
        data, end = self.frame(i), 0
        for _ in range(unit - self.lines[i]):
            end = data.index(b"\n", end) + 1
        return self.bytes[i] + end, self.chars[i] + len(data[:end].decode())

    def read(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from start to end, frame by frame."""
        i = bisect_left(self.bytes, start + 1) - 1
        while start < end:
            stop = min(end, self.bytes[i + 1])
            yield self.frame(i)[start - self.bytes[i] : stop - self.bytes[i]]
            start, i = stop, i + 1


class Output:
    """A transformed text as a list of parts: sentinels, and ranges of the framed text."""

    def __init__(self, text: Framed, parts: list[bytes | tuple[int, int]]) -> None:
        self.text, self.parts = text, parts

    def read(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        at = 0
        for part in self.parts:
            length = len(part) if isinstance(part, bytes) else part[1] - part[0]
            a, b = max(start - at, 0), length if end is None else min(end - at, length)
            if a < b:
                if isinstance(part, bytes):
                    yield part[a:b]
                else:
                    yield from self.text.read(part[0] + a, part[0] + b)
            at += length

    def find(self, mark: bytes, start: int) -> int:
        """Where mark first stands from start on; pieces overlap by what a mark may straddle."""
        tail, at = b"", start
        for piece in self.read(start):
            joined = tail + piece
            found = joined.find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = joined[max(0, len(joined) - len(mark) + 1) :]
        raise ValueError("a sentinel is missing")

    @property
    def size(self) -> int:
        return sum(len(p) if isinstance(p, bytes) else p[1] - p[0] for p in self.parts)


def rebuilt(output: Output, form: str, sentinels: tuple[str, ...]) -> Iterator[bytes]:
    """The text, from nothing but an output and its form."""
    if form == "plain":
        yield from output.read()
        return
    p, s, m = (x.encode() for x in sentinels)
    first, second = (p, s) if form == "psm" else (s, p)
    second_at = output.find(second, len(first))
    middle_at = output.find(m, second_at + len(second))
    spans = [(len(first), second_at), (second_at + len(second), middle_at)]
    prefix, suffix = spans if form == "psm" else spans[::-1]
    for start, end in (prefix, (middle_at + len(m), output.size), suffix):
        yield from output.read(start, end)


def _sha256(pieces: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def transformed(row: dict, seed: str, rate: int, spm_rate: int, sentinels: tuple[str, ...]) -> tuple[str, Output, int | None, int | None]:
    """Form, output, and the code points of prefix and middle of one stored text."""
    text, total = Framed(row), sum(row["bytes"])
    drawn = hashlib.sha256(f"{seed}:{'' if row['doc_id'] is None else row['doc_id']}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[8 * i : 8 * i + 8], 16) for i in range(4))
    if not total or row["marked"] or h3 % 100 >= rate:
        return "plain", Output(text, [(0, total)] if total else []), None, None
    low, high = sorted((h1 % (text.units + 1), h2 % (text.units + 1)))
    (a, a_chars), (b, b_chars) = text.cut(low), text.cut(high)
    p, s, m = (x.encode() for x in sentinels)
    if h4 % 100 < spm_rate:
        form, parts = "spm", [s, (b, total), p, (0, a), m, (a, b)]
    else:
        form, parts = "psm", [p, (0, a), s, (b, total), m, (a, b)]
    return form, Output(text, parts), a_chars, b_chars - a_chars


def _each(stored: DataFrame, schema: str, kinds: list[pa.DataType], function) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    id_type = stored.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cuts(whole, "frames"):
                columns: list[list] = [[] for _ in names]
                for row in batch.to_pylist():
                    for column, value in zip(columns, function(row)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], ["doc_id", *names])

    return map_batches(stored, work, f"doc_id {id_type}, {schema}")


def outputs(stored: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """doc_id, form, output: the transformed texts themselves."""

    def one(row: dict) -> tuple:
        form, output, _, _ = transformed(row, seed, rate, spm_rate, sentinels)
        return form, b"".join(output.read()).decode()

    return _each(stored, "form string, output string", [pa.string(), pa.string()], one)


def report(stored: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every stored text."""

    def one(row: dict) -> tuple:
        form, output, prefix, middle = transformed(row, seed, rate, spm_rate, sentinels)
        return row["units"], form, prefix, middle, _sha256(output.read()), _sha256(rebuilt(output, form, sentinels))

    schema = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _each(stored, schema, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], one)
