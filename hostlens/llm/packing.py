"""Sequence packing by power-of-two decomposition.

A document's ids are cut into pieces of `length` ids as long as they last and, for the rest,
into one piece for each set bit of its length, largest first. Every piece is a sequence of its
own: no sequence crosses documents and none needs padding. Pieces of equal length form a
bucket (`bucket` is the length's exponent), from which training takes equal batches.

The tokenizer is a file of the `tokenizers` library with byte-level BPE. Its ids can be had
faster from the same ranks in `tiktoken`: both agree on a text if the file has no normalizer and
no prefix space, its merges are in the order of their ids, and each token, encoded alone, is
itself (`ranked`, checked when a task loads the file). Then a state of the merging that
offers another split of a token cannot arise. Texts with characters beyond U+024F, whose class
may depend on a library's Unicode version, texts with a special string, and texts with a run of more than
`SPACE_RUN` white-space characters, which `tiktoken` refuses from about a million on, go to `tokenizers`.

Defined cases: a null or empty text has only the end id and is one piece of length 1. Rows that
are repeated are packed each for itself. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import chosen, cuts

LENGTH = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
BEYOND = re.compile("[^\x00-\u024f]")
SPACE_RUN = 100_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def decompose(n: int, length: int = LENGTH) -> list[int]:
    """Piece lengths of a document of n ids: full ones, then the powers of two of the rest."""
    whole, rest = divmod(n, length)
    return [length] * whole + [1 << b for b in range(length.bit_length() - 1, -1, -1) if rest >> b & 1]


@lru_cache(maxsize=2)
def _loaded(path: str):
    import json

    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    special = [t["content"] for t in parts["added_tokens"]]
    fast = None
    if _ranked(parts, library):
        to_byte = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in parts["model"]["vocab"].items()}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return library, fast, special


def _byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: printable bytes stand for themselves, the
    others for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [], 256
    for byte in range(256):
        if byte in plain:
            out.append(chr(byte))
        else:
            out.append(chr(more))
            more += 1
    return out


def _ranked(parts: dict, library) -> bool:
    """Whether ranks alone give the library's ids (see above)."""
    model, split = parts["model"], parts["pre_tokenizer"] or {}
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or parts["normalizer"]:
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b) for a, b in merges]
    if made != sorted(set(made)) or len(made) + 256 != len(vocab) or set(_byte_letters()) - set(vocab):
        return False
    return all(len(library.model.tokenize(token)) == 1 for token in vocab)


def _long_run(text: str) -> bool:
    """Whether a run of white space is longer than SPACE_RUN."""
    return len(text) > SPACE_RUN and any(m.end() - m.start() > SPACE_RUN for m in re.finditer(r"\s\s+", text))


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of whole texts without added tokens, as unsigned 32-bit numbers."""
    library, fast, special = _loaded(path)
    out = []
    for text in texts:
        plain = fast is not None and not BEYOND.search(text) and not any(s in text for s in special) and not _long_run(text)
        if plain:
            out.append(fast.encode_to_numpy(text, disallowed_special=()))
        else:
            out.append(np.array(library.encode(text, add_special_tokens=False).ids, np.uint32))
    return out


def cut_documents(documents: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian 32 bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cuts(batch, "text", 1 << 20):
                columns: list[list] = [[], [], [], [], [], []]
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts, path), strict=True):
                    n = len(ids) + 1
                    data = ids.astype("<u4", copy=False).tobytes() + end_id.to_bytes(4, "little")
                    at = 0
                    for size in decompose(n, length):
                        piece = data[4 * at : 4 * (at + size)]
                        for column, value in zip(columns, (doc_id, at, size, zlib.crc32(piece), n, piece), strict=True):
                            column.append(value)
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.binary()], strict=True)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    if length & (length - 1):
        raise ValueError("length must be a power of two")
    return chosen(documents, doc_id=F.col("doc_id").cast("long"), text=F.col("text")).mapInArrow(run, SCHEMA)


def pack_documents(documents: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces with their ids, bucket, sequence_id and offset. Each piece is a sequence; its number is
    its task's number and its place in it, so numbers are unique and need no shuffle."""
    pieces = cut_documents(documents, path or public_tokenizers.path(VOCABULARY), length, end_id)
    return pieces.withColumns({
        "bucket": F.log2(F.col("length").cast("double")).cast("int"),
        "sequence_id": F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
    })


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences by bucket: one folder for each power of two, of equally long rows."""
    packed.select("sequence_id", "doc_id", "start", "ids", "bucket").write.partitionBy("bucket").parquet(path)


def report(packed: DataFrame) -> DataFrame:
    """The pieces without their ids."""
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
