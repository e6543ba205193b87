"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced.

A chunk's tokens are right except near its ends. Two neighbouring chunks overlap, and the splice
goes where both hold the same two adjacent tokens at the same place. For BPE that is a proof, not a
guess: a token sequence is the encoding of its text exactly if each adjacent pair is the
encoding of its own text, and every pair of the spliced sequence is a pair of one of the chunks. The
first token of a later chunk carries that chunk's start mark and is never used. If no such place
is found, the overlap is doubled, in the end to the whole rest of the document.

For files of `tokenizers` the proof needs that the pre-tokenizer does not look across the place: the
splice then goes only between a letter, digit or sign and white space after it, for byte-level BPE
without normalizer. Any other model of either library is run over the whole text.

Defined cases: null counts as empty, an empty text has no tokens; repeated rows are counted each for
itself; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import chosen, cuts

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a chunk and of the first overlap; shorter documents are encoded in one piece.
CHUNK, OVERLAP = 1 << 16, 256

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class SentencePieces:
    """A sentencepiece model; places are characters of the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.lengths = np.zeros(n, np.int64)
        for i in range(n):
            if self.model.is_byte(i):
                # The first byte of a character counts for the character.
                self.lengths[i] = (int(self.model.id_to_piece(i)[3:5], 16) & 0xC0) != 0x80
            elif not self.model.is_control(i) and not self.model.is_unknown(i):
                self.lengths[i] = len(self.model.id_to_piece(i))
        self.splices = all(self.model.is_byte(self.model.piece_to_id(f"<0x{b:02X}>")) for b in range(256))

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.model.encode(t, num_threads=1)) for t in texts]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and the ends of their spans in text; None if the model's normal form has other places."""
        ids = np.array(self.ids(text), np.int64)
        ends = np.cumsum(self.lengths[ids]) - 1  # the start mark is no character of the text
        return (ids, ends) if len(ids) and ends[-1] == len(text) else None

    def allowed(self, text: str, places: np.ndarray) -> np.ndarray:
        return np.ones(len(places), bool)


class Library:
    """A file of the tokenizers library."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        split = parts["pre_tokenizer"] or {}
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.splices = (
            not parts["normalizer"]
            and parts["model"]["type"] == "BPE"
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
        )

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        if any(s in text for s in self.special):
            return None
        found = self.model.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int64), np.array([e for _, e in found.offsets], np.int64)

    def allowed(self, text: str, places: np.ndarray) -> np.ndarray:
        return np.array([bool(_WORD_END.match(text, p - 1)) if p > 0 else False for p in places], bool)


_WORD_END = re.compile(r"[^\s\x1c-\x1f][ \t\n\r\x0b\x0c]")


@lru_cache(maxsize=2)
def model(path: str) -> SentencePieces | Library:
    return SentencePieces(path) if path.endswith(".model") else Library(path)


def _splice(left, right, shift: int, text: str, encoder) -> tuple[int, int] | None:
    """Indexes (i, j): left[:i] and right[j:] make one encoding. right starts at character shift."""
    (a, a_ends), (b, b_ends) = left, right
    # Boundaries inside both, by place; b's first token and a's last are left out.
    places, i, j = np.intersect1d(a_ends[:-1], b_ends[1:-1] + shift, return_indices=True)
    j = j + 1
    if not len(places):
        return None
    # The tokens before and after the boundary are the same on both sides, in id and span.
    start = lambda ends, k: np.where(k > 0, ends[np.maximum(k - 1, 0)], 0)
    same = (
        (a[i] == b[j])
        & (a[i + 1] == b[j + 1])
        & (start(a_ends, i) == start(b_ends, j) + shift)
        & (a_ends[i + 1] == b_ends[j + 1] + shift)
    )
    same &= (i > 0) | (shift == 0)
    if same.any():
        same[same] = encoder.allowed(text, places[same])
    found = np.flatnonzero(same)
    if not len(found):
        return None
    at = found[len(found) // 2]
    return int(i[at]) + 1, int(j[at]) + 1


def encode_long(text: str, encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a text of any length, as the library gives them for the whole text."""
    if len(text) <= chunk or not encoder.splices:
        return encoder.ids(text)
    found = encoder.spans(text[:chunk])
    if found is None:
        return encoder.ids(text)
    done, (ids, ends), end = [], found, chunk
    base = 0  # the character at which ids begin
    while end < len(text):
        width = overlap
        while True:
            start = max(base, end - width)
            stop = min(len(text), end + chunk)
            right = encoder.spans(text[start:stop])
            if right is None:
                return encoder.ids(text)
            at = _splice((ids, ends), right, start - base, text[base:stop], encoder)
            if at is not None:
                break
            if start == base:  # the overlap is all there is: the longer chunk replaces the shorter
                at = (0, 0)
                break
            width *= 2
        done.append(ids[: at[0]])
        ids, ends = right
        ids, ends = ids[at[1] :], ends[at[1] :]
        if at[1]:
            # Keep places relative to the chunk; the token before the splice is settled.
            base = start
        else:
            base = start
        end = stop
    done.append(ids)
    return np.concatenate(done).tolist()


def count_tokens(documents: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = model(path)
        for batch in batches:
            for part in cuts(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts = np.zeros(len(texts), np.int64)
                short = [k for k, t in enumerate(texts) if len(t) <= chunk]
                counts[short] = encoder.counts([texts[k] for k in short])
                for k, t in enumerate(texts):
                    if len(t) > chunk:
                        counts[k] = len(encode_long(t, encoder, chunk, overlap))
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), sizes, pa.array(counts), pa.array(counts > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return chosen(documents, doc_id=F.col("doc_id").cast("long"), text=F.col("text")).mapInArrow(run, SCHEMA)
