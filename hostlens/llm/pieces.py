"""SentencePiece BPE encoding by a prefix table, and decoding.

For each prefix of a word the encoding's last token is unique. The table holds it: of the
pieces that end at a place (found by an automaton over the vocabulary, longest first) it is the one
whose own prefix is the start or ends in a token with which the piece forms a compatible pair. Two
tokens are compatible if their joint text is encoded as just these two; a sequence is an encoding
exactly if all its adjacent pairs are compatible. The ids are read from the table backwards.

Compatibility undoes the merges of both tokens, latest first, and asks at each step whether the two
pieces at the boundary would have been merged earlier. It holds where the parts of each piece come
before the piece; `Pieces` checks that for its model file, and that no piece crosses from a word into
the space mark of the next, so that texts fall into words that are encoded each for itself and kept.
A model without these properties, or with a normalizer, is refused.

Defined cases: null counts as empty, an empty text has only the end id; characters that the vocabulary
lacks become byte ids; repeated rows are encoded each for itself; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import chosen, cuts

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words and pairs a worker remembers; beyond that it starts anew. This bounds memory, not results.
WORDS, PAIRS = 500_000, 1_000_000
#: Bits of a place in the table of pairs that batches of words share: a pair's place holds the last one met.
PLACES = 21
#: Words up to this length, so many at a time, share a table; longer ones have their own.
TABLE_LENGTH, TABLE_WORDS = 32, 32768
#: Bytes of text that are split into words at a time.
TOGETHER = 2 << 20

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def split_words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts whose blanks are marks, and each text's first place among them (one more at the end).

    A word begins with its text, or with a mark behind another character; marks at the end are a word of their own."""
    encoded = [t.encode() for t in texts]
    data = b"".join(encoded)
    ends = np.cumsum([0, *map(len, encoded)], dtype=np.int64)
    letters = np.frombuffer(data, np.uint8)
    mark = MARK.encode()
    is_mark = np.zeros(len(letters) + 3, bool)
    if len(letters) >= 3:
        is_mark[3:-2] = (letters[:-2] == mark[0]) & (letters[1:-1] == mark[1]) & (letters[2:] == mark[2])
    begins = is_mark[3:] & ~is_mark[:-3]  # a mark, and none that ends right before it
    begins[ends[:-1][ends[:-1] < ends[1:]]] = True
    at = np.flatnonzero(begins)
    offsets = np.append(at, len(data)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    return found.dictionary_encode(), np.searchsorted(at, ends)


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as spec

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        form = spec.ModelProto()
        with open(path, "rb") as file:
            form.ParseFromString(file.read())
        norm = form.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("the model changes its text before encoding")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.end = form.trainer_spec.eos_id
        normal = spec.ModelProto.SentencePiece.Type.Value("NORMAL")
        pieces = [(i, p.piece, p.score) for i, p in enumerate(form.pieces) if p.type == normal]
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.id_of = {text: i for i, text, _ in pieces}
        order = {i: k for k, (i, _, _) in enumerate(sorted(pieces, key=lambda p: -p[2]))}
        if any(MARK in text.lstrip(MARK) for _, text, _ in pieces):
            raise ValueError("a piece goes from one word into the next")
        # rank: place in the order of merging; single characters come before all merges.
        self.rank = {i: order[i] if len(text) > 1 else -1 for i, text, _ in pieces}
        self.length = {i: len(text) for i, text, _ in pieces}
        self.joined: dict[tuple[int, int], int] = {}
        for i, text, _ in pieces:
            for cut in range(1, len(text)):
                left, right = self.id_of.get(text[:cut]), self.id_of.get(text[cut:])
                if left is not None and right is not None:
                    self.joined[left, right] = i
        self.parts: dict[int, tuple[int, int]] = {}
        for i, text, _ in pieces:
            if len(text) > 1:
                parts = self._last_merge(text)
                if parts is None:
                    continue  # never the outcome of merging: such a piece is not used
                if max(self.rank[parts[0]], self.rank[parts[1]]) >= self.rank[i]:
                    raise ValueError("a piece comes before its parts")
                self.parts[i] = parts
        self.automaton = ahocorasick.Automaton()
        for i, text, _ in pieces:
            if len(text) == 1 or i in self.parts:
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self._lay_out_trie()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.table = np.full(1 << PLACES, -1, np.int64)
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}

    def _last_merge(self, text: str) -> tuple[int, int] | None:
        """The two pieces whose merge completes text, by merging in order; None if it ends otherwise."""
        state = [self.id_of.get(c) for c in text]
        if None in state:
            return None
        while len(state) > 2:
            options = [(self.rank[self.joined[p]], k) for k, p in enumerate(zip(state, state[1:], strict=False)) if p in self.joined]
            if not options:
                return None
            _, k = min(options)
            state[k : k + 2] = [self.joined[state[k], state[k + 1]]]
        return (state[0], state[1]) if (state[0], state[1]) in self.joined else None

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        rank, parts = self.rank, self.parts
        limit = len(rank) + 1  # merges from here on would meet another state
        while True:
            joint = self.joined.get((left, right))
            if joint is not None and rank[joint] < limit:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            # Of equal merges the one further left comes first, so the right one is undone first.
            if a > b:
                limit, left = a, parts[left][1]
            else:
                # A merge at the boundary of the same rank lies further left and comes first.
                limit, right = b + 1, parts[right][0]

    def word(self, text: str) -> list[int]:
        """Ids of a word, from the table of its prefixes."""
        n = len(text)
        last: list[int] = [-1] * (n + 1)  # -1: none yet
        back = [0] * (n + 1)
        compatible, reached = self.compatible, 0
        for at, (piece, size) in self.automaton.iter(text):
            end = at + 1
            for gap in range(reached + 1, end):  # no piece ends there: bytes of one character
                if last[gap] == -1:
                    last[gap], back[gap] = -2, gap - 1
            reached = at
            if last[end] != -1:
                continue
            start = end - size
            before = last[start]
            if start == 0 or before == -2 or (before != -1 and compatible(before, piece)):
                last[end], back[end] = piece, start
        for gap in range(1, n + 1):
            if last[gap] == -1:
                last[gap], back[gap] = -2, gap - 1
        return self._read(text, last, back)

    def _lay_out_trie(self) -> None:
        """The automaton's forward edges as sorted arrays, for many words at once."""
        nodes, edges, piece_at = {"": 0}, {}, [-1]
        for text, i in self.id_of.items():
            if len(text) > 1 and i not in self.parts:
                continue
            for k in range(1, len(text) + 1):
                head = text[:k]
                if head not in nodes:
                    nodes[head] = len(nodes)
                    piece_at.append(-1)
                    edges[(nodes[head[:-1]] << 21) | ord(head[-1])] = nodes[head]
            piece_at[nodes[text]] = i
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_ends = np.array([edges[k] for k in sorted(edges)], np.int64)
        self.piece_at = np.array(piece_at, np.int64)

    def _compatible_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """compatible() of each pair, by a table of remembered pairs; a pair is held as key and answer."""
        keys = left << 32 | right
        places = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES)).astype(np.int64)
        held = self.table[places]
        fits = (held & 1).astype(bool)
        unknown = np.flatnonzero(held >> 1 != keys)
        if len(unknown):
            pairs, first, back = np.unique(keys[unknown], return_index=True, return_inverse=True)
            answers = np.array([self._compatible(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()], bool)
            fits[unknown] = answers[back]
            self.table[places[unknown[first]]] = pairs << 1 | answers
        return fits

    def many(self, words: list[str]) -> list[list[int]]:
        """word() of each word, place by place for all words together (words of similar, small length)."""
        n, most = len(words), max(map(len, words))
        letters = np.zeros((n, most), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sizes = np.array([len(w) for w in words], np.int64)
        letters[np.arange(most) < sizes[:, None]] = flat
        # matches[end]: (start, rows, pieces), longest first
        matches: list[list] = [[] for _ in range(most + 1)]
        for start in range(most):
            rows = np.flatnonzero(sizes > start)
            state = np.zeros(len(rows), np.int64)
            for end in range(start + 1, most + 1):
                inside = sizes[rows] >= end
                rows, state = rows[inside], state[inside]
                keys = state << 21 | letters[rows, end - 1]
                at = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
                hit = self.edge_keys[at] == keys
                rows, state = rows[hit], self.edge_ends[at[hit]]
                if not len(rows):
                    break
                ids = self.piece_at[state]
                whole = ids >= 0
                if whole.any():
                    matches[end].append((start, rows[whole], ids[whole]))
        last = np.full((most + 1, n), -1, np.int64)
        back = np.zeros((most + 1, n), np.int64)
        for end in range(1, most + 1):
            for start, rows, ids in matches[end]:
                before = last[start, rows]
                open_ = (last[end, rows] == -1) & ((before != -1) | (start == 0))
                rows, ids, before = rows[open_], ids[open_], before[open_]
                if start:
                    fits = before == -2
                    fits[~fits] = self._compatible_many(before[~fits], ids[~fits])
                    rows, ids = rows[fits], ids[fits]
                last[end, rows], back[end, rows] = ids, start
            none = last[end] == -1
            last[end, none], back[end, none] = -2, end - 1
        # Read backwards, all words at once; -2 (characters as bytes) is rare and read word by word.
        at, step = sizes.copy(), 0
        tokens = np.zeros((n, most), np.int32)
        every, sizes_out, plain = np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
        while len(every):
            ids = last[at[every], every]
            plain[every[ids < 0]] = False
            step += 1
            tokens[every, most - step] = ids
            sizes_out[every] = step
            at[every] = back[at[every], every]
            every = every[at[every] > 0]
        out: list[list[int]] = [row[most - k :] for row, k in zip(tokens.tolist(), sizes_out.tolist(), strict=True)]
        for k in np.flatnonzero(~plain).tolist():
            out[k] = self._read(words[k], last[:, k].tolist(), back[:, k].tolist())
        return out

    def _read(self, text: str, last: list[int], back: list[int]) -> list[int]:
        """A word's ids from its table, read backwards."""
        ids: list[int] = []
        at = len(text)
        while at:
            start = back[at]
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids.extend(self.bytes[b] for b in reversed(text[start:at].encode()))
            at = start
        ids.reverse()
        return ids

    def _entries(self, words: list[str]) -> list[tuple[list[int], str]]:
        """Ids, and the same as text, of different words; those met before are remembered."""
        known = self.words
        if len(known) > WORDS:
            known.clear()
        found = [known.get(w) for w in words]
        new = sorted((k for k, e in enumerate(found) if e is None), key=lambda k: len(words[k]))
        short = [k for k in new if len(words[k]) <= TABLE_LENGTH]
        for lot in (short[k : k + TABLE_WORDS] for k in range(0, len(short), TABLE_WORDS)):
            for k, ids in zip(lot, self.many([words[k] for k in lot]), strict=True):
                found[k] = ids, " ".join(map(str, ids))
        for k in new[len(short) :]:
            ids = self.word(words[k])
            found[k] = ids, " ".join(map(str, ids))
        if len(short) <= WORDS:
            known.update((words[k], found[k]) for k in short)
        return found

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Of each text, ids with the end id and the same as text."""
        words, begins = split_words([self.prefix + t.replace(" ", MARK) if t else "" for t in texts])
        entries = self._entries(words.dictionary.to_pylist())
        place = words.indices.to_numpy()
        sizes = np.fromiter((len(ids) for ids, _ in entries), np.int64, len(entries))
        flat = np.fromiter(chain.from_iterable(ids for ids, _ in entries), np.int64, int(sizes.sum()))
        each = sizes[place]
        ids = flat[ragged((np.cumsum(sizes) - sizes)[place], each)]
        ends = np.append(0, np.cumsum(each))[begins].tolist()
        shown, place = [text for _, text in entries], place.tolist()
        for k in range(len(texts)):
            own = ids[ends[k] : ends[k + 1]].tolist()
            own.append(self.end)
            yield own, " ".join([*map(shown.__getitem__, place[begins[k] : begins[k + 1]]), str(self.end)])

    def encode(self, text: str) -> tuple[list[int], str]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(documents: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; with_ids adds the ids and the text."""
    path = path or public_tokenizers.path(VOCABULARY)
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in cuts(batch, "text", TOGETHER):
                rows = []
                encoded = model.encode_all([t or "" for t in part.column("text").to_pylist()])
                for doc_id, (ids, shown) in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    decoded = model.decode(ids)
                    digest = hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
                    rows.append((doc_id, len(ids), *digest, *((ids, decoded) if with_ids else ())))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(columns)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return chosen(documents, doc_id=F.col("doc_id").cast("long"), text=F.col("text")).mapInArrow(run, schema)
