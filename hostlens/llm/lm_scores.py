"""Document log-likelihoods under a gated recurrent language model, and under word counts.

Words are split at white space, ASCII letters lower-cased; an end token closes each document.

1. The training documents' words are counted: a count for each distinct word of a task, summed by a shuffle.
2. The words seen more than once, the about `HEAD` most frequent ones if there are more, are the network's
   symbols, in classes by frequency. All others fall into `TAILS` tail classes by their last two bytes; within a
   tail class a word has its add-one share, with one place for words not seen in training. Words seen once are
   left to the tails because from them the network learns how likely an unseen word is. So the model is a proper
   distribution over all words.
3. The network starts from a pilot of at most `PILOT` documents, so that all copies lie close together; then
   every task trains a copy on all its training documents, and the copies are averaged, weighted by tokens.
4. The network runs over the documents where they lie, on parallel lanes. What it cannot know is how often the words
   beyond its symbols were seen: these words alone meet the counts of their block's words (a block is a part of an
   input partition), and what they add is added to the document's scores.

What is sent around is a block's distinct words and its documents' words beyond the head, not its texts; only the head,
the network's parameters (33 for each of its words) and the tail classes' sums pass through the driver, all bounded by `HEAD`.

Defined cases: null counts as empty; an empty text has the end token only; without training documents N and V are
0 and base_score is 0; repeated rows are scored each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostlens.llm.common import chosen, cuts, kept, pieces_of, released
from hostlens.llm.gated_net import Layout, Net

HEAD, TAILS = 50_000, 16
#: Parameters in a row when copies are averaged.
CHUNK = 1024
PILOT, PILOT_RATE, RATE = 2000, 0.01, 0.003
#: What looking at a class of a window costs, in softmax terms for each of the window's tokens.
CLASS_TERMS = 0.2
#: Bytes of text in a block, and tokens that a task puts on lanes at a time.
BLOCK_BYTES, LANE_TOKENS = 32 << 20, 6_000_000

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the number of the text that each is from."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    # White space at either end of a text leaves an empty piece.
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


@dataclass
class Corpus:
    """What scoring needs of the counts, bounded by HEAD and TAILS."""

    head: list[bytes]
    head_counts: np.ndarray
    documents: int
    tail_tokens: np.ndarray
    tail_words: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.head_counts.sum() + self.tail_tokens.sum()) + self.documents

    @property
    def distinct(self) -> int:
        return len(self.head) + int(self.tail_words.sum()) + (self.documents > 0)

    @property
    def counts(self) -> np.ndarray:
        """By symbol: the end token, the head's words, the tails."""
        return np.concatenate([[self.documents], self.head_counts, self.tail_tokens]).astype(float)

    def layout(self) -> Layout:
        """The end token has a class; the head's words, by frequency, share the next; each tail is one.
        Of some numbers of head classes, that with the least softmax terms for a token is taken."""
        weight = np.sqrt(self.head_counts + 1.0)
        share = (np.cumsum(weight) - weight) / max(weight.sum(), 1.0)

        def dealt(classes: int) -> np.ndarray:
            return np.minimum((share * classes).astype(int), classes - 1)

        def terms(classes: int) -> float:
            at = dealt(classes)
            return 2 * classes**0.5 + classes * CLASS_TERMS + float(np.bincount(at, self.head_counts) @ np.bincount(at)) / max(self.tokens, 1)

        classes = min((2**k for k in range(10)), key=terms) if self.head else 1
        tails = 1 + classes + np.arange(TAILS)
        return Layout(np.concatenate([[0], 1 + dealt(classes), tails]).astype(np.int64), 1 + classes + TAILS)

    def symbols(self) -> Symbols:
        return Symbols(self.head, len(self.head) + 1)


@functools.cache
def _tails() -> tuple[np.ndarray, np.ndarray]:
    """Tail of words of one byte, and of those that end in two bytes."""
    one = np.array([tail_of(bytes([a])) for a in range(256)])
    return one, np.array([tail_of(bytes([a, b])) for a in range(256) for b in range(256)])


class Symbols:
    """Symbol of each word."""

    def __init__(self, head: list[bytes], first: int):
        self.head, self.first = pa.array(head, pa.binary()).cast(pa.string()), first

    def __getitem__(self, word: bytes) -> int:
        return int(self.of(pa.array([word], pa.binary()).cast(pa.string()))[0])

    def of(self, words: pa.Array) -> np.ndarray:
        out = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False) + np.int32(1)
        beyond = out == 0
        rest = words.filter(pa.array(beyond))
        if len(rest):
            ends = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1]
            data, (one, two) = np.frombuffer(rest.buffers()[2], np.uint8), _tails()
            last, before = data[ends[1:] - 1], data[ends[1:] - 2].astype(int)
            out[beyond] = self.first + np.where(np.diff(ends) > 1, two[before * 256 + last], one[last])
        return out


def _sequences(symbols: np.ndarray, owner: np.ndarray, texts: int) -> list[np.ndarray]:
    """The symbols of each text, closed by the end token."""
    out = np.zeros(len(symbols) + texts, np.int32)
    out[np.arange(len(symbols)) + owner] = symbols
    return np.split(out, np.cumsum(np.bincount(owner, minlength=texts) + 1)[:-1])


def block_words(blocks: DataFrame, training: Column) -> DataFrame:
    """block, word, n: the distinct words of each task's blocks and how often training documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                found = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
                learned = found.indices.to_numpy()[np.concatenate([t for _, t in parts])]
                every, counts = found.dictionary.cast(pa.binary()), np.bincount(learned, minlength=len(found.dictionary))
                for at in range(0, len(every), 100_000):
                    lot = every.slice(at, 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(lot), block)), lot, pa.array(counts[at : at + len(lot)])], ["block", "word", "n"]
                    )
            held.clear()

        size = 0
        for batch in (part for whole in batches for part in cuts(whole, "text")):
            block, train = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "train"))
            for own in np.unique(block):
                at = np.flatnonzero(block == own)
                found, owner = split(batch.column("text").take(pa.array(at)))
                held.setdefault(int(own), []).append((found, train[at][owner].astype(bool)))
                size += len(found)
            if size > LANE_TOKENS:
                yield from emit()
                size = 0
        yield from emit()

    rows = blocks.select("block", "text", F.coalesce(training, F.lit(False)).alias("train"))
    return rows.mapInArrow(lambda batches: released(run(batches)), "block long, word binary, n long")


def _step(count: Column) -> Column:
    return F.floor(F.log2(count.cast("double")) * 64).cast("long")


def gather(counts: DataFrame, documents: int) -> Corpus:
    """Head and tail sums of word counts (word, c); about HEAD + TAILS rows come to the driver."""
    seen = counts.filter("c > 0")
    # Words by steps of their frequency: the lowest step that has no room as a whole gives a part by hash.
    step = _step(F.col("c"))
    sizes = seen.filter("c > 1").groupBy(step.alias("step")).count().collect()  # at most 64 rows for each power of two
    room, lowest, share = HEAD, 0, 1.0
    for r in sorted(sizes, key=lambda r: -r["step"]):
        lowest, share = r["step"], min(1.0, room / r["count"])
        room -= r["count"]
        if room <= 0:
            break
    chance = F.pmod(F.xxhash64("word"), F.lit(1 << 20))
    taken = seen.filter((F.col("c") > 1) & ((step > lowest) | ((step == lowest) & (chance < int(share * (1 << 20))))))
    head = sorted(taken.collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    tail_key = (F.crc32(F.expr("substring(word, -2, 2)")) % TAILS).cast("int")
    everything = {
        r["tail"]: (r["tokens"], r["distinct"])
        for r in seen.groupBy(tail_key.alias("tail")).agg(F.sum("c").alias("tokens"), F.count("*").alias("distinct")).collect()
    }
    tokens, distinct = np.zeros(TAILS), np.zeros(TAILS)
    for k, (t, d) in everything.items():
        tokens[k], distinct[k] = t, d
    for r in head:
        k = tail_of(bytes(r["word"]))
        tokens[k] -= r["c"]
        distinct[k] -= 1
    return Corpus([bytes(r["word"]) for r in head], np.array([r["c"] for r in head], float), documents, tokens, distinct)


def _mean(copies: pa.Table) -> pa.Table:
    """The mean, by weight, of one chunk's copies."""
    weights, total = copies.column("weight").to_pylist(), 0.0
    for part, weight in zip(copies.column("part").to_pylist(), weights, strict=True):
        total = total + weight * np.frombuffer(part, "<f4").astype(float)
    mean = (total / sum(weights)).astype("<f4").tobytes()
    return pa.table({"at": copies.column("at").slice(0, 1), "part": pa.array([mean], pa.binary())})


def train(blocks: DataFrame, training: Column, corpus: Corpus, pilot: int = PILOT) -> np.ndarray:
    """Parameters of the network: a pilot pass, then one pass over all training documents by averaged copies."""
    layout = corpus.layout()
    spark = blocks.sparkSession

    def learner(start: np.ndarray, rate: float):
        shared = spark.sparkContext.broadcast((corpus, start))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, begin = shared.value
            net, memory, seen = Net(own.layout(), begin.copy()), {}, 0
            symbols, lot, size = own.symbols(), [], 0
            for batch in (part for whole in batches for part in cuts(whole, "text")):
                found, owner = split(batch.column("text"))
                lot += _sequences(symbols.of(found), owner, batch.num_rows)
                size += len(found) + batch.num_rows
                if size >= LANE_TOKENS:
                    net.learn(lot, memory, rate)
                    lot, size, seen = [], 0, seen + size
            if lot:
                net.learn(lot, memory, rate)
                seen += size
            if seen:
                places = range(0, len(begin), CHUNK)
                parts = [net.flat[at : at + CHUNK].astype("<f4").tobytes() for at in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, pa.int32()), pa.array(parts, pa.binary()), pa.array([float(seen)] * len(parts))], ["at", "part", "weight"]
                )

        return lambda batches: released(run(batches))

    def averaged(rows: DataFrame, start: np.ndarray, rate: float) -> np.ndarray:
        copies = rows.select("text").mapInArrow(learner(start, rate), "at int, part binary, weight double")
        out = start.copy()
        for r in copies.groupBy("at").applyInArrow(_mean, "at int, part binary").collect():  # one row for CHUNK parameters
            part = np.frombuffer(r["part"], "<f4")
            out[r["at"] : r["at"] + len(part)] = part
        return out

    rows = blocks.filter(training)
    start = layout.start(corpus.counts)
    few = rows.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(pilot).coalesce(1)
    return averaged(rows, averaged(few, start, PILOT_RATE), RATE)


def score_documents(documents: DataFrame, held_out: Column) -> DataFrame:
    """The scores of every row; rows for which held_out (a condition on doc_id) fails are learned from."""
    rows = chosen(documents, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Partitions of about a block, if all cores have one.
    parts = max(1, min(rows.rdd.getNumPartitions(), max(pieces_of(size, BLOCK_BYTES), rows.sparkSession.sparkContext.defaultParallelism)))
    pieces = pieces_of(size, parts * BLOCK_BYTES)
    block = F.spark_partition_id().cast("long") * pieces + F.pmod(F.xxhash64("doc_id"), F.lit(pieces))
    # Written once, so that a document's block stays what it is.
    blocks = kept(rows.coalesce(parts).withColumn("block", block), "blocks")
    training = ~held_out
    by_word = W.partitionBy("word").orderBy("block")
    everywhere = by_word.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = block_words(blocks, training).select(
        "block", "word", F.sum("n").over(everywhere).alias("c"), (F.row_number().over(by_word) == 1).alias("first")
    )
    counted = kept(counted, "block-words")
    corpus = gather(counted.filter("first").select("word", "c"), blocks.filter(training).count())
    flat = train(blocks, training, corpus)
    shared = blocks.sparkSession.sparkContext.broadcast((corpus, flat))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The scores as far as the head's counts and the tails' sums give them, and the other words."""
        own, parameters = shared.value
        net, symbols = Net(own.layout(), parameters), own.symbols()
        first = len(own.head) + 1
        floor = np.log10(own.tokens + own.distinct + 1.0)
        # By symbol: what a token adds to base_score, and to score beside the network's part.
        base = np.concatenate([np.log10(np.concatenate([[own.documents], own.head_counts]) + 1.0), np.zeros(TAILS)]) - floor
        inner = np.concatenate([np.zeros(first), -np.log10(own.tail_tokens + own.tail_words + 1.0)])
        lot: list[np.ndarray] = []
        rows: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            scores = net.score(lot) / np.log(10.0)
            lot.clear()
            for part in rows:
                at = part.schema.get_field_index("score")
                yield part.set_column(at, "score", pa.array(part.column(at).to_numpy() + scores[: part.num_rows]))
                scores = scores[part.num_rows :]
            rows.clear()

        size = 0
        for batch in (part for whole in batches for part in cuts(whole, "text")):
            found, owner = split(batch.column("text"))
            n, of = batch.num_rows, symbols.of(found)
            beyond = of >= first
            at = np.concatenate([[0], np.cumsum(np.bincount(owner[beyond], minlength=n))])
            rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), found.filter(pa.array(beyond))), " ")
            lot += _sequences(of, owner, n)
            size += len(found) + n
            values = {
                "n_tokens": pa.array(np.bincount(owner, minlength=n) + 1),
                "n_known": pa.array(np.bincount(owner[~beyond], minlength=n) + (own.documents > 0)),
                "base_score": pa.array(np.bincount(owner, base[of], n) + base[0]),
                "score": pa.array(np.bincount(owner, inner[of], n)),
                "rest": rest,
            }
            kept_columns = {c: batch.column(c) for c in ("block", "doc_id", "held_out")}
            rows.append(pa.RecordBatch.from_pydict({**kept_columns, **values}))
            if size >= LANE_TOKENS:
                yield from flush()
                size = 0
        yield from flush()

    def run(rows: pa.Table, table: pa.Table) -> pa.Table:
        """Adds what the words beyond the head do."""
        found, owner = split(rows.column("rest").combine_chunks())
        at = pc.index_in(found, value_set=table.column("word").combine_chunks().cast(pa.string()))
        if at.null_count:
            raise ValueError("a word of a block has no count")
        c = table.column("c").to_numpy()[at.to_numpy()]
        n, logs, own = rows.num_rows, np.log10(c + 1.0), shared.value[0]
        return pa.table({
            "doc_id": rows.column("doc_id"),
            "held_out": rows.column("held_out"),
            "n_tokens": rows.column("n_tokens"),
            "n_known": pa.array(rows.column("n_known").to_numpy() + np.bincount(owner[c > 0], minlength=n)),
            "train_tokens": pa.array([own.tokens] * n, pa.int64()),
            "base_score": pa.array(rows.column("base_score").to_numpy() + np.bincount(owner, logs, n)),
            "score": pa.array(rows.column("score").to_numpy() + np.bincount(owner, logs, n)),
        })

    kinds = "block long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest string"
    left = blocks.withColumn("held_out", held_out).mapInArrow(lambda batches: released(known(batches)), kinds).groupBy("block")
    right = counted.select("block", "word", "c")
    if corpus.head:  # words of a higher step are all in the head
        right = right.filter(F.coalesce(_step(F.col("c")), F.lit(0)) <= _step(F.lit(int(corpus.head_counts.min()))))
    return left.cogroup(right.groupBy("block")).applyInArrow(run, SCHEMA)
