"""Groups of documents whose sets of word n-grams overlap: an exact Jaccard join by set relations.

Two sets link when 100 * |a and b| >= 75 * |a or b|. An n-gram stands for its 64-bit hash.

1. Signatures. Each document's set is hashed to (size, digest); equal sets form a class and only classes are
   joined. A set's order puts the n-grams last whose place in a table of counts over all rows is frequent, so
   that passages shared by many documents lie outside the prefixes, however few of these documents a task holds.
2. Index. A linked pair shares an n-gram among the first n - ceil(3n/4) + 1 of both sets. Prefix entries
   (n-gram, class, position, size) go to buckets by n-gram, packed, sorted by n-gram and size.
3. Skipping in the lists. A list is cut off where the sizes differ too much, and an entry whose position
   leaves too few n-grams behind it is skipped. Lists of up to `SHORT` entries give all their pairs; from longer ones
   only neighbours are taken at first, and their entries are put aside.
4. Skipping by answers. Each class is first verified against the partner with which it shares most entries. What
   lies in one component then needs no further answer. Of the other pairs, those put aside included, only the
   pairs of partners are computed, those first whose parity sketches leave a link possible; a pair's own overlap lies within the partners' overlap plus and minus the
   known differences, and only where these bounds leave it open the pair itself is verified.
   Before the entries put aside are paired, those of other components are verified against their list's lead.
5. Components of all links give each document its group.

Steps 3 and 4 replace all pairs of a large group of near copies by a chain and by stars; no link between components is
lost, because every pair of a long list whose ends still lie in different components is looked at in step 4.

Defined cases: a null, empty or blank text has no set, links with nothing and is its own component; texts of fewer
than five words are one n-gram; repeated rows each get their row; a null id counts as larger than all others and a
component of such rows only has a null id; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostlens.llm.common import chosen, cuts, kept, pieces_of, released
from hostlens.llm.components import components

WORDS = 5
#: Longest list whose pairs are all taken at once.
SHORT = 8
#: N-grams are counted by the first bits of their hashes; places of a part that are summed together. The order made from
#: the counts decides how many candidates there are, never which pairs are found.
COUNT_BITS, COUNT_PART = 22, 1 << 14
#: Prefix entries of a bucket, and bits of the filter for the rows that verification needs.
BUCKET_ENTRIES, FILTER_BITS = 500_000, 1 << 23

#: An index entry: n-gram, class, n-grams from its position on, set size. In a bucket 32 bits of the n-gram's
#: hash tell the lists apart; lists that fall together only add candidates.
_ENTRY = np.dtype([("token", "<u4"), ("cid", "<i8"), ("rest", "<u4"), ("n", "<u4")])


def _packed(entries: np.ndarray) -> bytes:
    """Entries field by field and byte by byte, which Spark's compression shrinks well."""
    return b"".join(np.ascontiguousarray(entries[f]).view(np.uint8).reshape(len(entries), -1).T.tobytes() for f in _ENTRY.names)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out, at = np.empty(len(raw) // _ENTRY.itemsize, _ENTRY), 0
    for f in _ENTRY.names:
        width = _ENTRY[f].itemsize
        part = raw[at : at + width * len(out)].reshape(width, len(out))
        out[f], at = np.ascontiguousarray(part.T).view(_ENTRY[f])[:, 0], at + part.size
    return out


class _Hashes(dict):
    """64-bit hash of each word; a limited number is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(w))
    out = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ w[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def needed(n, m):
    """Smallest overlap of linked sets of sizes n and m: 7 * overlap >= 3 * (n + m)."""
    return -(-3 * (n + m) // 7)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity of the number of n-grams at each of at least n places (a power of two)."""
    size = max(64, 1 << (len(tokens) - 1).bit_length())
    counts = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def most_common(a: bytes, n: int, b: bytes, m: int) -> int:
    """No less than the overlap of two sets: each place where their parities differ has an n-gram of one only."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return min(n, m, (n + m - int(np.bitwise_count(x ^ y).sum())) // 2)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    for batch in batches:
        for part in cuts(batch, "text"):
            yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)


def _counted(held: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate(held) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)


def _summed(counts: pa.Table) -> pa.Table:
    """The levels of one part's places: eight steps for each doubling of their counts."""
    total = sum(np.frombuffer(zlib.decompress(c), "<u2").astype(np.int64) for c in counts.column("counts").to_pylist())
    level = np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8)
    return pa.table({"part": counts.column("part").slice(0, 1), "counts": pa.array([level.tobytes()], pa.binary())})


def frequency_levels(rows: DataFrame) -> np.ndarray:
    """How frequent the n-grams of each place are in all rows; an n-gram's place is the first COUNT_BITS of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << COUNT_BITS, np.uint32), [], 0
        for _, text in _texts(batches):
            held.append(shingles(text))
            size += len(held[-1])
            if size > 2_000_000:
                total += _counted(held).astype(np.uint32)
                held.clear()
                size = 0
        if held:
            total += _counted(held).astype(np.uint32)
        # A task's counts end at 65,535: what is so frequent comes last in any case.
        parts = [zlib.compress(p.tobytes(), 1) for p in np.split(np.minimum(total, 65_535).astype("<u2"), len(total) // COUNT_PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    counts = rows.mapInArrow(lambda batches: released(run(batches), _HASHES), "part int, counts binary")
    levels = np.zeros(1 << COUNT_BITS, np.uint8)
    for part, data in counts.groupBy("part").applyInArrow(_summed, "part int, counts binary").collect():  # 2 ** COUNT_BITS bytes in all
        levels[part * COUNT_PART : (part + 1) * COUNT_PART] = np.frombuffer(data, np.uint8)
    return levels


def signatures(rows: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, n, sig, sketch, prefix of every row; all but the first two are null for a row without words."""
    shared = rows.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        lot: list[tuple] = []

        def emit() -> pa.RecordBatch:
            columns = list(zip(*lot, strict=True))
            lot.clear()
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = ["doc_id", "n", "sig", "sketch", "prefix"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for doc_id, text in _texts(batches):
            found = shingles(text)
            n = len(found)
            if not n:
                lot.append((doc_id, 0, None, None, None))
            else:
                sig, parities = hashlib.blake2b(found.tobytes(), digest_size=16).digest(), sketch(found)
                found = found[np.argsort(level[found >> np.uint64(64 - COUNT_BITS)], kind="stable")]
                lot.append((doc_id, n, sig, parities, found[: prefix_length(n)].tobytes()))
            if len(lot) >= 1000:
                yield emit()
        if lot:
            yield emit()

    return rows.mapInArrow(lambda batches: released(run(batches), _HASHES), "doc_id long, n long, sig binary, sketch binary, prefix binary")


def _entries(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, entries: the prefixes of rows (cid, n, prefix) as packed index entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            every, bucket = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(bucket, kind="stable")
            found, starts = np.unique(bucket[order], return_index=True)
            blobs = [_packed(p) for p in np.split(every[order], starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], ["bucket", "entries"])

        size = 0
        for batch in batches:
            for cid, n, prefix in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "prefix")), strict=True):
                tokens = np.frombuffer(prefix, "<u8")
                own = np.empty(len(tokens), _ENTRY)
                own["token"], own["cid"], own["rest"], own["n"] = tokens >> np.uint64(32), cid, n - np.arange(len(tokens)), n
                held.append((own, (tokens % np.uint64(buckets)).astype(np.int64)))
                size += len(own)
                if size > 2_000_000:
                    yield emit()
                    size = 0
        if held:
            yield emit()

    return rows.select("cid", "n", "prefix").mapInArrow(run, "bucket long, entries binary")


def _reach(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether entries i and j (n[i] <= n[j]) of one list can be a linked pair's first common n-gram."""
    n, m = e["n"][i].astype(np.int64), e["n"][j].astype(np.int64)
    rest = np.minimum(e["rest"][i], e["rest"][j])
    return (4 * n >= 3 * m) & (rest >= needed(n, m)) & (e["cid"][i] != e["cid"][j])


_FOUND = "kind int, a long, b long, token long, rest long, n long"


def _found(kind: int, **columns: np.ndarray) -> pa.Table:
    size = len(next(iter(columns.values())))
    none = pa.nulls(size, pa.int64())
    values = {k: pa.array(v.astype(np.int64)) for k, v in columns.items()}
    return pa.table({"kind": pa.array(np.full(size, kind, np.int32)), **{k: values.get(k, none) for k in ("a", "b", "token", "rest", "n")}})


def _pairs_of_bucket(table: pa.Table) -> pa.Table:
    """Pairs of a bucket's lists (kind 0), and the entries of its long lists (kind 1)."""
    e = np.concatenate([_unpacked(b.as_py()) for b in table.column("entries")])
    bucket = np.int64(table.column("bucket")[0].as_py())
    e = e[np.lexsort((e["cid"], e["n"], e["token"]))]
    same = np.ones(len(e), bool)
    same[1:] = (e["token"][1:] != e["token"][:-1]) | (e["cid"][1:] != e["cid"][:-1])
    e = e[same]  # a repeated row's entries count once
    begins = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]]))
    lengths = np.diff(np.concatenate([begins, [len(e)]]))
    length = np.repeat(lengths, lengths)
    out = []
    for gap in range(1, min(SHORT, len(e))):
        i = np.flatnonzero((e["token"][gap:] == e["token"][:-gap]) & ((length[gap:] <= SHORT) | (gap == 1)))
        i = i[_reach(e, i, i + gap)]
        a, b = e["cid"][i], e["cid"][i + gap]
        out.append(_found(0, a=np.minimum(a, b), b=np.maximum(a, b)))
    far = e[length > SHORT]
    out.append(_found(1, a=far["cid"], token=bucket << 32 | far["token"].astype(np.int64), rest=far["rest"], n=far["n"]))
    return pa.concat_tables(out)


def _bit(c: Column | str) -> Column:
    """An id's place in a filter of FILTER_BITS bits."""
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def _bits(ids: DataFrame, name: str) -> np.ndarray:
    """The filter in which the places of all ids are set; its size does not depend on their number."""
    # The bitmap functions count from 1.
    marked = ids.select((_bit(name) + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )
    bits = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for part, data in marked.collect():  # FILTER_BITS bits in all
        bits[(part - 1) * 4096 : part * 4096] = np.frombuffer(data, np.uint8)
    return bits


def _is_set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(bool)


def _sets(documents: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, tokens: the sets of the wanted classes (cid), from their representatives' texts.

    A filter of fixed size keeps most other rows from being hashed; the join after it is exact.
    """
    own = classes.join(wanted, "cid", "left_semi").select("cid", "rep", "n", "sig")
    bits = _bits(own, "rep")
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _is_set(shared.value, batch.column("bit").to_numpy())
            for part in cuts(batch.filter(pa.array(hit)), "text"):
                sets = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
                sigs = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "sig", "tokens"]
                )

    rows = documents.withColumn("bit", _bit("doc_id")).mapInArrow(lambda batches: released(run(batches), _HASHES), "doc_id long, sig binary, tokens binary")
    match = rows.doc_id.eqNullSafe(own.rep) & (rows.sig == own.sig)
    return rows.join(own, match).select("cid", "tokens").dropDuplicates(["cid"])


@F.arrow_udf(T.LongType())
def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """Common n-grams of two sorted sets."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
        if len(x) > len(y):
            x, y = y, x
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out.append(int((y[at] == x).sum()))
    return pa.array(out, pa.int64())


@F.arrow_udf(T.LongType())
def _most_common(a: pa.Array, n: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
    return pa.array([most_common(*x) for x in zip(a.to_pylist(), n.to_pylist(), b.to_pylist(), m.to_pylist(), strict=True)], pa.int64())


def _verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, their sizes a_n and b_n, and bounds low and high of their overlap. For pairs whose sketches leave a link
    possible both are the overlap itself; the others' sets are not looked at."""
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    bounded = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    bounded = bounded.select("a", "b", "a_n", "b_n", _most_common("a_sketch", "a_n", "b_sketch", "b_n").alias("high"))
    bounded = kept(bounded, "sketched")
    possible = F.col("high") * 7 >= (F.col("a_n") + F.col("b_n")) * 3
    out = bounded.filter(~possible).withColumn("low", F.lit(0).cast("long"))
    pairs = bounded.filter(possible)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = kept(_sets(documents, classes, wanted), "sets")
    side = lambda c: sets.select(F.col("cid").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    both = pairs.drop("high").join(side("a"), "a").join(side("b"), "b")
    exact = both.select("a", "b", "a_n", "b_n", _overlap("a_tokens", "b_tokens").alias("high"))
    return kept(out.unionByName(exact.withColumn("low", F.col("high"))), "overlaps")


def _linked() -> Column:
    return F.col("low") * 7 >= (F.col("a_n") + F.col("b_n")) * 3


def _marked(df: DataFrame, label: DataFrame, *columns: str) -> DataFrame:
    """df with c_label, the component of each class column c."""
    for c in columns:
        own = label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        df = df.join(own, c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    return df


def _several(far: DataFrame) -> DataFrame:
    """The entries of those long lists whose classes lie in more than one component."""
    lists = far.groupBy("token").agg(F.min("a_label").alias("low"), F.max("a_label").alias("high")).filter("low < high")
    return kept(far.join(lists.select("token"), "token", "left_semi"), "several")


def _within_reach(n: str, m: str, rest: Column) -> Column:
    """Whether two entries of one list, with sizes n and m, can be a linked pair's first common n-gram."""
    n, m = F.col(n), F.col(m)
    return (n * 4 >= m * 3) & (m * 4 >= n * 3) & (rest * 7 >= (n + m) * 3)


def _to_leads(far: DataFrame) -> DataFrame:
    """a, b: a lead of each long list with the list's entries of other components.

    The lead is of the component that has most entries in the list, and of those the one whose position leaves most.
    """
    parts = far.groupBy("token", "a_label").agg(
        F.count("*").alias("many"), F.max_by(F.struct("a", "rest", "n"), F.struct("rest", -F.col("a"))).alias("lead")
    )
    leads = parts.groupBy("token").agg(F.max_by(F.struct("lead.*", "a_label"), F.struct("many", -F.col("a_label"))).alias("lead"))
    leads = leads.select("token", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("a", "a_label", "rest", "n")])
    return far.join(leads, "token").filter(
        (F.col("a_label") != F.col("lead_a_label")) & _within_reach("n", "lead_n", F.least("rest", "lead_rest"))
    ).select(F.least("a", "lead_a").alias("a"), F.greatest("a", "lead_a").alias("b")).distinct()


def _crossing(far: DataFrame) -> DataFrame:
    """a, b: pairs of the long lists within reach whose ends lie in different components."""
    left, right = (far.select("token", *[F.col(c).alias(f"{s}{c}") for c in ("a", "a_label", "rest", "n")]) for s in "lr")
    return left.join(right, "token").filter(
        (F.col("la") < F.col("ra")) & (F.col("la_label") != F.col("ra_label")) & _within_reach("ln", "rn", F.least("lrest", "rrest"))
    ).select(F.col("la").alias("a"), F.col("ra").alias("b")).distinct()


def _settled(open_: DataFrame, first: DataFrame, documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The links among the pairs open_, by their partners' answers where those suffice."""
    # A class's verified partner answers for it, up to the n-grams in which the two differ.
    near = first.filter("linked").select(
        F.col("b").alias("own"), F.col("a").alias("lead"), (F.col("b_n") - F.col("low")).alias("more"), (F.col("a_n") - F.col("low")).alias("less")
    )
    for c in ("a", "b"):
        own = near.select(*[F.col(x).alias(c if x == "own" else f"{c}_{x}") for x in near.columns])
        open_ = open_.join(own, c, "left").withColumns({
            f"{c}_lead": F.coalesce(f"{c}_lead", c), f"{c}_more": F.coalesce(f"{c}_more", F.lit(0)), f"{c}_less": F.coalesce(f"{c}_less", F.lit(0)),
        })
    size = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"{c}_n"))
    lifted = kept(open_.join(size("a"), "a").join(size("b"), "b"), "lifted")
    ends = [F.least("a_lead", "b_lead").alias("a"), F.greatest("a_lead", "b_lead").alias("b")]
    leaders = kept(lifted.select(*ends).distinct(), "leaders")
    answers = _verified(leaders, documents, classes).select(F.col("a").alias("x"), F.col("b").alias("y"), "low", "high")
    bounded = lifted.withColumns({"x": ends[0], "y": ends[1]}).join(answers, ["x", "y"]).withColumns({
        "low": F.col("low") - F.col("a_less") - F.col("b_less"),
        "high": F.col("high") + F.col("a_more") + F.col("b_more"),
    })
    need = (F.col("a_n") + F.col("b_n")) * 3
    decided = kept(bounded.withColumn("answer", F.when(F.col("low") * 7 >= need, 1).when(F.col("high") * 7 < need, 0)), "bounded")
    links = decided.filter("answer = 1").select("a", "b")
    undecided = kept(decided.filter("answer is null").select("a", "b"), "undecided")
    if not undecided.isEmpty():
        checked = _verified(undecided, documents, classes)
        links = links.unionByName(checked.filter(_linked()).select("a", "b"))
    return links


def class_links(documents: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """a, b: links whose components are those of all links."""
    pairs = kept(found.filter("kind = 0").groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs")
    # Each class with its best partner of smaller number.
    best = kept(pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"), "best")
    first = _verified(best, documents, classes).withColumn("linked", _linked())
    links = first.filter("linked").select("a", "b")
    label = components(links)
    # The other pairs of short lists and of neighbours, then those of the long lists: each time only
    # pairs whose ends do not lie in one component yet.
    apart = _marked(pairs.select("a", "b"), label, "a", "b").filter("a_label != b_label").select("a", "b")
    open_ = kept(apart.join(best, ["a", "b"], "left_anti"), "open")
    if not open_.isEmpty():
        links = kept(links.unionByName(_settled(open_, first, documents, classes)), "links")
        label = components(links)
    far = _several(kept(_marked(found.filter("kind = 1").select("token", "a", "rest", "n"), label, "a"), "far"))
    # Entries meet their list's lead before they meet each other, as long as that joins at least an eighth of those tried:
    # a large group of near copies then is one component, and nothing inside it is left to pair.
    joining = not far.isEmpty()
    while joining:
        tried = _verified(_to_leads(far), documents, classes).withColumn("linked", _linked())
        met, joined = tried.agg(F.count("*"), F.count_if("linked")).first()
        if joined:
            links = kept(links.unionByName(tried.filter("linked").select("a", "b")), "links")
            far = _several(_marked(far.drop("a_label"), components(links), "a"))
        joining = joined > 0 and 8 * joined >= met and not far.isEmpty()
    open_ = kept(_crossing(far).join(pairs, ["a", "b"], "left_anti"), "open")
    if not open_.isEmpty():
        links = links.unionByName(_settled(open_, first, documents, classes))
    return links


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; class_size counts the rows with an equal set."""
    rows = chosen(documents, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    signed = kept(signatures(rows, frequency_levels(rows)), "signed")
    grouped = signed.filter("n > 0").groupBy("n", "sig").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("class_size"), F.first("sketch").alias("sketch")
    )
    classes = kept(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = signed.agg(F.sum(F.octet_length("prefix")) / 8).first()[0] or 0
    same = signed.doc_id.eqNullSafe(classes.rep) & (signed.sig == classes.sig)
    prefixes = signed.join(classes.select("cid", "rep", "sig"), same).select("cid", "n", "prefix")
    entries = _entries(prefixes, pieces_of(int(total), BUCKET_ENTRIES))
    found = kept(entries.groupBy("bucket").applyInArrow(_pairs_of_bucket, _FOUND), "found")
    links = class_links(rows, classes, found)
    label = components(links)
    whole = classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    members = whole.join(smallest, "label").select("n", "sig", "component_id", "class_size")
    joined = signed.select("doc_id", "n", "sig").join(members, ["n", "sig"], "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay: the one with the smallest id of each component, with all columns.

    Of repeated rows with that id one stays; so does one row of a component without ids. Most rows stay: those
    whose ids are not in a filter of the ids to look at (which go, or occur several times) are passed on where they
    are, and only the others' texts are shuffled to be joined with the ids that stay.
    """
    found = kept(groups(documents).select("doc_id", "component_id"), "components")
    own = F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("n")
    ids = kept(found.groupBy("doc_id").agg(own, F.count("*").alias("rows")), "ids")
    shared = documents.sparkSession.sparkContext.broadcast(_bits(ids.filter("n != 1 or rows > 1"), "doc_id"))

    @F.arrow_udf(T.BooleanType())
    def open_(places: pa.Array) -> pa.Array:
        return pa.array(_is_set(shared.value, places.to_numpy()))

    names = documents.columns
    whole = documents.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    passed, looked_at = whole.filter(~open_(_bit("id"))), whole.filter(open_(_bit("id")))
    single, several = ids.filter("n = 1"), ids.filter("n > 1")
    keep = looked_at.join(single, looked_at.id.eqNullSafe(single.doc_id), "left_semi")
    again = looked_at.join(several, looked_at.id.eqNullSafe(several.doc_id), "left_semi").dropDuplicates(["id"])
    return passed.unionByName(keep).unionByName(again).select("row.*")
