"""Fill-in-the-middle, importance resampling and the URL filter against plain versions and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import fill_middle, resampling, url_filter

LONG = "".join(f"línea {i} of 日本 text\n" for i in range(9_000))
TEXTS = [
    (1, "a\nb\nc"), (2, "a\n"), (3, None), (4, ""), (5, "\n\n\n"), (6, "日本\n語"), (7, "has <S> inside"), (8, LONG), (9, LONG + "no end"),
    (10, "one line"), (11, "same\ntext\nhere"), (11, "same\ntext\nhere"), (None, "no\nid"), (None, None), (12, "x<P\n<S\n>M>"), (13, "é" * 70_000),
    (14, " ".join(f"word{i % 50}" for i in range(60))), (15, " ".join(f"Word{i % 50}" for i in range(60))), (16, "ſ K word " * 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 5, True, 0.5, 7, 1, 2, 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, form string, units long, marked boolean, score double, weight int, part int, rank int, row int")


def _drawn(seed, doc_id):
    return hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()


def _plain_middle(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(_drawn(7, doc_id)[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("frame", [4, 7, 1000, fill_middle.FRAME])
def test_fill_middle_against_a_plain_version(odd, frame):
    docs = odd if frame >= 1000 else odd.filter(F.coalesce(F.length("text"), F.lit(0)) < 1000)
    stored = fill_middle.store(docs, frame)
    wanted, texts = Counter(), Counter()
    for i, t in ((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()):
        n, form, p, m, out = _plain_middle(i, t)
        wanted[(i, n, form, p, m, _sha(out), _sha(t or ""))] += 1
        texts[(i, form, out)] += 1
    assert Counter(tuple(r) for r in fill_middle.report(stored).collect()) == wanted
    assert Counter(tuple(r) for r in fill_middle.outputs(stored).collect()) == texts


def test_fill_middle_rates(odd):
    stored = fill_middle.store(odd)
    rows = fill_middle.outputs(stored, rate=40, spm_rate=0).collect()
    assert Counter((r.doc_id, r.form, r.output) for r in rows) == Counter(
        (i, f, o) for i, t in TEXTS for _, f, _, _, o in [_plain_middle(i, t, 40, 0)]
    )
    assert {r.form for r in rows} == {"plain", "psm"}


def test_fill_middle_opens_only_the_frames_of_the_cuts(monkeypatch, odd):
    row = fill_middle.store(odd.filter("doc_id = 8"), 1000).collect()[0].asDict()
    text, opened = fill_middle.Framed(row), []
    real = fill_middle.Framed.frame
    monkeypatch.setattr(fill_middle.Framed, "frame", lambda self, i: (opened.append(i), real(self, i))[1])
    data = LONG.encode()
    for unit in (1, 17, 4000, 8999):
        opened.clear()
        at, chars = text.cut(unit)
        assert data[:at].count(b"\n") == unit and data[at - 1 : at] == b"\n" and len(data[:at].decode()) == chars
        assert len(opened) == 1
    opened.clear()
    assert b"".join(text.read(2500, 4100)) == data[2500:4100] and len(opened) == 3


def test_fill_middle_frames_are_independent(odd):
    import zstandard

    row = fill_middle.store(odd.filter("doc_id = 9"), 5000).collect()[0]
    ends = np.cumsum(row["sizes"])
    for i in random.Random(1).sample(range(len(ends)), 5):
        data = bytes(row.frames)[ends[i] - row["sizes"][i] : ends[i]]
        piece = zstandard.ZstdDecompressor().decompress(data).decode()
        assert (len(piece), piece.count("\n"), len(piece.encode())) == (row.chars[i], row.lines[i], row.bytes[i])


def test_fill_middle_empty_table(odd):
    none = fill_middle.store(odd.filter("doc_id < 0"))
    assert fill_middle.report(none).count() == 0 and fill_middle.outputs(none).count() == 0
    with pytest.raises(ValueError):
        fill_middle.store(odd, 3)


def _features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def _plain_resampling(docs, target, n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, _features(text, n)[1]))
    for text in target:
        t.update(map(bucket, _features(text, n)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        words, found = _features(text, n)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(_drawn(2024, i)[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    cut = percent * len(fit) // 100
    return Counter([(*r[:4], k + 1 if k < cut else None) for k, r in enumerate(fit)] + [(*r[:4], None) for r in rows if not r[4]])


@pytest.mark.parametrize("n,buckets,percent", [(1, 10_000, 10), (1, 10_000, 60), (2, 997, 50), (3, 64, 100)])
def test_resampling_against_a_plain_version(spark, odd, n, buckets, percent):
    target = ["word1 word2 line of text", None, "", "Word1 日本"]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    rows = resampling.resample(odd, bench, n, buckets, percent).collect()
    assert Counter(tuple(r) for r in rows) == _plain_resampling(TEXTS, target, n, buckets, percent, 20)


def test_resampling_ranks_over_many_partitions(spark):
    """Ranks run on without gaps over partitions, also when a third of all rows are one repeated row."""
    scored = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 90).alias("score"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = resampling.ranked(resampling.kept(scored, "test"), 5_000).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    drawn = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert len(rows) == 9_000 and [r["rank"] for r in drawn] == list(range(1, 5_001))
    keys = [(-r.score, r.doc_id) for r in drawn]
    assert keys == sorted(keys) and keys == sorted((-r.score, r.doc_id) for r in rows)[:5_000]


def test_resampling_empty_tables(spark, odd):
    bench = spark.createDataFrame([("word1",)], "text string")
    assert resampling.resample(odd.filter("doc_id < 0"), bench).count() == 0
    none = resampling.resample(odd, bench.filter("text = ''")).collect()
    assert Counter(tuple(r) for r in none) == _plain_resampling(TEXTS, [], 1, 10_000, 10, 20)


def test_sliced_sums_and_windows():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (9, 130)).astype(np.int32)
    counts[4, 7], counts[5] = 2**30, 0
    gain = rng.integers(-9_000, 9_000, 130)
    up, down = resampling.planes(np.maximum(gain, 0)[None])[:, 0], resampling.planes(np.maximum(-gain, 0)[None])[:, 0]
    assert (resampling.sliced_sums(counts, up, down) == counts.astype(np.int64) @ gain).all()
    data = "Ab 12-é x,yz  wort\n".encode() * 50
    whole = sorted(np.concatenate([b for _, b in resampling._buckets(data, 3, 997)]))
    for size in (1, 5, 64):
        parts = list(resampling._buckets(data, 3, 997, size))
        assert sorted(np.concatenate([b for _, b in parts])) == whole and sum(w for w, _ in parts) == 300


def _plain_judge(pages, rules, rounds, damping):
    facts = []
    for page_id, url, html in pages:
        cut = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
        host, path = (lower(cut[1]), cut[2]) if cut else ("", "")
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
        links = {lower(x) for x in re.findall(url_filter.LINK, html or "")} - {host} if host else set()
        facts.append((page_id, host, path, best, links))
    pages_of, edges = defaultdict(list), Counter()
    for _, host, _, best, links in facts:
        pages_of[host].append(best and best[2])
        edges.update((host, x) for x in links)
    hosts = set(pages_of) | {x for e in edges for x in e}
    final = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        arcs = [((a, b) if kind == "trust" else (b, a), w) for (a, b), w in edges.items()]
        total = Counter()
        for (a, _), w in arcs:
            total[a] += w
        seed = {h: pages_of[h].count(verdict) * 10**9 // len(pages_of[h]) if pages_of[h] else 0 for h in hosts}
        score = dict(seed)
        for _ in range(rounds):
            after = {h: seed[h] * (100 - damping) // 100 for h in hosts}
            for (a, b), w in arcs:
                after[b] += score[a] * w * damping // (total[a] * 100)
            score = after
        final[kind] = score
    by_host = {h: "block" if final["distrust"][h] > final["trust"][h] else "allow" for h in hosts}
    rows = Counter((p, h, q, b and b[0] + b[1], b[2] if b else by_host[h]) for p, h, q, b, _ in facts)
    return rows, {h: (final["trust"][h], final["distrust"][h]) for h in hosts}


def _link(*hosts):
    return "<p>x<a href='/own'>o</a>" + "".join(f'<A class="b"\n HREF = "https://{h}/p?q">t</A>' for h in hosts)


PAGES = [
    (1, "https://Good.example.org/a", _link("friend.example.net", "www.friend2.example.net:80")),
    (2, "http://a.example.org/es/x", _link("lost.net")), (3, "http://a.example.org/en/12#top", None), (4, "http://a.example.org", ""),
    (5, "http://farm.net/x", _link("bad.example.com", "bad.example.com", "farm.net")), (6, "http://bad.example.com/de/1", _link("farm.net")),
    (7, "http://bad.example.com/en/1", None), (8, "http://far.net/1", _link("farm.net")), (9, "http://friend.example.net/z", _link("third.net")),
    (10, "http://third.net", _link("single.net")), (11, None, _link("bad.example.com")), (12, "nothing here", _link("bad.example.com")), (12, "://", None),
    (13, "https://fr.com/fr/1", "<a href=//third.net>x"), (13, "https://fr.com/fr/1", "<a href=//third.net>x"), (None, "ftp://user@h.org:21/x?y", "<a "*9),
    (14, "http://example.org/es", None), (15, "http://notexample.org/es/1", None), (16, "http://single.net?x://y.org/", "<abbr href='//z.net'><a data-href='//w.net'>"),
    (17, "http://www.friend2.example.net:80/a\nb", _link("Lost.NET")),
]


@pytest.fixture(scope="module")
def web(spark):
    rows = [(i, u, h, "x", "y", "allow", 3, 1) for i, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string, verdict string, pages int, part int")


@pytest.mark.parametrize("rounds,damping", [(20, 85), (3, 50), (0, 85)])
def test_url_filter_against_a_plain_version(web, rounds, damping):
    wanted, scores = _plain_judge(PAGES, url_filter.RULES, rounds, damping)
    assert Counter(tuple(r) for r in url_filter.judge(web, rounds=rounds, damping=damping).collect()) == wanted
    found = url_filter.propagated(url_filter.kept(url_filter.page_facts(web), "test"), rounds, damping).collect()
    assert {r.host: (r.trust, r.distrust) for r in found} == scores
    if rounds == 20:
        # Whoever links to a blocked host is blocked, whoever a trusted one links to is allowed.
        verdicts = {(r[1], r[4]) for r in wanted}
        assert {("farm.net", "block"), ("far.net", "block"), ("friend.example.net", "allow"), ("", "allow")} <= verdicts


def test_url_filter_hubs_and_hot_hosts(spark, monkeypatch):
    """One host with a third of all pages and of all edges: same rows; neither is dealt out by its name alone."""
    rng = random.Random(5)
    pages = []
    for i in range(900):
        host = "hub.net" if i % 3 == 0 else f"h{rng.randrange(200)}.{rng.choice(['org', 'com', 'net'])}"
        path = rng.choice(["/es/", "/de/1", "/fr/1", "/en/1"])
        pages.append((i, f"http://{host}{path}", _link(*(f"h{rng.randrange(200)}.{rng.choice(['org', 'com', 'net'])}" for _ in range(3)))))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    wanted, scores = _plain_judge(pages, url_filter.RULES, 4, 85)
    for split in (1000, 20, 2):
        monkeypatch.setattr(url_filter, "SPLIT", split)
        assert Counter(tuple(r) for r in url_filter.judge(table, rounds=4).collect()) == wanted
        facts = url_filter.kept(url_filter.page_facts(table), "test")
        assert {r.host: (r.trust, r.distrust) for r in url_filter.propagated(facts, 4).collect()} == scores
        flows, _ = url_filter._flows(facts)
        parts = flows.filter("at = 'hub.net' and kind = 'trust'").select("part").distinct().count()
        assert (parts > 1) == (split > 2)


def test_url_filter_longest_rule_and_empty_table(spark, web):
    rules = (("net", "/ab", "allow"), ("a.net", "/", "block"), ("b.a.net", "/", "allow"), ("c.net", "/", "allow"), ("c.net", "/", "block"))
    pages = [(1, "x://a.net/ab", None), (2, "x://b.a.net/ab", None), (3, "x://c.net/", None), (4, "x://xa.net/ab", None), (5, "x://a.net", None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(table, rules).collect()}
    assert found[1] == ("a.net/", "block") and found[2] == ("b.a.net/", "allow") and found[3] == ("c.net/", "block")
    assert found[4] == ("net/ab", "allow") and found[5][0] is None
    assert url_filter.judge(web.filter("page_id < 0")).count() == 0
    assert Counter(tuple(r) for r in url_filter.judge(web, ()).collect()) == _plain_judge(PAGES, (), 20, 85)[0]


def test_url_filter_runs_no_python(web):
    plan = url_filter.judge(web)._jdf.queryExecution().toString()
    facts = url_filter.page_facts(web)._jdf.queryExecution().toString()
    assert "Python" not in plan + facts and "Arrow" not in plan + facts
