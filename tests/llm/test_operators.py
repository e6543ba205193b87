"""The operators against plain versions, libraries and edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hostlens.llm import components, exact_dedup, html_text, jaccard, language, lm_scores, packing, pieces, quality, token_counts, top_k
from hostlens.llm.common import fold
from hostlens.llm.gated_net import Layout, Net
from hostlens.llm.oracle import LLM_ORACLE
from hostlens.llm.queries import LLM_QUERIES
from oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.001"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")

# Nulls, empties, blanks, repeated rows, ties, a long text, foreign scripts; clashing further columns.
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(40))
TEXTS = [
    (1, "a b c d e f g"), (2, "A  b\tc d e f g"), (3, None), (4, ""), (5, " \n "), (6, "日本語 テキスト"), (7, "1234 !!"),
    (8, LONG), (9, LONG + " tail"), (10, "one two"), (11, "one two"), (11, "one two"), (None, "one two"), (None, None),
    (12, BASE), (13, BASE + " x"), (14, BASE + " x y z"), (15, "<|endoftext|> s </s>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if t else None, "s", i, True, 0.5, "k", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, block string, n int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id < -1")


def _plain(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_against_sql(spark, name):
    assert differences(spark, connect(FOLDER), name, LLM_QUERIES[name], LLM_ORACLE[name], FOLDER) == []


def test_exact_dedup_edges(odd, none):
    rows = exact_dedup.deduplicate(odd).collect()
    assert len(rows) == len(TEXTS)
    two = [r for r in rows if r.keep_id == 10]
    assert len(two) == 4 and sum(r.kept for r in two) == 1 and {r.group_size for r in two} == {4}
    empty = [r for r in rows if r.keep_id == 3]
    assert {r.doc_id for r in empty} == {3, 4, None} and sum(r.kept for r in empty) == 1
    assert exact_dedup.deduplicate(none).count() == 0
    left = exact_dedup.distinct_documents(odd)
    assert left.columns == odd.columns and left.count() == sum(r.kept for r in rows)


def test_exact_dedup_heavy_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    heavy = [r for r in exact_dedup.deduplicate(docs, 0.01).filter("group_size > 1").collect()]
    assert len(heavy) == 1000 and {r.keep_id for r in heavy} == {0} and sum(r.kept for r in heavy) == 1


def test_exact_dedup_shuffles_no_frequent_rows(spark):
    """Rows of a frequent digest come through without a shuffle; repeated rows of its kept id are still told apart."""
    text = F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string"))
    docs = spark.range(2000).select(F.when(F.col("id") < 10, 0).otherwise(F.col("id")).alias("doc_id"), text.alias("text"))
    found = exact_dedup.deduplicate(docs, 0.01)
    rows = [r for r in found.collect() if r.group_size > 1]
    assert len(rows) == 1000 and {r.keep_id for r in rows} == {0} and sum(r.kept for r in rows) == 1
    whole = found._jdf.queryExecution().optimizedPlan()

    def in_place(plan, above):
        """Whether some scan of all rows reaches the result without an aggregate."""
        name = plan.nodeName()
        if name in ("Aggregate", "Generate"):
            return False
        kids = plan.children()
        if kids.isEmpty():
            return "doc_id" in plan.output().mkString(",")
        return any(in_place(kids.apply(i), name) for i in range(1 if name == "Join" else kids.size()))

    assert in_place(whole, "")


def test_token_counts(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(token_counts.count_tokens(odd, chunk=500, overlap=4).collect(), key=str)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in TEXTS), key=str)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and token_counts.count_tokens(none).count() == 0


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_splices(path):
    encoder, r = token_counts.model(path), random.Random(3)
    letters = "aabbcdeeethinothe  \n\t'ésß日本🙂▁0123456789.,<>"
    for text in ["a" * 4000, "ab" * 2000, " " * 3000, *("".join(r.choice(letters) for _ in range(3000)) for _ in range(5))]:
        assert token_counts.encode_long(text, encoder, 300, 8) == encoder.ids(text)


def test_pieces_equal_library():
    model, library, r = pieces.pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(5)
    letters = "aabbcdeeethinothe  \n\t'ésß日本é🙂▁0123456789.,<>s/x0ABCDE"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 300, "na" * 300, " " * 77, "the" * 333, "", " ", "▁▁"]
    for text, (ids, shown) in zip(texts, model.encode_all(texts), strict=True):
        assert ids == library.encode(text) + [2] and shown == " ".join(map(str, ids))
    words = list({w for t in texts for w in t.split() if len(w) < 30})
    assert model.many(words) == [model.word(w) for w in words]


def test_pieces_words():
    """Words of a batch against the plain pattern, with marks in the text, at both ends and alone."""
    r, letters = random.Random(8), "ab▁▁ é漢"
    texts = ["", "▁", "▁▁▁", "a"] + ["".join(r.choices(letters, k=r.randrange(30))) for _ in range(300)]
    marked = [t.replace(" ", "▁") for t in texts]
    words, begins = pieces.split_words(marked)
    plain = [re.findall("▁*[^▁]+|▁+", t) for t in marked]
    assert words.to_pylist() == [w for ws in plain for w in ws]
    assert np.diff(begins).tolist() == [len(ws) for ws in plain]


def test_pieces_pairs_share_places():
    """Answers do not depend on what the table of pairs holds."""
    model, r = pieces.pieces(PIECES), random.Random(9)
    ids = sorted(model.rank)
    left, right = (np.array(r.choices(ids, k=4000), np.int64) for _ in range(2))
    plain = [model._compatible(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    for _ in range(2):
        assert model._compatible_many(left, right).tolist() == plain
    model.table[:] = -1
    assert model._compatible_many(left, right).tolist() == plain


def test_pieces_edges(odd, none):
    rows = pieces.encode_documents(odd, with_ids=True).collect()
    assert len(rows) == len(TEXTS) and all(len(r.ids) == r.n_tokens for r in rows)
    assert {r.decoded for r in rows} == {t or "" for _, t in TEXTS}  # a round trip
    assert pieces.encode_documents(none).count() == 0


def test_packing(odd, none):
    library = Tokenizer.from_file(BYTES)
    rows = packing.pack_documents(odd, length=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length == 1 << r.bucket <= 64 for r in rows)
    for i, text in TEXTS:
        if i in (11, None):
            continue
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in own] == [0, *itertools.accumulate(r.length for r in own)][:-1]
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(ids) for r in own)
    assert packing.pack_documents(none).count() == 0 and packing.decompose(2048 * 2 + 5) == [2048, 2048, 4, 1]


@pytest.mark.parametrize("space", [" ", "\n", " \t\r\n", "\x85"])
def test_packing_long_white_space(space):
    library = Tokenizer.from_file(BYTES)
    for n in (packing.SPACE_RUN - 5, 1_200_000):
        text = "a word" + space * (n // len(space)) + "and more"
        assert packing.encode([text], BYTES)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_long_white_space_rows(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_200_000 + "b"), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n, r.total) for r in packing.report(packing.pack_documents(docs)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total")).collect()}
    assert got[1] == (1_200_002, 1_200_002) and got[2] == (2, 2)


def _groups(texts):
    sets = []
    for _, t in texts:
        w = _plain(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    out = []
    for i, (doc_id, _) in enumerate(texts):
        ids = [texts[k][0] for k in range(len(texts)) if label[k] == label[i] and texts[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return Counter(out)


def test_jaccard(spark, odd, none):
    assert Counter(map(tuple, jaccard.groups(odd).drop("class_size").collect())) == _groups(TEXTS)
    r, texts = random.Random(9), []
    for group in range(12):
        words = [f"g{group}w{r.randint(0, 500)}" for _ in range(r.randint(8, 60))]
        shared = [f"common{k}" for k in range(20)] if group % 2 else []
        for _ in range(r.choice([1, 3, 25])):
            own = list(words)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = f"e{r.randint(0, 10**6)}"
            texts.append((len(texts), " ".join(own + shared)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, jaccard.groups(docs).drop("class_size").collect())) == _groups(texts)
    assert jaccard.groups(none).count() == 0 and jaccard.one_of_each(odd).columns == odd.columns


def test_jaccard_large_group(spark, monkeypatch):
    """One base with few to many words replaced: some links, a large component, and many texts that fall short."""
    r, texts = random.Random(4), []
    base = [f"w{i}" for i in range(70)]
    for _ in range(400):
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            own[r.randrange(len(own))] = f"e{r.randint(0, 10**6)}"
        texts.append((len(texts), " ".join(own)))
    tried, crossing = [], jaccard._crossing
    monkeypatch.setattr(jaccard, "_crossing", lambda far: tried.append(out := crossing(far)) or out)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, jaccard.groups(docs).drop("class_size").collect())) == _groups(texts)
    assert tried[0].count() < 10 * len(texts)


def test_jaccard_passage_rare_within_tasks(spark, monkeypatch):
    """A passage that each of many tasks sees a few times only lies outside the prefixes: no list grows with the number of tasks."""
    r, passage = random.Random(9), " ".join(f"p{k}" for k in range(40))
    texts = [(i, " ".join(f"u{i}x{k}" for k in range(r.randint(100, 140))) + " " + passage) for i in range(160)]
    found, pairs_of = [], jaccard._entries
    monkeypatch.setattr(jaccard, "_entries", lambda rows, buckets: found.append(rows) or pairs_of(rows, buckets))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(32)
    assert Counter(map(tuple, jaccard.groups(docs).drop("class_size").collect())) == _groups(texts)
    shared = set(jaccard.shingles(passage).tolist())
    prefixes = [np.frombuffer(x["prefix"], "<u8").tolist() for x in found[0].collect()]
    assert len(prefixes) == len(texts) and not any(shared & set(p) for p in prefixes)


@pytest.mark.parametrize("at_once", [0, 30, 1000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "TASK_EDGES", at_once)
    rng = np.random.default_rng(5)
    chain = rng.permutation(60)
    edges = [*zip(chain[:-1], chain[1:], strict=True), *((100 + i, 99) for i in range(1, 20)), *rng.integers(200, 300, (50, 2)), (7, 7)]
    edges = [(int(a), int(b)) for a, b in edges]
    smallest = {x: x for e in edges for x in e}
    while any(smallest[a] != smallest[b] for a, b in edges):
        for a, b in edges:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {x: found.get(x, x) for x in smallest} == smallest
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_bounds_overlap():
    r = np.random.default_rng(1)
    for n, m in ((5, 9), (100, 130), (700, 64)):
        pool = r.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = np.unique(r.choice(pool, n)), np.unique(r.choice(pool, m))
        assert jaccard.most_common(jaccard.sketch(a), len(a), jaccard.sketch(b), len(b)) >= len(np.intersect1d(a, b))


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(i, [((i * k) % 7 - 3) / 5 for k in range(1, 5)]) for i in range(230)] + [(300, None), (400, [nan, 1.0, 0.0, 0.0]), (500, [None, 1.0]), (600, [0.5]), (None, [1.0])]
    got = top_k.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    ints = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and None not in v and not any(x != x for x in v)}
    for q in (0, 100, 200, 600):
        dots = sorted((-sum(x * y for x, y in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == dots
    assert len(got) == 40


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.train(docs, ~held_out)
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.97 * len(found)
    by = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert {by[i].lang_pred for i in (3, 4, 5, 7)} == {"und"} and by[7].score == 0
    assert {r.lang_pred for r in language.identify(odd, language.train(none)).collect()} == {"und"}


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.train(docs, labels, ~held_out)
    assert model.pairs
    found = quality.classify(docs, model).join(labels.select("doc_id", "quality"), "doc_id").filter(held_out).collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in quality.classify(odd, model).collect())
    assert {r.score for r in quality.classify(odd, quality.train(none, labels)).collect()} == {0.5}


def test_html():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
      <div class="cookie-notice">We use cookies on this page, please accept them now or leave this page at once.</div>
      <article><h1>Title &amp; more</h1><p>First   para.<p>Second<br>para <b>bold.<div class="ad">Buy now</div><p>Von.</article>
      <section id="comments"><p>Nice article, I liked it very much indeed, thank you for writing it down for us.</p></section><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\nFirst para.\nSecond para bold.\nVon."
    body = "<div>menu</div>" + "<p>" + "Long text of an article that has no marks. " * 5 + "</p><p>Short.</p>" + "<footer>no</footer><div>x</div>"
    assert html_text.main_text(body).endswith("Short.")
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("plain") == "plain"


@pytest.mark.parametrize(
    "page, want",
    [
        ('<h1>T</h1><svg class="i" /><p>rest of page</p>', "T\nrest of page"),
        ('<script src="a.js" /><h1>T</h1><object data="x"/><p>rest</p>', "T\nrest"),
        ("<p>A <svg-icon name='x'></svg-icon>b</p><p>rest</p>", "A b\nrest"),
        ("<title-bar>Bar</title-bar><select-menu></select-menu><style-guide></style-guide><template-x></template-x><p>rest</p>", "Bar\nrest"),
        ("<p>sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is</p><math/><p>rest</p>", "sum x+y is\nrest"),
        ("<p>a</p><object data=x><p>b</p><iframe src=x><p>c</p><iframe src=y>no frames</iframe><p>d</p>", "a\nb\nc\nd"),
        ("<p>a</p><noscript><p>no</p><p>script</p></noscript><svg><svg></svg><text>no</text></svg><p>b</p><script>var x = '<p>';", "a\nb"),
    ],
)
def test_html_embedded_parts_end(page, want):
    assert html_text.main_text(page) == want


PARA = "A long paragraph of the article, with a good many words and without any link in it at all. "


@pytest.mark.parametrize(
    "page, want",
    [
        *(
            (f'<body><div class="{menu}"><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div><div><h2>T</h2><p>{PARA}</p></div>', f"T\n{PARA.strip()}")
            for menu in ("main-menu", "main-nav", "main-header", "main menu")
        ),
        ('<article><p>Text of it.</p><div class="main-menu"><a href=a>Home</a></div><p>More.</p></article><div class="main-nav"><a href=a>Home</a></div>', "Text of it.\nMore."),
        *(
            (f'<div id="content" class="{name}"><p>{PARA}</p><p>End.</p></div>', f"{PARA.strip()}\nEnd.")
            for name in ("no-sidebar", "has-sidebar", "comments-open", "share-enabled", "post sidebar", "social")
        ),
        ('<article><h2 id="search">Search</h2><p id="cookies">Text.</p><h2 class="page-header">On menus</h2><p>See <a href="/p?id=menu">menus</a>.</p></article>', "Search\nText.\nOn menus\nSee menus."),
        (f'<article><p>{PARA}</p><div class="ad-slot">Buy now</div><div class="cookie-banner">Accept</div><div id="sidebar-2">x</div></article>', PARA.strip()),
        (f'<div id="nav">x</div><div role="main"><p>Text.</p></div><div><p>{PARA}</p></div>', "Text."),
    ],
)
def test_html_names_of_parts(page, want):
    assert html_text.main_text(page) == want


LINKS = "<ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a><li><a href=d>Four</a></ul>"
MENU = f'<div class="nav">{LINKS}</div>'


@pytest.mark.parametrize("body", ["{}", '<div class="content">{}</div>', '<div><div class="x">{}</div></div>'])
@pytest.mark.parametrize(
    "flow, want",
    [
        ("<h1>T</h1><p>By me</p><p>Monday</p><p>Noon</p><p>{p}</p>", "T\nBy me\nMonday\nNoon\n{p}"),
        ("<h1><a href=x>T</a></h1><p>By <a href=x>me</a></p><div class=share>x</div><p>Monday</p><p>Rome</p><p>{p}</p>", "T\nBy me\nMonday\nRome\n{p}"),
        ("<p>{p}</p><div class=ad>Buy</div><p>Short end.</p>", "{p}\nShort end."),
        ("<p>{p}</p><aside>Buy</aside><div class=ad>Buy</div><h2>H</h2><p>Short.</p><form>f</form><p>End.</p>", "{p}\nH\nShort.\nEnd."),
        ("<p>{p}</p>{links}<p>Short end.</p>", "{p}\nOne\nTwo\nThree\nFour\nShort end."),
    ],
)
def test_html_ends_of_text(body, flow, want):
    page = "<body>" + MENU + body.format(flow.format(p=PARA, links=LINKS)) + f"<footer>Imprint</footer>{LINKS}</body>"
    assert html_text.main_text(page) == want.format(p=PARA.strip())


def test_html_links_of_text():
    flow = f"<p>{PARA}</p><div class=ad>Buy</div>{LINKS}"
    page = f'<body>{MENU}<div class="content">{flow}</div><div class="bottom">{LINKS}</div></body>'
    assert html_text.main_text(page) == f"{PARA.strip()}\nOne\nTwo\nThree\nFour"


def test_html_table(spark):
    rows = [(1, "u", "<p>x</p>", 1), (1, "u", "<p>x</p>", 1), (None, None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert Counter((r.text, r.n_chars) for r in got) == Counter({("x", 1): 2, ("", 0): 1})


def test_net_gradient_and_carried_state():
    layout = Layout(np.array([0, 1, 1, 2, 2, 2, 3]), 4)
    flat, r = layout.start(np.ones(7)), np.random.default_rng(0)
    net, docs = Net(layout, flat), [r.integers(0, 7, k) for k in (9, 5, 3, 7, 2)]
    target, _, inputs, keep = next(net._windows(docs, 5, 16))
    h = np.zeros((5, 16), np.float32)
    gradient = net._gradient(h, target, inputs, keep)[1]
    for j in r.choice(layout.size, 25, replace=False):
        value, loss = flat[j], []
        for step in (0.01, -0.01):
            flat[j] = value + step
            loss.append(-net._gradient(h, target, inputs, keep)[2].sum())
        flat[j] = value
        assert abs((loss[0] - loss[1]) / 0.02 - gradient[j]) < 0.02 * max(1, abs(gradient[j]))
    long = r.integers(0, 7, 400)
    assert np.allclose(net.score([long, *docs])[1:], net.score(docs), atol=1e-3)
    # All symbols' probabilities add up to one, after any beginning.
    total = sum(np.exp(net.score([np.append(long, s)])[0] - net.score([long])[0]) for s in range(7))
    assert abs(total - 1) < 1e-3


def test_lm_scores(spark, odd, none):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    counts = Counter(w for r in rows if not held[r.doc_id] for w in [*_plain(r.text), b"\0end"])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm_scores.score_documents(docs, fold(F.col("doc_id"), 7) == 2).collect()}
    for r in rows:
        tokens = [*_plain(r.text), b"\0end"]
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(g.base_score - base) < 1e-6 * abs(base)
    assert sum(g.score for g in got.values() if g.held_out) > sum(g.base_score for g in got.values() if g.held_out)
    assert lm_scores.score_documents(odd, F.col("doc_id") % 2 == 5).count() == len(TEXTS)
    assert lm_scores.score_documents(none, F.lit(False)).count() == 0


def test_lm_head_grows_with_vocabulary(spark, monkeypatch):
    """Every word seen more than once is a symbol of the network, or as many as HEAD has room for."""
    rows = [(f"w{i}".encode(), 2 + i % 5) for i in range(3000)] + [(f"once{i}".encode(), 1) for i in range(50)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    corpus = lm_scores.gather(counts, 10)
    assert len(corpus.head) == 3000 and corpus.tail_tokens.sum() == corpus.tail_words.sum() == 50
    assert corpus.tokens == sum(c for _, c in rows) + 10 and corpus.distinct == len(rows) + 1
    layout = corpus.layout()
    assert len(layout.class_of) == 1 + 3000 + lm_scores.TAILS and max(map(len, layout.members)) < 500
    monkeypatch.setattr(lm_scores, "HEAD", 900)
    few = lm_scores.gather(counts, 10)
    assert 800 < len(few.head) < 1000 and set(few.head_counts[:600]) == {6} and set(few.head_counts[600:]) == {5}
    assert (few.tokens, few.distinct) == (corpus.tokens, corpus.distinct)
    assert few.symbols()[few.head[0]] == 1 and few.symbols()[b"never seen"] > len(few.head)


def test_lm_words_and_symbols():
    """The words of many texts at once are those of each text; symbols too, also of a slice and of words of one byte."""
    texts = ["", None, " a  B\x0b\x0cc\x1c\x85 d \n", "\t \n", "Ärger É x ÄRGER", "one two\xa0three " * 3]
    found, owner = lm_scores.split(pa.array(texts))
    assert list(zip(owner, (w.encode() for w in found.to_pylist()))) == [(i, w) for i, t in enumerate(texts) for w in lm_scores.words(t)]
    symbols = lm_scores.Symbols([b"one", b"c\x1c\xc2\x85"], 3)
    known = {b"one": 1, b"c\x1c\xc2\x85": 2}
    want = [known.get(w, 3 + lm_scores.tail_of(w)) for t in texts for w in lm_scores.words(t)]
    assert symbols.of(found).tolist() == want and symbols.of(found.slice(2, 5)).tolist() == want[2:7]


def test_lm_scores_send_no_texts(spark):
    """Only the words beyond the head, and a block's words with their counts, go to another task."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = lm_scores.score_documents(docs, fold(F.col("doc_id"), 7) == 2)._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1:
        plan = plan.children().apply(0)
    sides = [plan.children().apply(i).output().mkString(" ") for i in (0, 1)]
    assert "rest#" in sides[0] and not any("text#" in side for side in sides)


def test_net_follows_the_plain_recurrence():
    """Scores are those of one step after another, symbol by symbol; long documents do not make many small windows."""
    layout, r = Layout(np.repeat(np.arange(9), [1, 3, 2, 5, 1, 4, 1, 2, 6]), 9), np.random.default_rng(3)
    net = Net(layout, layout.start(r.integers(1, 50, 25).astype(float)))
    net.flat += r.normal(0, 0.5, layout.size).astype(np.float32)
    p, docs = {k: v.astype(float) for k, v in net.p.items()}, [r.integers(0, 25, k) for k in (700, 1, 40, 3)]

    def chosen(h, weights, at):
        z = weights @ np.append(h, 1.0)
        return z[at] - np.log(np.exp(z).sum())

    for doc, score in zip(docs, net.score(docs)):
        h, total, before = np.zeros(16), 0.0, 25
        for symbol in doc:
            xg, hg = p["emb"][before] @ p["wx"] + p["b"], h @ p["wh"]
            gate = 1 / (1 + np.exp(-(xg[:32] + hg[:32])))
            new = np.tanh(xg[32:] + gate[:16] * hg[32:])
            h, before = new + gate[16:] * (h - new), symbol
            c, g = layout.class_of[symbol], layout.group_of[layout.class_of[symbol]]
            classes, members = np.flatnonzero(layout.group_of == g), layout.members[c]
            total += chosen(h, p["wg"], g) + chosen(h, p["wc"][classes], c - classes[0]) + chosen(h, p["ww"][members], symbol - members[0])
        assert abs(total - score) < 1e-3 * abs(total)
    assert len(list(net._windows([r.integers(0, 25, 20_000), *docs], 5, 32, 8192))) <= 4


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, FOLDER)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        if name == "exact_dedup":
            plain = {}
            for r in sorted(before.collect(), key=lambda r: r.doc_id):
                plain.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
            assert sorted(r.doc_id for r in rows) == sorted(plain.values())
        if name == "near_dedup":
            want = {i for i, _, c in _groups([(r.doc_id, r.text) for r in before.collect()]) if i == c}
            assert {r.doc_id for r in rows} == want
        kept = spark.createDataFrame(rows, docs.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stayed = {r.doc_id for r in rows}
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == stayed
    assert sum(labels.get(i) == 0 for i in stayed) <= 0.1 * max(1, sum(q == 0 for q in labels.values()))
