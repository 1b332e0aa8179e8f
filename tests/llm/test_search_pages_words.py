"""Operators 11 to 13 against brute force, and on awkward rows."""

import html
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from riskloom.llm import extraction, queries, retrieval, variants
from tests.llm.test_operators import AWKWARD, docs_of


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# Operator 11.
def ranked(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if t in c)
            scores.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(x for x in scores if x[0])[:k])]
    return sorted(out, key=str)


def found(docs, items, k=50):
    return sorted((tuple(r) for r in retrieval.search(docs, items, k).collect()), key=str)


def test_search_of_awkward_rows(spark, awkward, empty):
    asked = [(1, "Plain text, with ONE more id"), (1, "another sentence"), (2, None), (3, ""), (4, "é 漢字 12345"), (5, "word x"), (6, "absent"), (7, "here line"), (7, "here line")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    docs = [(r[0], r[1]) for r in AWKWARD]
    assert found(awkward, items) == ranked(docs, asked, 50)
    assert found(awkward, items, 2) == ranked(docs, asked, 2)  # ties by id, none last
    assert found(empty, items) == [] and found(awkward, items.limit(0)) == []


def test_search_in_slices_of_items(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    once = found(docs, items)
    assert once == ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    monkeypatch.setattr(retrieval, "SLICE_CHARS", 3000)
    assert found(docs, items) == once


def test_buckets_lose_nothing():
    rng = np.random.default_rng(5)
    import pyarrow as pa

    rows = [(i, sorted(rng.choice(40, rng.integers(1, 12), replace=False).tolist())) for i in range(9000)]
    value = [[int(v) for v in rng.integers(1, 50, len(at)) ** 3] for _, at in rows]
    norm = [math.sqrt(sum(v * v for v in own)) for own in value]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array(norm), pa.array([a for _, a in rows], pa.list_(pa.int32())), pa.array(value)], ["id", "norm", "at", "impact"])
    items = [rng.permutation(40)[:n] for n in (1, 3, 8, 20)]
    state = retrieval.Search(items, np.zeros(4, np.int64), 10, focus=2)
    state.read(batch)
    out = state.found().to_pydict()
    for k, own in enumerate(items):
        want = sorted(((-sum(v for a, v in zip(at, val) if a in set(own)), i) for (i, at), val in zip(rows, value)))[:10]
        assert [(-s, i) for j, i, s in zip(out["item"], out["id"], out["score"]) if j == k] == want


# Operator 12.
P = "<p>This is a real paragraph of the article with quite a few words, so its ratio of text to tags is high &amp; clear.</p>"
Q = html.unescape(P[3:-4])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("just text without any tag, but long enough", ["just text without any tag, but long enough"]),
        ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>", []),
        ("<article><p>Be.</p></article>", ["Be."]),
        (f"<nav><ul><li><a>x</a><li><a>y</a></ul><article><h1>T</h1>{P}</article>", ["T", Q]),
        (f"<form><div class=nav><a>1</a></div><article>{P}</article></form>", [Q]),
        (f"<main><h1>T</h1>{P}<form><label>Email</label><input></form><p>Short</p></main><aside>{P}</aside>", ["T", Q, "Short"]),
        (f"<table><tr><td><a>menu</a><br><a>more</a></td><td><h1>T</h1>{P}{P}</td></tr></table>", ["T", Q, Q]),
        (f"<div><a href=/>Logo</a></div><div><ul><li><a>One</a></li><li><a>Two</a></li></ul></div><div><h1>T</h1>{P}{P}<p>Short.</p>{P}</div><div><h3>Hot</h3><ul><li><a>Link</a></li></ul></div><div>&copy; 2020</div>", ["T", Q, Q, "Short.", Q]),
        (f'<body class="has-sidebar"><div class="site-header">{P}</div><div class="cookieNotice">{P}</div><div class="post"><div class="post-header"><h1>T</h1></div>{P}{P}</div><div id="comments">{P}</div><div class="sidebar">{P}</div>', ["T", Q, Q]),
        ("<article><p>a &lt; b &nbsp;\n c&amp<br>d</p><script>var x='</p>';</script><!-- e --><p>cut o<stro", ["a < b c& d", "cut o<stro"]),
        ("<![if IE]><p>" + "word " * 30 + "<![endif]>", [" ".join(["word"] * 30)]),
    ],
)
def test_page_layouts(page, want):
    assert extraction.main_text(page or "") == "\n\n".join(want)


def test_pages_table_against_its_article_elements(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = queries.QUERIES["op12_main_text"](spark, sf_dir).collect()
    assert len(out) == len(pages)
    for r in out:
        body = re.sub(r"<(/?)(p|h\d)>", "\x01", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1))
        blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"<[^>]+>", " ", body).split("\x01"))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_with_other_columns(spark):
    rows = [(1, None, "a", 3), (None, f"<article>{P}</article>", None, 4), (None, f"<article>{P}</article>", None, 4), (2, "<div>" * 3000 + "x " * 90, "b", None)]
    out = extraction.extract(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int"))
    assert out.columns == ["page_id", "html", "text", "n_chars"]
    assert [r.text for r in out.collect()] == ["", Q, Q, " ".join("x" * 90)]
    assert extraction.extract(out.limit(0)).collect() == []


# Operator 13.
def grouped(docs, ratio=10):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near, gaps = defaultdict(set), defaultdict(set)
    for w in n:
        for p in range(len(w)):
            gaps[w[:p], w[p + 1 :]].add(w)
            if (less := w[:p] + w[p + 1 :]) in n:
                near[w].add(less)
                near[less].add(w)
    for same in gaps.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f and n[f] >= ratio * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_variants_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r.word: tuple(r) for r in queries.QUERIES["op13_variants"](spark, sf_dir).collect()}
    assert out == grouped([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_and_ties_of_variants(spark, awkward, empty):
    texts = ["orantion " * 2000, "orantian " * 30, "oranthan " * 2, "orantions Orantiön orantion " * 2, None, "", "x" * 3000 + " " + "x" * 3000, "sentences sentence sentencer " * 3]
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + [(None, "orantian ÀÖÿ×÷abc " * 3, None, None)] * 2
    out = {r.word: tuple(r) for r in variants.variant_groups(docs_of(spark, rows)).collect()}
    assert out == grouped([r[:2] for r in rows])
    assert out["oranthan"][2] == "orantion"  # by way of orantian
    again = {r.word: tuple(r) for r in variants.variant_groups(awkward).collect()}
    assert again == grouped([r[:2] for r in AWKWARD])
    assert variants.variant_groups(empty).collect() == []


def test_no_near_pair_is_lost_whatever_the_dictionary(spark):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(7, 10))) for _ in range(900)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    gaps = defaultdict(set)
    want = set()
    for w in words:
        for p in range(len(w)):
            gaps[w[:p], w[p + 1 :]].add(w)
            if (less := w[:p] + w[p + 1 :]) in set(words):
                want.add(tuple(sorted((w, less))))
    want |= {(a, b) for same in gaps.values() for a in same for b in same if a < b}
    for share in (0.0, 0.01, 1.0):
        out = [tuple(sorted((r.a, r.b))) for r in variants.near_pairs(table, share).collect()]
        assert len(out) == len(set(out)) and set(out) == want
