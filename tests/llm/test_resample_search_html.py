"""Resampling, ranked search and page texts against plain versions."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeframe.llm import html_text, resample, search, textops

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def features(text, orders):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, items, orders, buckets, percent, least):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, orders)))
    for text in items:
        t.update(map(bucket, features(text, orders)))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text, orders)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    return Counter((*r[:4],) for r in rows), [(k + 1, *r[:4]) for k, r in enumerate(drawn)]


@pytest.mark.parametrize(("orders", "buckets", "percent"), [(1, 10000, 10), (3, 500, 40)])
def test_resample_equals_plain(spark, docs, orders, buckets, percent):
    items = ["Two words here,\nTWO lines\n\nof a test", None, "don't stop 12ab"]
    target = spark.createDataFrame([(i, x, 1) for i, x in enumerate(items)], "item_id long, text string, line long")
    got = resample.resample(docs, target, orders, buckets, percent).collect()
    rows, drawn = plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], items, orders, buckets, percent, 20)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == rows
    assert sorted((r["rank"], r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got if r["rank"] is not None) == drawn
    assert drawn


def test_resample_of_odd_tables(spark, docs, null_docs, no_docs):
    target = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert resample.resample(no_docs, target).count() == 0
    got = resample.resample(null_docs, no_docs).collect()
    assert sorted((r["doc_id"] is None, r["n_features"], r["rank"]) for r in got) == [(False, 0, None), (True, 0, None), (True, 2, None)]
    one = spark.createDataFrame([(5, "a b c d e f g h i j k l m n o p q r s t u")] * 30, "doc_id long, text string").repartition(5)
    assert sorted(r["rank"] for r in resample.resample(one, target).collect() if r["rank"] is not None) == [1, 2, 3]


def test_lines_are_counted_once(spark):
    docs = spark.createDataFrame([(i, f"The same, line\nonly {i}\n\nthe SAME line") for i in range(50)], "doc_id long, text string").repartition(4)
    rows = {bytes(r["line"]): r["times"] for r in resample.segments(docs).collect()}
    assert rows[b"the same line"] == 100
    assert len(rows) == 51


def test_checksums_and_distinct_spans(monkeypatch):
    data = b"abc" + b"x" * 200 + "é🙂".encode() + b"abc"
    buf = np.frombuffer(data, np.uint8)
    starts, ends = np.array([0, 3, 203, len(data) - 3, 1]), np.array([3, 203, len(data) - 3, len(data), 2])
    assert resample.crc32_spans(buf, starts, ends).tolist() == [zlib.crc32(data[a:z]) for a, z in zip(starts, ends, strict=True)]
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(textops, "span_hashes", lambda b, s, e: np.zeros(len(s), np.uint64))
        one, which = textops.distinct_spans(buf, starts, ends)
        assert [data[starts[one[k]] : ends[one[k]]] for k in which] == [data[a:z] for a, z in zip(starts, ends, strict=True)]
        assert len(one) == 4


def plain_search(docs, items, top, share):
    held = [(i, Counter(words_of(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(words_of(text))
    out = []
    for item, terms in asked.items():
        rows = []
        for doc, c in held:
            m = 100 - share + (share * c.total() * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2.0) / (2 * df[t] + 1.0))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "items", "bundle"), [(3, 1024, 64), (50, 2, 2)])
def test_search_equals_plain(spark, docs, texts, monkeypatch, top, items, bundle):
    monkeypatch.setattr(search, "ITEMS", items)
    monkeypatch.setattr(search, "BUNDLE", bundle)
    asked = [(i, " ".join((texts[i] or "").split()[:20])) for i in (1, 4, 7, 8, 10, 16, 18, 20, 33)] + [(10, "Two ONE three"), (77, "not-in any, text zzzz")]
    frame = spark.createDataFrame([(i, x, 0.5) for i, x in asked], "item_id long, text string, score double")
    got = search.search(docs, frame, top=top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], asked, top, 50)


def test_search_of_odd_tables(spark, docs, null_docs, no_docs):
    asked = spark.createDataFrame([(None, "some text"), (3, None)], "item_id long, text string")
    assert [tuple(r)[:3] for r in search.search(null_docs.union(docs.where("doc_id < 3")), asked).collect()] == [(None, 1, None)]
    assert search.search(no_docs, asked).count() == 0
    assert search.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_sums_are_packed_without_loss():
    rng = np.random.default_rng(3)
    for high in (1, 200, 70000, 2**40):
        sums = rng.integers(1, high + 1, (7, 400)) * (rng.random((7, 400)) < 0.1)
        assert (search.unpack(search.pack(sums), sums.shape) == sums).all()
    assert (search.unpack(search.pack(np.zeros((2, 3), np.int64)), (2, 3)) == 0).all()


PROSE = "The house of the old man is on the hill, and it was in the wind for a year before they had to leave it."

PAGES = {
    "a menu, an article and comments": (
        f"<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body class='with-sidebar'><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        f"<main><h1>On&nbsp;hills &amp; winds</h1><p>{PROSE}<p>Short.<div class='ad-box'><p>{PROSE}</p></div><p>Be <b>bold\n <i>now</b>.</p></main>"
        f"<section id='comments'><p>{PROSE}</p></section><aside><p>{PROSE}</p></aside><footer>&copy; 2020</footer></body></html>",
        f"On hills & winds\n{PROSE}\nShort.\nBe bold now.",
    ),
    "no marks at all": (f"<div><a href=1>One</a> <a href=2>Two</a></div><div><h1>Title</h1><div>{PROSE}</div><div>In short.</div><div>{PROSE}</div></div><div><a href=3>Three</a> |</div>", f"Title\n{PROSE}\nIn short.\n{PROSE}"),
    "only short blocks": ("<body><nav><a href=x>x</a></nav><article><h1>Be.</h1><p>Er. Er.</p></article><footer>no</footer>", "Be.\nEr. Er."),
    "a short page without an article": ("<body><div class=menu>Menu</div><p>Hi there.</p></body>", "Hi there."),
    "plain text": ("just 1 < 2 text &lt;b&gt;", "just 1 < 2 text <b>"),
    "markup cut at the end": (f"<article><p>{PROSE}<p>Last words</p><a hre", f"{PROSE}\nLast words"),
    "a comment that never ends": (f"<article><p>{PROSE}</p><!-- never {PROSE}", PROSE),
    "form and notice in the article": (f"<article><p>{PROSE}</p><div role='alert'>{PROSE}</div><form><p>{PROSE}</p><input></form><div class='cookieNotice'>{PROSE}</div><header class='entry-header'>Own head</header></article>", f"{PROSE}\nOwn head"),
    "hidden, line break, list": (f"<article><ul><li>One<br>two<li hidden>gone<li>three</ul><p style='display: none'>{PROSE}</p><p>{PROSE}</p></article>", f"One two\nthree\n{PROSE}"),
    "inline advert": (f"<article><p>{PROSE} <span class=ad>Buy!</span> End.</p></article>", f"{PROSE} End."),
    "whole class names": (f"<body><div class='left-sidebar'><p>{PROSE}</p></div><div class='page-header'>Site</div><div class='content has-sidebar no-comments'><p>{PROSE}</p><p>More.</p></div><div class='page-footer'><p>{PROSE}</p></div></body>", f"{PROSE}\nMore."),
    "nothing": ("<html><head><title>x</title></head><body><nav>menu</nav></body></html>", ""),
    "head without an end": (f"<head><title>x</title><meta a><p>{PROSE}</p>", PROSE),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, text = PAGES[name]
    assert html_text.main_text(page) == text


def test_open_blocks_inherit():
    link = "<p><a href=x>More of this and that</a></p>"
    page = f"<div><p>{PROSE}</p><p>near good</p></div><div>{link}<p>near bad</p>{link}</div>"
    assert html_text.main_text(page) == f"{PROSE}\nnear good"


def test_extract_of_odd_tables(spark):
    rows = [(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (None, None, None, None), (2, "v", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str) == sorted([(1, "u", "a", 1)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 40000 + "x", "<" * 200000, "<a " * 60000, '<a "' * 60000, "<p>x" * 60000, "<!--" * 50000, "&" * 200000, "</div>" * 50000, "<b>y" * 40000, "<![CDATA[" * 30000])
def test_long_odd_pages_take_linear_time(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 10
