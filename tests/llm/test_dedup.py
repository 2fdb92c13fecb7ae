"""Window, suffix and near-duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm import components, exchange, near_dedup, suffix_dedup, window_dedup
from lodeframe.llm.job import written
from lodeframe.llm.textops import arrow_bytes, same_spans, span_hashes

def sha(b):
    return hashlib.sha256(b).hexdigest()


def rows_of(texts):
    return sorted([*texts.items(), (1, texts[1])], key=lambda x: x[0])


def brute_suffix(rows, width):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(x[p : p + width] for _, x in raw for p in range(len(x) - width + 1))
    out = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - width + 1):
            if count[x[p : p + width]] > 1:
                gone[p : p + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((i, len(x), int(gone.sum()), spans, sha(bytes(b for b, g in zip(x, gone, strict=True) if not g))))
    return sorted(out)


def brute_windows(rows, width):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            if k in seen:
                gone[p : p + width] = True
            seen.add(k)
        out.append((i, len(w), int(gone.sum()), sha(b" ".join(a for a, g in zip(w, gone, strict=True) if not g))))
    return sorted(out)


@pytest.mark.parametrize("width", [200, 45])
def test_suffixes(docs, null_docs, no_docs, texts, width, monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK", 3000)  # many chunks
    got = sorted(map(tuple, suffix_dedup.dedup_suffixes(docs, width).collect()))
    assert got == brute_suffix(rows_of(texts), width)
    assert suffix_dedup.dedup_suffixes(null_docs, width).count() == 3 and suffix_dedup.dedup_suffixes(no_docs, width).count() == 0


@pytest.mark.parametrize(("heavy", "width"), [(3000, 200), (0, 200), (0, 45), (20000, 200)])
def test_heavy_buckets_are_split_by_longer_anchors(spark, monkeypatch, heavy, width):
    monkeypatch.setattr(exchange, "CHUNK", 3000)
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    r = random.Random(3)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    phrase, header = some(70), some(320)
    texts = {i: some(150) + phrase + some(180) + (header if i % 3 == 0 else "") + some(r.choice((0, 40))) for i in range(60)}
    texts |= {100 + i: header[:190] + some(100) for i in range(20)} | {200: texts[5], 201: phrase * 9, 202: "x" * 700}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffix_dedup.dedup_suffixes(df, width).collect())) == brute_suffix(list(texts.items()), width)


def test_split_keys_go_with_the_windows():
    r = random.Random(8)
    phrase = "".join(r.choice("pqrs") for _ in range(60))
    text = "".join("".join(r.choice("abc ") for _ in range(150)) + phrase + "".join(r.choice("abc ") for _ in range(150)) for _ in range(20))
    text = np.frombuffer((text + text[700:1500]).encode(), np.uint8)
    off, heavy = np.array([0, 3000, len(text)]), []
    for k in range(len(suffix_dedup.levels(200))):
        first, last, key, level = suffix_dedup.runs(text, off, 200, heavy)
        assert level.max() == k and sum(last - first + 1) == len(text) - 2 * 199
        own: dict[bytes, int] = {}
        for a, z, x in zip(first.tolist(), last.tolist(), key.tolist(), strict=True):
            for p in range(a, z + 1):
                assert own.setdefault(text[p : p + 200].tobytes(), x) == x
        heavy.append(np.unique(key[level == k])[::2])  # every second one is split
    assert len({x for x, k in zip(key, level, strict=True) if k == 3}) == len({text[p : p + 200].tobytes() for a, z, k in zip(first, last, level, strict=True) if k == 3 for p in range(a, z + 1)})


def test_suffix_texts_and_limits(spark):
    shared = "é" * 150
    df = spark.createDataFrame([(1, "a" + shared + "b"), (2, "c" + shared + "d")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.dedup_suffixes(df, 200, with_text=True).collect()}
    assert got == {1: "ab", 2: "cd"}
    with pytest.raises(ValueError):
        suffix_dedup.modulus(30)


@pytest.mark.parametrize("modulus", sorted(suffix_dedup.COVERS))
def test_covers(modulus):
    d = suffix_dedup.COVERS[modulus]
    assert {(a - b) % modulus for a in d for b in d} == set(range(modulus))


def test_windows(docs, null_docs, no_docs, texts, monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK", 3000)
    assert sorted(map(tuple, window_dedup.dedup_windows(docs).collect())) == brute_windows(rows_of(texts), 20)
    kept = {r["doc_id"]: r["text"] for r in window_dedup.dedup_windows(docs, with_text=True).filter("doc_id in (2, 6, 7)").collect()}
    assert kept[2] == "" and kept[7] == "" and kept[6] == " ".join(texts[6].split()[:30])
    assert window_dedup.dedup_windows(null_docs).count() == 3 and window_dedup.dedup_windows(no_docs).count() == 0
    assert window_dedup.levels(20) == [5, 10, 20] and window_dedup.levels(7) == [7]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True))
def test_packets(hashes):
    h = np.sort(np.array(hashes, np.uint64))
    parts = [exchange.unpack_sorted(w, d) for _, w, d, _ in exchange.packets(h, 16)]
    assert np.concatenate(parts).tolist() == h.tolist()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=30))
def test_span_hashes(strings):
    off = np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64)
    side = (np.frombuffer(b"".join(strings), np.uint8), off[:-1], off[1:])
    h = span_hashes(*side).tolist()
    assert len(set(h)) == len(set(strings)) == len(set(zip(h, strings, strict=True)))
    back = (side[0], side[1][::-1], side[2][::-1])
    assert same_spans(side, back).tolist() == [a == b for a, b in zip(strings, strings[::-1], strict=True)]


def thue_morse(n, letters="ab"):
    """Two different words of 2^n letters whose hashes by powers modulo 2^64 are equal, whatever the base."""
    w = "".join(letters[bin(i).count("1") % 2] for i in range(2**n))
    return w, w.translate(str.maketrans(letters, letters[::-1]))


def test_words_made_to_collide(spark):
    x, y = thue_morse(11)
    rest = " ".join(f"w{k}" for k in range(19))
    df = spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, f"{y} {rest}")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["n_removed"] for r in window_dedup.dedup_windows(df).collect()} == {1: 0, 2: 0, 3: 20}
    alone = spark.createDataFrame([(1, x), (2, y), (3, y)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(alone).collect()} == {1: 1, 2: 2, 3: 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\0", min_size=45, max_size=160), min_size=1, max_size=8, unique=True), st.sampled_from([21]))
def test_suffix_order_is_that_of_the_bytes(strings, v):
    raw = [x.encode() for x in strings]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    text = b"".join(raw)
    sorter = suffix_dedup.Sorter(np.frombuffer(text, np.uint8), off, v)
    at = np.concatenate([np.arange(a, z - 44) for a, z in zip(off[:-1], off[1:], strict=True)])
    suffix = {p: text[p : off[np.searchsorted(off, p, side="right")]] for p in at.tolist()}
    got = [suffix[p] for p in at[sorter.order(at)[0]].tolist()]
    assert got == sorted(got)
    count = Counter(x[:45] for x in suffix.values())
    assert sorter.repeats(at, 45).tolist() == [count[suffix[p][:45]] > 1 for p in at.tolist()]


def test_anchors_are_the_windows_own():
    r = random.Random(4)
    text = "".join(r.choice("abc ") for _ in range(3000)) + "z" * 900
    text = np.frombuffer((text + text[500:1500]).encode(), np.uint8)
    first, last, key, _ = suffix_dedup.runs(text, np.array([0, len(text)]), 200)
    assert sum(last - first + 1) == len(text) - 199 and (last - first).max() < 200
    own = {}
    for a, z, k in zip(first.tolist(), last.tolist(), key.tolist(), strict=True):
        for p in range(a, z + 1):
            assert own.setdefault(text[p : p + 200].tobytes(), k) == k


def test_one_anchor_for_very_many_runs():
    """Buckets are cut between keys only, and equal strings of one key are held once."""
    r = random.Random(5)
    middle = bytes(r.choice(b"abcdef") for _ in range(60))
    strings = [bytes(r.choice(b"xyz") for _ in range(70)) + middle + bytes(r.choice(b"uvw") for _ in range(70)) for _ in range(6)]
    strings.append(b"q" + strings[0][1:])
    table = [(7, c, np.array([1000 * c], "<i4").tobytes(), strings[c % 7]) for c in range(40)] + [(8, 50, np.array([5], "<i4").tobytes(), b"g" * 200)]
    names = ("key", "chunk", "places", "data")
    batch = lambda rows: pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in rows], pa.int64() if i < 2 else pa.binary()) for i, n in enumerate(names)})
    out = {}
    for b in suffix_dedup.sort_buckets(iter([batch(table[i : i + 3]) for i in range(0, 41, 3)]), 200, most=500):
        out |= {c: np.frombuffer(s, "<i4").tolist() for c, s in zip(b.column("chunk").to_pylist(), b.column("spans").to_pylist(), strict=True)}
    assert out == {c: [1000 * c, 1000 * c + 200] for c in range(40)}


def brute_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_similarity(x, y):
    return sum(1 / sum(max(x[h] / x[g], y[h] / y[g]) for h in set(x) | set(y)) for g in x if g in y)


def test_exact_similarity(texts):
    a, b = [texts[i] for i in (1, 4, 6, 10, 12, 6)], [texts[i] for i in (3, 5, 6, 11, 10, 4)]
    b[2] = b[2] + " " + texts[20]
    got = near_dedup.similarity(arrow_bytes(pa.array(a)), arrow_bytes(pa.array(b)))
    assert got == pytest.approx([brute_similarity(brute_sets(x), brute_sets(y)) for x, y in zip(a, b, strict=True)])


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(5)
    shared = rng.integers(1, 2**48, 400).astype(np.uint64)
    x = np.concatenate([shared, rng.integers(1, 2**48, 100).astype(np.uint64)])
    y = np.concatenate([shared, rng.integers(1, 2**48, 100).astype(np.uint64)])
    hits = []
    for salt in range(12):
        h = np.concatenate([x, y]) + np.uint64(salt << 50)
        who, has = near_dedup.signatures(np.repeat([0, 1], 500), h, np.ones(1000, np.int64), 2)
        assert has.all()
        hits.append((who[0] == who[1]).mean())
    assert np.mean(hits) == pytest.approx(400 / 600, abs=0.05)


def test_weights_rule_the_arrivals():
    h = np.arange(1, 4, dtype=np.uint64) * np.uint64(10**12)
    first = Counter()
    for salt in range(40):
        who, _ = near_dedup.signatures(np.zeros(3, np.int64), h + np.uint64(salt << 44), np.array([1, 2, 5]), 1)
        first.update(((who[0] - np.uint64(salt << 44)) // np.uint64(10**12)).tolist())
    share = np.array([first[k] for k in (1, 2, 3)]) / sum(first.values())
    assert share == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.04)


def test_classes(docs, null_docs, no_docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    sets = {i: brute_sets(t) for i, t in texts.items()}
    want = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and ((texts[i] or "") == (texts[j] or "") or brute_similarity(sets[i], sets[j]) >= 0.8):
                want[i] = min(want[i], want[j])
    assert got == want
    assert sorted(str(r["class_id"]) for r in near_dedup.classes(null_docs).collect()) in (["5", "5", "None"], ["5", "None", "None"])
    assert near_dedup.classes(no_docs).count() == 0
    kept = [r["doc_id"] for r in near_dedup.dedup(docs).collect()]
    assert sorted(kept) == sorted(i for i in texts if want[i] == i)


def test_near_copies_chain_into_one_class(spark):
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(60):
        w = list(base)
        for e in range(3):
            w[(k * 37 + e * 91) % 400] = f"edit{k}x{e}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in near_dedup.classes(df).collect()} == {0}


@pytest.mark.parametrize("together", [0, 12, 1 << 20])
def test_components(spark, together):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 21), (21, 20), (30, 30)] + [(100, i) for i in range(101, 140)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), together).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), 1), **dict.fromkeys((7, 8, 9), 7), 20: 20, 21: 20, **dict.fromkeys(range(100, 140), 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_take_few_rounds(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(components, "written", lambda df, name="part": seen.append(name) or written(df, name))
    for n in (60, 600):
        seen.clear()
        got = {r["component"] for r in components.components(spark.range(1, n).selectExpr("id - 1 AS a", "id AS b"), 5).collect()}
        assert got == {0} and seen.count("step") <= 14


def test_merged_components(spark):
    known = components.components(spark.createDataFrame([(1, 2), (5, 6), (8, 9)], "a long, b long"))
    more = spark.createDataFrame([(6, 2), (9, 30), (40, 41)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.merged(known, more).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 30: 8, 40: 40, 41: 40}


def test_bounds_hold():
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(pool, rng.integers(5, 60), p=[0.7, *[0.3 / 11] * 11])) for _ in range(50)]
    texts += [texts[0] + " " + texts[0], "one", ""]
    sets = [brute_sets(t) for t in texts]
    a, b = np.arange(0, 53, 2), np.arange(1, 53, 2)
    got = near_dedup.bounds(near_dedup.shingles(*arrow_bytes(pa.array(texts))), len(texts), a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            exact = brute_similarity(sets[x], sets[y])
            assert got[i, j] >= exact - 1e-6
            if max([*sets[x].values(), *sets[y].values(), 1]) == 1:
                assert got[i, j] == pytest.approx(exact, abs=1e-6)


def test_no_link_within_a_bucket_is_lost(spark, monkeypatch):
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(240):
        w = list(base)
        for e in r.sample(range(120), r.randint(2, 7)):
            w[e] = f"edit{k}x{e}"
        rows.append((k, " ".join(w)))
    texts = [t for _, t in rows]
    keys, _ = near_dedup.bands(*arrow_bytes(pa.array(texts)))
    sets = [set(brute_sets(t)) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and (keys[i] == keys[j]).any() and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (near_dedup.BLOCK, 16):
        monkeypatch.setattr(near_dedup, "BLOCK", size)
        got = {x["doc_id"]: x["class_id"] for x in near_dedup.classes(df).collect()}
        assert got == dict(enumerate(want))


def test_buckets_have_no_bound():
    """A bucket of a vote never stands for more than its share of bytes, and the buckets' first hashes part the range evenly."""
    for total in (0, 1 << 20, 1 << 30, 1 << 40, 100 << 40):
        assert exchange.bucket_count(total) * exchange.MOST_SHARE >= total
    assert exchange.bucket_count(1 << 40) > exchange.MANY
    for n in (1, 3, 16, 4097):
        assert exchange.edge_hashes(n).tolist() == [(b << 64) // n for b in range(n)]
