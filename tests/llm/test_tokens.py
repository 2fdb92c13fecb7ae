"""Token ids, files, packing and counts against plain versions."""

import base64
import bisect
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodeframe.llm import bpe, packing, token_count, token_files
from lodeframe.llm.textops import arrow_bytes

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(tokenizer, texts):
    odd = ["a  b", "   x", "é,à 'S 's's x's", "tab\t\tx \n y", "١٢٣ abc12é3", "×÷é×é", "\x1c a", "it''s '", "A.B c.'s", "…", "\r\n\r\nx", "   "]
    both = [t for t in texts.values() if t and "<|endoftext|>" not in t] + odd
    for batch in (both, [texts[16], "x"], ["", ""]):
        ids, first = bpe.encoder(PATH).encode(*arrow_bytes(pa.array(batch)))
        for t, a, z in zip(batch, first[:-1], first[1:], strict=True):
            assert ids[a:z].tolist() == plain_ids(tokenizer, t), t[:40]


def test_encoder_forgets(tokenizer, texts, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    e = bpe.Encoder(PATH)
    for i in range(20, 40):
        ids, _ = e.encode(*arrow_bytes(pa.array([texts[i]])))
        assert ids.tolist() == plain_ids(tokenizer, texts[i])


@pytest.mark.parametrize("n", [0, 1, 5, 16384, 40001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, 50256)
    found, count = np.unique(np.append(ids, 7), return_counts=True)
    table = token_files.Table.of_counts(found, count)
    data = token_files.encode(ids, table)
    assert token_files.decode(data, table).tolist() == ids.tolist()
    if n > 20000:
        assert token_files.decode(data, table, 1, 2).tolist() == ids[16384:32768].tolist()
        broken = bytearray(data)
        broken[-3] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            token_files.decode(bytes(broken), table)


def test_token_files(tokenizer, docs, null_docs, no_docs, texts):
    got = token_files.round_trip(docs, PATH).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(got, sorted([*texts.items(), (1, texts[1])], key=lambda x: x[0]), strict=True):
        ids = np.array([*plain_ids(tokenizer, t), 0], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [r["doc_id"] for r in token_files.round_trip(null_docs, PATH).orderBy("start").collect()] == [None, None, 5]
    assert token_files.round_trip(no_docs, PATH).count() == 0


def brute_bins(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        room = rooms.pop(i) if i < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


def test_plan_equals_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 64, 1024):
        for _ in range(20):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 300)).tolist()
            counts = {n: lengths.count(n) for n in set(lengths)}
            assert packing.plan(counts, capacity)[1] == brute_bins(lengths, capacity)


def test_packing(tokenizer, docs, null_docs, no_docs, texts):
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], tuple(r["ids"])))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] <= 1024
    for places in by_bin.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 1024
    for i, t in texts.items():
        whole = [x for _, _, ids in sorted(by_doc[i]) for x in ids]
        assert whole == [*plain_ids(tokenizer, t), 2]
    assert len(by_bin) == brute_bins([r["length"] for r in rows], 1024)
    assert packing.pack(null_docs, PATH).count() == 3 and packing.pack(no_docs, PATH).count() == 0


def test_token_counts(docs, null_docs, no_docs, texts):
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        vocabulary = {base64.b64decode(line.split()[0]) for line in f}
    longest = max(map(len, vocabulary))

    def count(text):
        n, words = 0, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        for w in words:
            w = b" " + w
            while w:
                k = next(k for k in range(min(longest, len(w)), 0, -1) if w[:k] in vocabulary)
                w, n = w[k:], n + 1
        return len(words), n

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_count.token_counts(docs, path).collect()}
    assert got == {i: count(t) for i, t in texts.items()}
    assert token_count.token_counts(null_docs, path).count() == 3 and token_count.token_counts(no_docs, path).count() == 0
    with pytest.raises(ValueError):
        token_count.Automaton([b"a", b"ab"])


def thue_morse(n):
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(2**n))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_with_one_hash(spark, tokenizer, monkeypatch):
    """Two words of one batch, first with hashes by powers, then with any hash made alike."""
    x, y = thue_morse(10)
    column = pa.array([x, y, "q " + y])
    for _ in range(2):
        ids, first = bpe.Encoder(PATH).encode(*arrow_bytes(column))
        assert [ids[a:z].tolist() for a, z in zip(first[:-1], first[1:], strict=True)] == [plain_ids(tokenizer, t) for t in column.to_pylist()]
        monkeypatch.setattr(bpe, "span_hashes", lambda buf, starts, ends: (ends - starts).astype(np.uint64))
    path = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(0, x), (1, y)], "doc_id long, text string").coalesce(1)
    want = [token_count.Automaton(token_count.read_vocabulary(path)).count(b" " + t.encode()) for t in (x, y)]
    assert [r["n_tokens"] for r in token_count.token_counts(df, path).orderBy("doc_id").collect()] == want


def test_very_long_words():
    automaton = token_count.Automaton(token_count.read_vocabulary(P.path("byte_bpe_50k.tiktoken")))
    buf = np.random.default_rng(1).choice(np.frombuffer(b"abcdefgh0123456789+/", np.uint8), 3_000_000)
    began = time.time()
    n = automaton.counts(buf, np.array([0, 0]), np.array([len(buf), 200]))
    assert time.time() - began < 20 and 0 < n[1] <= 200 < n[0]
    assert n[1] == automaton.count(b" " + buf[:200].tobytes())
