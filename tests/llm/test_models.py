"""Classifiers, decontamination and media columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import decontaminate, media, quality, toxicity
from lodeframe.llm.job import documents
from lodeframe.llm.lines import line_features
from lodeframe.llm.textops import arrow_bytes, span_hashes


@pytest.fixture(scope="module")
def labelled(spark):
    r, rows, labels = random.Random(1), [], []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 3 == 0
        lines = []
        for _ in range(r.randint(1, 6)):
            w = [word() for _ in range(r.randint(4, 14))]
            if toxic:
                w[r.randrange(len(w))] = r.choice(["wretch", "vermin", "wretched"])
            lines.append(" ".join(x + "###" for x in w) if bad else " ".join(w).capitalize() + ".")
        rows.append((i, "\n".join(lines), "en", None, 1.5))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert len(got) == 240
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    held = got[got["held_out"]]
    assert len(held) > 20 and (held["predicted"] == held["quality"]).mean() > 0.95


def test_quality_ignores_held_out_labels(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(docs, x).orderBy("doc_id").toPandas()["score"].to_numpy() for x in (labels, flipped))
    assert np.array_equal(a, b)


def test_quality_cases(spark, labelled, docs, null_docs, no_docs):
    _, labels = labelled
    for df, n in ((docs, docs.count()), (null_docs, 3), (no_docs, 0)):
        got = quality.classify(df, labels).toPandas()
        assert len(got) == n and got["score"].between(0, 1).all()
    empty = quality.classify(docs, labels.limit(0)).toPandas()
    assert set(empty["score"]) == {0.5}
    lines = quality.score(docs.filter("doc_id = 6"), quality.train(*labelled), with_lines=True).first()
    assert len(lines["line_good"]) == 4


def test_long_documents_equal_short_ones(monkeypatch):
    rng = np.random.default_rng(3)
    first = np.array([0, 700, 701, 2000])
    score, pair = rng.normal(size=2000) * 3, rng.normal(size=(2, 2))
    long = quality.marginals(score, pair, first)
    monkeypatch.setattr(quality, "LONG", 10**9)
    assert long == pytest.approx(quality.marginals(score, pair, first))


def test_quality_of_a_text_of_many_lines():
    rng = np.random.default_rng(3)
    began = time.time()
    assert len(quality.marginals(rng.normal(size=500_000), rng.normal(size=(2, 2)), np.array([0, 500_000]))) == 500_000
    assert time.time() - began < 20


def test_longer_lines_count_for_more(labelled):
    """A document of a good and a bad part: its score follows the part with more bytes."""
    docs, labels = labelled
    field = quality.train(docs, labels)
    rows = docs.select("doc_id", "text").join(labels, "doc_id").select("text", "quality").collect()
    good, bad = (next(r["text"] for r in rows if r["quality"] == q and len(r["text"]) > 60) for q in (1, 0))
    line = field.raw(*line_features(*arrow_bytes(pa.array([good, bad, "\n".join([good] * 8 + [bad]), "\n".join([good] + [bad] * 8)]))))
    assert line[0] > line[1] and line[2] > line[3]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 4, 4, 5, 8])
    score, pair = rng.normal(size=8) * 2, rng.normal(size=(2, 2))
    good, expected = quality.marginals(score, pair, first, True)
    want, pairs = np.zeros(8), np.zeros((2, 2))
    for a, z in zip(first[:-1], first[1:], strict=True):
        n, total, one, two = z - a, 0.0, np.zeros(z - a), np.zeros((2, 2))
        for code in range(2**n if n else 0):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(score[a + k] * y[k] for k in range(n)) + sum(pair[p, q] for p, q in zip(y, y[1:], strict=False)))
            total += w
            one += w * np.array(y)
            for p, q in zip(y, y[1:], strict=False):
                two[p, q] += w
        if n:
            want[a:z] = one / total
            pairs += two / total
    assert good == pytest.approx(want) and expected == pytest.approx(pairs)


def test_toxicity_on_unseen_rows(spark, labelled):
    docs, labels = labelled
    got = toxicity.toxicity(docs, labels.filter("doc_id % 5 <> 0")).join(labels, "doc_id").toPandas()
    held = got[got["doc_id"] % 5 == 0]
    assert (held["flagged"] == held["toxic"]).mean() > 0.95
    assert {"held_out", "p_low_quality", "p_toxic"} <= set(got.columns)
    assert got["p_low_quality"].between(0, 1).all()


def test_toxicity_equals_plain_code(spark, labelled, docs, texts):
    """Scores from the models' weights, with sets of words instead of arrays."""
    good, labels = labelled
    marks = labels.selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    models = toxicity.train(good, marks, list(toxicity.CHAIN))
    got = {r["doc_id"]: r for r in toxicity.score(documents(docs), models, list(toxicity.CHAIN)).collect()}
    number = lambda x: int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
    for i, t in texts.items():
        raw = "".join(c.lower() if c < "\x80" else c for c in t or "").encode()
        ids = set()
        for w in re.findall(rb"[a-z0-9\x80-\xff]+", raw):
            ids |= {number(w) >> 32} | {(number(w[:n]) + n & 2**64 - 1) >> 32 for n in toxicity.BEGINNINGS if len(w) >= n}
        before = []
        for model, category in zip(models, toxicity.CHAIN, strict=True):
            weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
            z = model.bias + sum(weight.get(x, 0.0) for x in ids) + sum(a * b for a, b in zip(model.extra, before, strict=True))
            before.append(1 / (1 + np.exp(-min(12, max(-12, z)))))
            assert got[i][f"p_{category}"] == pytest.approx(before[-1])
        assert got[i]["flagged"] == int(before[-1] >= 0.3)


def test_toxicity_learns_nothing_from_held_out_labels(labelled):
    docs, labels = labelled
    kept = ~quality.held_out(F.col("doc_id"))
    other = labels.withColumn("toxic", F.when(kept, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.toxicity(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
    assert a.equals(b)


def test_toxicity_cases(labelled, docs, null_docs, no_docs):
    _, labels = labelled
    for df, n in ((docs, docs.count()), (null_docs, 3), (no_docs, 0)):
        assert toxicity.toxicity(df, labels).count() == n
    none = toxicity.toxicity(docs, labels.limit(0)).toPandas()
    assert none["p_toxic"].nunique() == 1


def test_chain_uses_out_of_fold_probabilities():
    """The second category equals the first, and nothing else tells of it: the chain's weight for it must be positive."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    first = np.arange(201) * 2
    ids = np.stack([np.where(y, 7, 8), rng.integers(100, 10**6, 200)], axis=1).ravel().astype(np.uint32)
    models = toxicity.chain(ids, first, np.stack([y, y], axis=1))
    assert models[1].extra[0] > 0


def plant(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    common = [word() for _ in range(5)]
    prose = lambda n: [r.choice(common) if r.random() < 0.3 else word() for _ in range(n)]
    items = {i: prose(25) for i in range(6)}
    rows = {}
    for i in range(60):
        rows[i] = prose(120)
    exact, edited, dropped = list(items[0]), list(items[1]), [w for k, w in enumerate(items[2]) if k % 6]
    for k in range(0, 25, 5):
        edited[k] = "changed"
    rows[3][50:50] = exact
    rows[7][0:0] = edited
    rows[9] += dropped
    rows[11] = rows[11][:40] + [w.upper() + "," for w in items[3]] + ["gap"] * 80 + items[4]
    rows[13][10:10] = items[5][:6]  # too little
    docs = spark.createDataFrame([(i, " ".join(w), "x", 0.0) for i, w in rows.items()], "doc_id long, text string, item_id string, score double")
    return docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id int, text string")


def test_decontamination_finds_planted_copies(spark, monkeypatch):
    docs, items = plant(spark)
    want = {(3, 0), (7, 1), (9, 2), (11, 3), (11, 4)}
    got = decontaminate.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    exact = next(r for r in got if r["doc_id"] == 3)
    assert exact["score"] == 1.0 and text[3].encode()[exact["begin_byte"] : exact["end_byte"]].decode() == items.filter("item_id = 0").first()["text"]
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()} == want
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(text) - {3, 7, 9, 11}


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_plain_smith_waterman():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 6, n)) for n in (12, 5, 30)]
    items = decontaminate.Items([[0], [1], [2]], texts)
    words = rng.integers(0, 6, 200)
    pool = decontaminate.Batch(pa.array([" ".join(f"w{x}" for x in words)]))
    lo, hi = np.array([0, 20, 150, 90]), np.array([40, 60, 200, 95])
    item = np.array([0, 1, 2, 2])
    score, begin, end = decontaminate.align(pool.words, lo, hi, items, item)
    for k in range(4):
        own = items.words[items.first[item[k]] : items.first[item[k] + 1]].tolist()
        assert score[k] == brute_align(own, pool.words[lo[k] : hi[k]].tolist())
        assert score[k] == brute_align(own, pool.words[begin[k] : end[k]].tolist()) and lo[k] <= begin[k] <= end[k] <= hi[k]


def test_edited_copies_beside_a_whole_one(spark):
    item = [f"i{k}" for k in range(40)]
    rows = [(0, " ".join(item))]
    for d in range(1, 6):  # the first 21 words, and every third of the others is another
        rows.append((d, " ".join(w if k < 21 or (k + d) % 3 else f"x{d}y{k}" for k, w in enumerate(item))))
    rows.append((9, " ".join(item[:4] + [f"z{k}" for k in range(60)])))
    docs = spark.createDataFrame(rows[:2] + rows[-1:], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()} == {0, 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()} == set(range(6))
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [9]


def preambles(n, docs):
    """Items and documents that share a preamble; every tenth document holds half of an item's own words, too."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    start = [word() for _ in range(12)]
    items = [start + [word() for _ in range(20)] for _ in range(n)]
    texts = []
    for d in range(docs):
        own = items[d % n]
        texts.append(" ".join([word() for _ in range(30)] + (own[:26] if d % 10 == 0 else own[:12]) + [word() for _ in range(30)]))
    return [" ".join(x) for x in items], texts


def test_seeds_that_many_items_share(monkeypatch):
    items, texts = preambles(200, 60)
    items.append(items[3])
    batch = decontaminate.Batch(pa.array(texts))
    found = []
    for hot in (2, 10**9):
        monkeypatch.setattr(decontaminate, "HOT", hot)
        found.append(decontaminate.matches(batch, decontaminate.Items([[k] for k in range(len(items))], items), 0.5))
    assert {(d, d) for d in range(0, 60, 10)} <= set(zip(found[0]["doc"], found[0]["item"], strict=True))
    assert found[0].reset_index(drop=True).equals(found[1].reset_index(drop=True))


def test_preambles_stay_cheap():
    items, texts = preambles(2000, 200)
    began = time.time()
    got = decontaminate.matches(decontaminate.Batch(pa.array(texts)), decontaminate.Items([[k] for k in range(2000)], items), 0.5)
    assert set(zip(got["doc"], got["item"], strict=True)) == {(d, d) for d in range(0, 200, 10)} and time.time() - began < 20


def test_equal_items_are_each_found(spark):
    text = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, text), (2, text), (None, text), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(5, "a b " + text), (6, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in decontaminate.contaminated(docs, items).collect()) == [(5, 0), (5, 1), (5, 2)]


def test_decontamination_cases(spark, docs, null_docs, no_docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (None, "some text here and there")], "item_id long, text string")
    for df in (docs, null_docs, no_docs):
        assert decontaminate.contaminated(df, items).count() == 0
        assert decontaminate.contaminated(df, items.limit(0)).count() == 0
        assert decontaminate.clean(df, items).count() == df.count()


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(media.STEP[index])
            change = (step >> 3) + sum(step >> s for s, bit in ((2, 1), (1, 2), (0, 4)) if nibble & bit)
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_STEP[nibble])))
            out.append(value)
    return out


def test_tables_and_blocks():
    assert media.MULAW[[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert media.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    blocks = np.random.default_rng(1).integers(0, 256, (7, 64)).astype(np.uint8)
    assert media.adpcm_blocks(blocks).tolist() == [plain_adpcm(b.tolist()) for b in blocks]


def test_resampling():
    x = np.array([0, 100, -100, 7], np.int16)
    up = media.resample(x, 8000, 16000)
    assert up[::2].tolist() == x.tolist() and len(up) == 8
    assert media.resample(x, 8000, 8000).tolist() == x.tolist() and len(media.resample(x, 8000, 6000)) == 3


def test_media_digest(docs, null_docs, no_docs, texts):
    got = {r["doc_id"]: r for r in media.document_audio(docs).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        file = media.wave(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest()) and media.unwave(file) == ("mulaw", 8000, payload)
        pcm = media.resample(media.MULAW[np.frombuffer(payload, np.uint8)], 8000, media.STORED_RATE).astype(int)
        mu, al = (x[np.frombuffer(payload, np.uint8)].astype(int) for x in (media.MULAW, media.ALAW))
        ad = [x for k in range(0, len(payload), 64) for x in plain_adpcm(payload[k : k + 64])]
        law = [f"{n}={sum(map(abs, x.tolist())) // len(x)}/{sum((p < 0) != (q < 0) for p, q in zip(x[:-1].tolist(), x[1:].tolist(), strict=True))}" for n, x in (("mulaw", mu), ("alaw", al))]
        want = [*law, f"adpcm={sum(map(abs, ad)) // len(ad)}/{max(map(abs, ad))}/{ad[-1]}", f"pcm={sum(map(abs, pcm.tolist())) // len(pcm)}/{max(map(abs, pcm.tolist()))}/{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"]
        assert r["feature"] == ";".join(want)
    assert got[10]["feature"] == got[11]["feature"] != got[12]["feature"]
    assert media.document_audio(null_docs).count() == 3 and media.document_audio(no_docs).count() == 0


def test_stored_pcm_is_resampled_and_whole(docs, texts):
    """The feature is that of 16 kHz PCM, whose samples between the old ones come from the filter; packing loses nothing, whatever lies between them."""
    assert media.STORED_RATE == 16000
    got = {r["doc_id"]: r["feature"] for r in media.document_audio(docs).collect()}
    for i in (1, 7, 10, 14):
        raw = (texts[i] or "").encode()
        flat = media.MULAW[np.frombuffer(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), np.uint8)]
        x = np.pad(flat.astype(float), 16, "edge")
        w = np.array([np.sinc(k - 0.5) * np.cos(np.pi * (k - 0.5) / 32) ** 2 for k in range(-15, 17)])
        want = np.empty(2 * len(flat))
        want[::2], want[1::2] = flat, [(w * x[k + 1 : k + 33]).sum() / w.sum() for k in range(len(flat))]
        up = media.resample(flat, 8000, 16000)
        assert np.abs(up - np.clip(want, -32768, 32767)).max() <= 0.51
        assert got[i].endswith(media.pcm_feature(up.astype("<i2").tobytes())) and not got[i].endswith(media.pcm_feature(flat.astype("<i2").tobytes()))
    pcm = np.random.default_rng(3).integers(-32768, 32768, 500).astype(np.int16)
    for x, to in ((pcm, 16000), (media.resample(pcm, 8000, 16000), 16000), (pcm, 8000), (pcm, 11025), (pcm[:0], 16000)):
        assert media.unpacked(*media.packed(x, 8000, to), 8000, to).tolist() == x.tolist()
    assert media.packed(media.resample(pcm, 8000, 16000), 8000, 16000) == (pcm.astype("<i2").tobytes(), None)


def test_store_and_expand(spark):
    rows = [(1, bytes(range(256))), (2, b""), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, payload binary")
    for codec, table in (("mulaw", media.MULAW), ("alaw", media.ALAW)):
        got = {r["doc_id"]: r for r in media.expand(media.store(df, codec=codec), to_rate=8000).collect()}
        assert got[1]["pcm"] == table.astype("<i2").tobytes() and got[1]["codec"] == codec and got[2]["pcm"] == b"" == got[3]["pcm"]
    got = media.expand(media.store(df, codec="adpcm"), to_rate=8000).filter("doc_id = 1").first()
    blocks = np.arange(256, dtype=np.uint8).reshape(4, 64)
    assert got["pcm"] == media.adpcm_blocks(blocks).astype("<i2").tobytes()
    odd = spark.createDataFrame([(1, b"not a file"), (2, None)], "doc_id long, media binary")
    assert [r["pcm"] for r in media.expand(odd).collect()] == [None, None]


@pytest.mark.parametrize(("rate", "to"), [(8000, 16000), (8000, 4000), (8000, 11025), (44100, 8000)])
def test_resampling_equals_a_plain_windowed_sinc(rate, to):
    rng = np.random.default_rng(rate + to)
    x = rng.integers(-20000, 20000, 300).astype(np.int16)
    low = min(1.0, to / rate)
    reach = int(np.ceil(media.REACH / low))
    want = []
    for i in range(len(x) * to // rate):
        left, part = i * rate // to, i * rate % to / to
        near = range(left + 1 - reach, left + reach + 1)
        w = [low * np.sinc(low * (j - left - part)) * np.cos(np.pi * np.clip((j - left - part) / reach, -1, 1) / 2) ** 2 for j in near]
        want.append(sum(a * float(x[min(max(j, 0), 299)]) for a, j in zip(w, near, strict=True)) / sum(w))
    assert np.abs(media.resample(x, rate, to) - np.array(want)).max() <= 0.51
    t = np.arange(4000) / rate
    loud = lambda hertz: np.abs(media.resample((10000 * np.sin(2 * np.pi * hertz * t)).astype(np.int16), rate, to)[100:-100].astype(float)).max()
    assert loud(500) > 9000
    if to < rate:
        assert loud(0.45 * rate) < 600  # what the new rate can't hold is gone, not folded down


def plain_score(text, item):
    h = np.zeros((len(item) + 1, len(text) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(item))


def test_pairs_equal_all_alignments_insertions_included():
    rng = np.random.default_rng(12)
    items, texts = [], []
    for k in range(80):
        n = int(rng.integers(12, 45))
        item = [f"i{k}w{x}" for x in range(n)]
        edited = item.copy()
        for i in rng.integers(0, n, int(rng.integers(0, n // 6 + 1))):
            edited[i] = f"e{rng.integers(10**6)}"
        for _ in range(int(rng.integers(1, 3))):  # long insertions
            at, gap = int(rng.integers(1, len(edited))), int(rng.integers(0, n))
            edited[at:at] = [f"g{rng.integers(10**6)}" for _ in range(gap)]
        items.append(" ".join(item))
        texts.append(" ".join([f"b{x}" for x in range(int(rng.integers(0, 60)))] + edited + [f"c{x}" for x in range(30)]))
    got = decontaminate.matches(decontaminate.Batch(pa.array(texts)), decontaminate.Items([[k] for k in range(80)], items), 0.5)
    score = {(int(r.doc), int(r.item)): r.score for r in got.itertuples()}
    want = {}
    for k in range(80):
        text, item = texts[k].split(), items[k].split()
        triples = {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
        s = plain_score(text, item)
        if s >= 0.5 and any(tuple(text[i : i + 3]) in triples for i in range(len(text) - 2)):
            want[k, k] = s
    assert len(want) > 40 and score == pytest.approx(want)
