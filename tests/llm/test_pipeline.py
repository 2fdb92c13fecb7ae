"""The pipeline's stages on a small corpus, each held against a plain version of its decision."""

import random
import re

import pytest

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    item, passage = prose(30), prose(60)
    rows = []
    for i in range(120):
        w = prose(150)
        if i % 10 == 3:
            text = " ".join(x + "###" for x in w)
        elif i in (20, 21, 22):
            text = " ".join([*rows[0][1].split()[:-1], f"end{i}."]) if i < 22 else rows[0][1]
        elif i in (30, 31):
            text = " ".join(w[:70] + passage + w[70:]).capitalize() + "."
        elif i == 40:
            text = " ".join(w[:50] + item + w[50:]).capitalize() + "."
        else:
            text = " ".join(w).capitalize() + "."
        rows.append((i, text, "en", "s", len(text)))
    rows.append((500, None, None, None, None))
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), dict((x[0], x[1]) for x in rows), " ".join(passage)


def test_stages(spark, corpus):
    import corpus_pipeline as pipeline

    top, texts, passage = corpus
    docs, seen = spark.read.parquet(f"{top}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        before = docs.columns
        docs = pipeline.written(stage(spark, docs, top), name)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == before
    ids = {n: {x["doc_id"] for x in d.collect()} for n, d in seen.items()}
    assert ids["quality_classifier"] == {i for i in texts if i % 10 != 3}
    assert ids["near_dedup"] == ids["quality_classifier"] - {20, 21, 22}
    assert ids["suffix_dedup"] == ids["near_dedup"]
    left = {x["doc_id"]: x for x in seen["suffix_dedup"].collect()}
    for i in ids["suffix_dedup"]:
        if texts[i] is None:
            assert left[i]["text"] is None and left[i]["n_chars"] is None
            continue
        want = texts[i].replace(" " + passage + " ", "") if i in (30, 31) else texts[i]
        assert left[i]["text"] == want and left[i]["n_chars"] == len(want), i
    assert ids["decontamination"] == ids["suffix_dedup"] - {40}
    pieces = seen["best_fit_packing"].collect()
    assert {x["doc_id"] for x in pieces} == ids["decontamination"]
    fill = {}
    for x in pieces:
        fill[x["sequence_id"]] = fill.get(x["sequence_id"], 0) + x["length"]
    assert max(fill.values()) <= 1024


def test_stages_on_odd_tables(spark, corpus, docs, null_docs, no_docs):
    import corpus_pipeline as pipeline

    top = corpus[0]
    for df in (docs, null_docs, no_docs):
        for name, stage in pipeline.STAGES:
            df = pipeline.written(stage(spark, df, top), name)
        assert df.count() >= 0


def test_rows_keep_their_numbers(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline

    texts = {i: f"text {i} " + "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(40)) for i in range(40)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n_chars", pipeline.F.length("text").cast("long")).repartition(8).write.parquet(f"{tmp_path}/t")
    docs, old, dedup = spark.read.parquet(f"{tmp_path}/t"), spark.conf.get("spark.sql.files.maxPartitionBytes"), pipeline.suffix_dedup.dedup_suffixes

    def then_other_splits(*args, **kwargs):
        out = pipeline.written(dedup(*args, **kwargs))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return out

    monkeypatch.setattr(pipeline.suffix_dedup, "dedup_suffixes", then_other_splits)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        got = {r["doc_id"]: r["text"] for r in pipeline.suffix_dedup_stage(spark, docs, "").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == texts


def test_names():
    import corpus_pipeline as pipeline

    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None
    assert all(re.fullmatch(r"[a-z_]+", n) for n, _ in pipeline.STAGES)
