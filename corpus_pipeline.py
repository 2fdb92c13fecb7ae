"""The corpus pipeline: quality classifier, near-dedup, suffix-array dedup, decontamination, packing.

Each stage works on all documents that its predecessor kept. Stages that filter
pass all columns on; the dedup of passages replaces ``text`` by what it kept and
``n_chars`` by its length, and keeps a document even if nothing of it is left.
Where a removed passage cuts a character in two, its other bytes go, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import decontaminate, near_dedup, packing, quality, suffix_dedup
from lodeframe.llm.job import documents, table, tune, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    tune(spark)
    return quality.reject(docs, quality.train(documents(docs), table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dedup.dedup(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 200 bytes go. Rows are told apart by numbers that are written with them."""
    tune(spark)
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")  # numbers follow the splits of a scan, so they are given once
    kept = suffix_dedup.dedup_suffixes(numbered, with_text=True, id_col="__row").select(F.col("doc_id").alias("__row"), F.col("text").alias("__kept"))
    text = F.when(F.col("text").isNotNull(), F.col("__kept"))
    changed = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
    rest = numbered.withColumn("text", F.when(F.col("text").isNotNull(), F.lit("")))  # what is left of the texts comes from ``kept``
    return rest.join(kept, "__row").select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages can't be written in SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
