"""Event rows as shards by energy, view, subset and chunk, with a manifest by which they are trusted, reused and mended.

A shard is a folder of a partitioned table, so a read of a subset, or a join with
a plan of subsets, touches its folders alone. Which chunk a row belongs to
follows from its id and the number of chunks of its group, which the manifest
keeps: a frequent view has more chunks, none is larger than asked for by much,
and a lost shard is filled again with just its own rows. The manifest has a row a
shard (rows, and the sum of the rows' hashes) and is written last, so a table
without one was never finished.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

KEYS = ["energy", "view", "subset"]
SHARD = [*KEYS, "chunk"]


def _hash(columns: list[str]) -> Column:
    """A row's hash, as a number whose sums don't overflow."""
    return (F.xxhash64(*[F.col(f"`{c}`") for c in sorted(columns)]) % F.lit(1 << 40)).cast("decimal(38,0)")


def _assigned(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with chunk, by the groups' numbers of chunks (a row an energy, view and subset)."""
    met = rows.join(F.broadcast(groups.select(*KEYS, "chunks")), KEYS)
    return met.withColumn("chunk", F.pmod(F.xxhash64(id_col), F.col("chunks")).cast("int")).drop("chunks")


def described(rows: DataFrame) -> DataFrame:
    """A row a shard: rows and checksum."""
    own = [c for c in rows.columns if c not in SHARD]
    return rows.groupBy(*SHARD).agg(F.count(F.lit(1)).alias("rows"), F.sum(_hash(own)).cast("string").alias("checksum"))


#: Rows that a task makes of dealt ones and writes.
TASK_ROWS = 1 << 16


def write(rows: DataFrame, path: str, chunk_rows: int = 4096, id_col: str = "event_id", made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Writes ``rows`` (energy, view, subset, the id and what else they have) and gives the manifest. made: makes the rows to write of those, within their tasks, keeping energy, view, subset and chunk; so short rows are counted and dealt, and long ones never travel."""
    groups = rows.groupBy(*KEYS).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / chunk_rows)).cast("int").alias("chunks"))
    if made is not None:
        groups = written(groups, "groups")
    parts = made and max(1, math.ceil(groups.agg(F.sum("chunks")).first()[0] or 0) * chunk_rows // TASK_ROWS)
    like = _put(_assigned(rows, groups, id_col), f"{path}/rows", parts, made)
    spark = rows.sparkSession
    held = described(_rows(spark, path, like)).join(F.broadcast(groups), KEYS)
    held.write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest(spark, path)


def _put(placed: DataFrame, path: str, parts: int | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A file a shard; only the folders that rows go to are replaced. Gives the rows written."""
    dealt_ = placed.repartition(*[parts] * (parts is not None), *SHARD)
    out = made(dealt_) if made else dealt_
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SHARD).parquet(path)
    return out


def _rows(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if like is not None:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if f.name not in SHARD)
        keys = ", ".join(f"`{k}` {like.schema[k].dataType.simpleString()}" for k in KEYS)
        reader = reader.schema(f"{kinds}, {keys}, chunk int")
    return reader.parquet(f"{path}/rows")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """energy, view, subset, chunk, rows, checksum and chunks; None if the shards were never finished."""
    try:
        return spark.read.parquet(f"{path}/manifest")
    except AnalysisException:
        return None


def read(spark: SparkSession, path: str, plan: DataFrame | None = None, **only) -> DataFrame:
    """The rows of the shards whose keys have the values of ``only`` (one or a list each), or that are in a plan: a table of the shards' size with some of the keys. Where the plan is filtered, as to one step, Spark prunes folders by what is left of it when it runs."""
    df = spark.read.parquet(f"{path}/rows")
    for key, value in only.items():
        df = df.filter(F.col(key).isin(value if isinstance(value, (list, tuple)) else [value]))
    if plan is None:
        return df
    columns = df.columns
    return df.join(F.broadcast(plan), [c for c in plan.columns if c in SHARD], "left_semi").select(columns)


def damaged(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """Shards whose rows are not what the manifest says: missing, short, unreadable or changed."""
    told = manifest(spark, path)
    if told is None:
        raise ValueError("no manifest: the shards were never finished")
    found = described(_rows(spark, path, like)).select(*SHARD, F.col("rows").alias("found"), F.col("checksum").alias("sum"))
    met = told.join(found, SHARD, "left")
    return met.filter(~(F.col("rows").eqNullSafe(F.col("found")) & F.col("checksum").eqNullSafe(F.col("sum")))).select(*SHARD, "rows", F.coalesce("found", F.lit(0)).alias("found"))


def mend(spark: SparkSession, path: str, rows: Callable[[DataFrame], DataFrame] | DataFrame, id_col: str = "event_id") -> int:
    """Writes the damaged shards anew and gives their number. rows: all rows, or a function that makes those of the groups (energy, view, subset) that it is given."""
    groups = manifest(spark, path).select(*KEYS, "chunks").distinct()
    source = rows if isinstance(rows, DataFrame) else rows(groups)
    bad = [tuple(r) for r in damaged(spark, path, source).select(*SHARD).collect()]  # a row a damaged shard
    if not bad:
        return 0
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in KEYS)
    lost = spark.createDataFrame(bad, f"{kinds}, chunk int")
    wanted = lost.select(*KEYS).distinct()
    source = rows.join(F.broadcast(wanted), KEYS, "left_semi") if isinstance(rows, DataFrame) else rows(wanted)
    placed = _assigned(source, groups, id_col).join(F.broadcast(lost), SHARD, "left_semi")
    _put(placed, f"{path}/rows")
    return len(bad)


def kept_or_built(spark: SparkSession, path: str, rows: Callable[[], DataFrame], chunk_rows: int = 4096, force: bool = False, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The manifest of finished shards with at most these rows a chunk, which are made only if there are none (or if ``force``)."""
    told = None if force else manifest(spark, path)
    return told if told is not None else write(rows(), path, chunk_rows, made=made)


def dealt(rows: list[int], parts: int) -> list[int]:
    """The part of each chunk, in order: a part ends with the chunk that gives it its share of all rows, as long as each later part can still have a chunk."""
    out, part, held, share = [], 0, 0, sum(rows) / parts
    for i, n in enumerate(rows):
        out.append(part)
        held += n
        if part + 1 < parts and held >= share and len(rows) - i - 1 >= parts - part - 1:
            part, held = part + 1, 0
    return out


def packed_plan(told: DataFrame, parts: int) -> DataFrame:
    """energy, view, subset, chunk and part: the manifest's shards that have rows, dealt in order to parts of about equal rows within each energy and view. A manifest has a row a shard."""
    groups: dict[tuple, list] = {}
    for r in told.filter("rows > 0").orderBy(*SHARD).collect():
        groups.setdefault((r["energy"], r["view"]), []).append(r)
    plan = [(*[r[k] for k in SHARD], p) for held in groups.values() for r, p in zip(held, dealt([r["rows"] for r in held], parts), strict=True)]
    kinds = ", ".join(f"{k} {told.schema[k].dataType.simpleString()}" for k in SHARD)
    return told.sparkSession.createDataFrame(plan, f"{kinds}, part int")
