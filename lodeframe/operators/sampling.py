"""Thinning, subsampling, subsets and splits that depend on row keys alone, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import random


def units(counts: DataFrame, n: str) -> DataFrame:
    """A row ``unit`` (from 1) for each counted unit."""
    return counts.filter(F.col(n) > 0).withColumn("unit", F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))


def thin_without_replacement(counts: DataFrame, n: str, keep: Column, order: Column, *keys: str) -> DataFrame:
    """``keep`` units of each group of keys, the first by ``order`` (of unit and columns): rows with their new count ``kept``."""
    ids = [c for c in counts.columns if c != n]
    w = Window.partitionBy(*keys).orderBy(order, *[c for c in ids if c not in keys], "unit")
    chosen = units(counts, n).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)
    return counts.join(chosen.groupBy(*ids).agg(F.count(F.lit(1)).alias("kept")), ids, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


#: Expected units, on the rarer side, from which on a binomial number is a rounded normal one.
MANY = 2000


def binomial(n: Column, p: float, id: Column, salt: int = 0) -> Column:
    """How many of n units stay with probability p each: the steps of the distribution below one uniform number of the row's id. Of many units a rounded normal number between 0 and n."""
    rare = min(p, 1 - p)  # the side on which the first probability doesn't vanish
    u = random.uniform(id, salt)
    size = F.greatest(n, F.lit(0)).cast("long")
    few = F.least(size, F.lit(int(MANY / max(rare, 1e-9))))
    if rare <= 0:
        return size if p >= 1 else F.lit(0).cast("long")
    first = F.exp(few * math.log1p(-rare))
    start = F.struct(F.lit(0).cast("long").alias("k"), first.alias("p"), first.alias("below"))

    def step(s: Column, k: Column) -> Column:
        q = s["p"] * (few - k + 1) / k * (rare / (1 - rare))
        return F.struct((s["k"] + (u >= s["below"]).cast("int")).alias("k"), q.alias("p"), (s["below"] + q).alias("below"))

    steps = F.least(few, F.ceil(few * rare + 12 * F.sqrt(few * rare * (1 - rare)) + 12).cast("long"))
    counted = F.when(few > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1))), start, step, lambda s: s["k"])).otherwise(0)
    wide = F.greatest(F.lit(0), F.least(size, F.round(size * rare + F.sqrt(size * rare * (1 - rare)) * random.normal(id, salt + 1)).cast("long")))
    of_rare = F.when(size * rare <= MANY / 3, counted).otherwise(wide)
    return of_rare if p <= 0.5 else size - of_rare


def thin_binomial(counts: DataFrame, n: str, p: float, id: Column) -> DataFrame:
    """Each unit stays with probability p: a binomial number for each row, from a uniform number of its id. No row is made for a unit."""
    return counts.withColumn("kept", binomial(F.col(n), p, id))


def thin_expected(counts: DataFrame, n: str, wanted: DataFrame, key: str, total: str) -> DataFrame:
    """Counts times wanted total over own total, by key."""
    own = counts.groupBy(key).agg(F.sum(n).alias("__own"))
    share = wanted.join(own, key).select(key, F.when(F.col("__own") > 0, F.col(total) / F.col("__own")).otherwise(0.0).alias("__share"))
    return counts.join(share, key).withColumn("expected", F.col(n) * F.col("__share")).drop("__share")


#: Parts of the range of random numbers by which rows are counted before any are ranked.
PARTS = 4096


def first_of_each(df: DataFrame, number: Column, id: str, wanted: Column, *keys: str) -> DataFrame:
    """The ``wanted`` (of ``n``, the group's rows) rows of each group with the smallest numbers in (0, 1), ties by id.

    Rows are counted by parts of the range first. Parts before the last one go
    in whole, and only the last part's rows are ranked, so no task ranks a group.
    """
    d = df.withColumn("__u", number).withColumn("__part", F.least(F.floor(F.col("__u") * PARTS), F.lit(PARTS - 1)))
    size = d.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__size"))
    w = Window.partitionBy(*keys)
    size = size.withColumn("n", F.sum("__size").over(w)).withColumn("__before", F.sum("__size").over(w.orderBy("__part")) - F.col("__size"))
    size = size.withColumn("__left", wanted - F.col("__before")).filter("__left > 0").drop("n", "__before")
    met = d.join(size, [*keys, "__part"])
    whole = met.filter("__left >= __size")
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__u", id))
    part = met.filter("__left < __size").withColumn("__place", place).filter("__place <= __left").drop("__place")
    return whole.unionByName(part).select(*df.columns)


def sample_rows(df: DataFrame, fraction: float, id: str, *keys: str) -> DataFrame:
    """max(1, floor(n * fraction)) rows of each group, the first by a hash of the id."""
    return first_of_each(df, random.uniform(F.col(id)), id, F.greatest(F.lit(1), F.floor(F.col("n") * fraction)), *keys)


def subsample_files(df: DataFrame, fraction: float, id: str, file: str, salt: int = 0) -> DataFrame:
    """max(1, round(n * fraction)) rows of each file; the ids still tell their order."""
    return first_of_each(df, random.uniform(F.col(id), salt), id, F.greatest(F.lit(1), F.round(F.col("n") * fraction)), file)


def capped(df: DataFrame, cap: int, id: str, *keys: str) -> DataFrame:
    """A sample of at most ``cap`` rows of each group."""
    return first_of_each(df, random.uniform(F.col(id)), id, F.lit(cap), *keys)


def halved(y: Column) -> Column:
    """Half the counts, as a stand-in for thinning."""
    return y * 0.5


def offsets(df: DataFrame, file: str) -> DataFrame:
    """file, n and ``before``: rows of the files before it. A row a file."""
    n = df.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("before", F.sum("n").over(Window.orderBy(file)) - F.col("n"))


def random_subset(id: Column, subsets: int, iteration: int = 0) -> Column:
    """A subset's number from 0, drawn anew each iteration."""
    return F.least(F.floor(random.uniform(id, iteration) * subsets), F.lit(subsets - 1)).cast("int")


def balanced_chunk(place: Column, n: Column, chunks: int) -> Column:
    """Chunk of a 0-based place when chunk i ends before n * (i + 1) // chunks."""
    return F.ceil(((place + 1) * chunks) / n).cast("int") - 1


def ceil_chunk(place: Column, n: Column, chunks: int) -> Column:
    """Chunk of a 0-based place when all chunks but the last have ceil(n / chunks) rows."""
    return F.floor(place / F.ceil(n / chunks)).cast("int")


def split(df: DataFrame, group: str, share: float) -> DataFrame:
    """``held``: whether the row's group is among the held-out ones, at least one and not all."""
    groups = df.select(group).distinct()
    w = Window.orderBy(random.uniform(F.col(group)), group)  # a row a group
    n = F.count(F.lit(1)).over(Window.partitionBy())
    held = F.row_number().over(w) <= F.least(F.greatest(F.lit(1), F.round(n * share)), n - 1)
    return df.join(groups.withColumn("held", held), group)


def greedy_groups(sizes: list[int], target: int) -> list[int]:
    """Number of the group of each block when blocks fill groups in order up to a target of rows."""
    out, group, held = [], 0, 0
    for n in sizes:
        if held and held + n > target:
            group, held = group + 1, 0
        out.append(group)
        held += n
    return out
