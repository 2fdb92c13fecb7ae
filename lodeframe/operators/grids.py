"""Grids and what is read off them: planes, groups of slices, runs of numbers, sample points, polar rings, curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def plane(spark: SparkSession, nx: int, ny: int, lx: float, ly: float, z: float) -> DataFrame:
    """pixel_id (x runs first), x, y, z: centres of a plane's pixels around the origin."""
    i, n = F.col("id"), nx * ny
    return spark.range(n).select(i.cast("int").alias("pixel_id"), ((i % nx - (nx - 1) / 2) * lx).alias("x"), ((F.floor(i / nx) - (ny - 1) / 2) * ly).alias("y"), F.lit(float(z)).alias("z"))


def hemisphere(df: DataFrame, side: str, y: str = "y") -> DataFrame:
    """Rows with y over 0 (``front``), under 0 (``rear``) or ``all``."""
    if side not in ("front", "rear", "all"):
        raise ValueError(f"no side {side!r}")
    return df if side == "all" else df.filter(F.col(y) > 0 if side == "front" else F.col(y) < 0)


def spacing_to_cm(unit: str) -> float:
    if unit not in ("mm", "cm"):
        raise ValueError(f"no unit {unit!r}")
    return 0.1 if unit == "mm" else 1.0


def regridded_spacing(n: int, spacing: float, to: int) -> float:
    """Spacing after n points become ``to`` over the same stretch."""
    if n <= 0 or to <= 0:
        raise ValueError("grids have points")
    return spacing if 1 in (n, to) or n == to else spacing * (n - 1) / (to - 1)


def normalised_profile(df: DataFrame, place: str, values: list[str], shift: float) -> DataFrame:
    """Profiles over their maxima, with the axis shifted. The maxima are one row, which is broadcast."""
    most = df.agg(*[F.max(v).alias(f"__{v}") for v in values])
    return df.crossJoin(F.broadcast(most)).select((F.col(place) - shift).alias(place), *[(F.col(v) / F.col(f"__{v}")).alias(v) for v in values])


def contiguous(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """first and last of each run of consecutive integers within a key."""
    w = Window.partitionBy(*keys).orderBy(value)
    runs = df.select(*keys, value).distinct().withColumn("__run", F.col(value) - F.row_number().over(w))
    return runs.groupBy(*keys, "__run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("__run")


def group_slices(volume: DataFrame, size: int, slices: int, excluded: tuple[int, ...], preferred: int) -> DataFrame:
    """group (from 1) and iz of the slice that stands for each whole group of ``size``: the preferred position if it isn't empty, else the middle one of those that aren't; excluded positions (from 1) don't count. Groups without any go."""
    at = (F.col("iz") % size + 1).cast("int")
    group = (F.floor(F.col("iz") / size) + 1).cast("int")
    full = volume.filter("v > 0").select("iz").distinct().select(group.alias("slice_group"), at.alias("at"), "iz").filter((F.col("slice_group") <= slices // size) & ~F.col("at").isin(*excluded))
    held = full.groupBy("slice_group").agg(F.sort_array(F.collect_list("iz")).alias("all"), F.max(F.when(F.col("at") == preferred, F.col("iz"))).alias("wanted"))
    return held.select("slice_group", F.coalesce("wanted", F.element_at("all", F.ceil(F.size("all") / 2).cast("int"))).alias("iz"))


def sample_weights(spark: SparkSession, shape: tuple[int, int, int], spacing: tuple[float, float, float], points: tuple[int, int, int], step: float) -> DataFrame:
    """index (x runs first) and weight of the voxels nearest to a grid of sample points around the centre: the share of points that fall in each."""
    i, place, below = F.col("id"), F.lit(0), 1
    for n, size, k, run in zip(shape, spacing, points, (1, points[0], points[0] * points[1]), strict=True):
        x = (F.floor(i / run) % k - (k - 1) / 2) * step
        at = F.least(F.greatest(F.rint(x / size + n / 2 - 0.5), F.lit(0)), F.lit(n - 1)).cast("long")
        place, below = place + at * below, below * n
    total = math.prod(points)
    return spark.range(total).select(place.alias("index")).groupBy("index").agg((F.count(F.lit(1)) / total).alias("weight"))


def weighted_mean(df: DataFrame, weights: DataFrame, key: str, value: str, *groups: str) -> DataFrame:
    """Sum of value times weight, of each group; the weights are as many as the voxels of a grid."""
    return df.join(F.broadcast(weights), key).groupBy(*groups).agg(F.sum(F.col(value) * F.col("weight")).alias("mean"))


def active(volume: DataFrame, threshold: float = 1e-4, *groups: str) -> DataFrame:
    """Voxels with activity, with their share of the whole of their group."""
    some = volume.filter(F.col("v") > threshold)
    total = some.groupBy(*groups).agg(F.sum("v").alias("__all"))
    met = some.join(total, list(groups)) if groups else some.crossJoin(F.broadcast(total))
    return met.withColumn("share", F.col("v") / F.col("__all")).drop("__all")


def curve_at(curves: DataFrame, at: DataFrame, x: str, values: list[str], *keys: str) -> DataFrame:
    """Values of curves (keys, x, values) at the places ``at`` (a small table of x), linear between neighbours and null beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(x)
    parts = curves.select(*keys, F.col(x).alias("__lo"), F.lead(x).over(w).alias("__hi"), *[F.struct(F.col(v).alias("a"), F.lead(v).over(w).alias("b")).alias(v) for v in values])
    parts = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__lo", "__hi", *values))).alias("__parts"))  # a curve has as many as iterations were saved
    put = parts.crossJoin(F.broadcast(at.select(F.col(x))))
    here = F.filter("__parts", lambda p: (p["__lo"] <= F.col(x)) & ((F.col(x) < p["__hi"]) | (p["__hi"].isNull() & (p["__lo"] == F.col(x)))))
    one = put.withColumn("__one", F.get(here, F.lit(0)))
    share = (F.col(x) - F.col("__one.__lo")) / (F.col("__one.__hi") - F.col("__one.__lo"))
    a, b = (lambda v: F.col(f"__one.{v}.a")), (lambda v: F.col(f"__one.{v}.b"))
    return one.select(*keys, x, *[F.when(F.col("__one.__hi").isNull(), a(v)).otherwise(a(v) + share * (b(v) - a(v))).alias(v) for v in values])


def best(df: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """The first place with the largest value of each key, and that value."""
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o")))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(top.alias("t")).select(*keys, (-F.col("t.o")).alias(order), F.col("t.v").alias(value))


def label_parts(label: Column) -> tuple[Column, Column]:
    """Energy and system of a label: what is before its first underscore, and the rest."""
    return F.regexp_extract(label, "^([^_]*)(.*)$", 1), F.regexp_extract(label, "^([^_]*)(.*)$", 2)


def gaussian_weights(spark: SparkSession, n: int, sigma: float, radius: int) -> DataFrame:
    """i, src, w: a Gaussian window along an axis of n places; places beyond the ends count as the end."""
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    rows: dict[tuple[int, int], float] = {}
    for i in range(n):
        for k, w in zip(range(-radius, radius + 1), weight, strict=True):
            at = (i, min(max(i + k, 0), n - 1))
            rows[at] = rows.get(at, 0.0) + w / sum(weight)
    return spark.createDataFrame([(i, s, w) for (i, s), w in rows.items()], "i int, src int, w double")


def smoothed(volume: DataFrame, values: list[str], shape: tuple[int, int, int], sigma: float, radius: int, *groups: str) -> DataFrame:
    """Values (groups, ix, iy, iz, values) through a Gaussian window, axis by axis."""
    axes = ["ix", "iy", "iz"]
    for axis, n in zip(axes, shape, strict=True):
        w = F.broadcast(gaussian_weights(volume.sparkSession, n, sigma, radius))  # a row a neighbour of a place
        others = [a for a in axes if a != axis]
        met = volume.join(w, volume[axis] == w["src"]).drop(axis).withColumnRenamed("i", axis)
        volume = met.groupBy(*groups, axis, *others).agg(*[F.sum(F.col(v) * F.col("w")).alias(v) for v in values])
    return volume


def ssim(a: DataFrame, b: DataFrame, shape: tuple[int, int, int], most: float, sigma: float = 1.5, radius: int = 5, *groups: str) -> DataFrame:
    """ix, iy, iz, ssim of two volumes (v) in Gaussian windows."""
    ids = [*groups, "ix", "iy", "iz"]
    both = a.select(*ids, F.col("v").alias("x")).join(b.select(*ids, F.col("v").alias("y")), ids)
    names = {"x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")}
    m = smoothed(both.select(*ids, *[c.alias(n) for n, c in names.items()]), list(names), shape, sigma, radius, *groups)
    c1, c2 = (0.01 * most) ** 2, (0.03 * most) ** 2
    x, y = F.col("x"), F.col("y")
    top = (2 * x * y + c1) * (2 * (F.col("xy") - x * y) + c2)
    return m.select(*ids, (top / ((x * x + y * y + c1) * (F.col("xx") - x * x + F.col("yy") - y * y + c2))).alias("ssim"))
