"""Rotation permutations, rings and nearest neighbours on the geometry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import ring_shift


def rotation_map(pixels: DataFrame, views: int) -> DataFrame:
    """view (from 0), pixel_id, src_pixel_id: the pixel that turns into this one. pixels: pixel_id, theta_id, n, base."""
    v = pixels.sparkSession.range(views).select(F.col("id").cast("int").alias("view"))
    src = F.col("base") + ring_shift(F.col("n"), views, F.col("view"), F.col("theta_id"))
    return pixels.crossJoin(F.broadcast(v)).select("view", "pixel_id", src.cast("int").alias("src_pixel_id"))


def inverse(rotation: DataFrame) -> DataFrame:
    """The permutation the other way: its argsort."""
    return rotation.select("view", F.col("src_pixel_id").alias("pixel_id"), F.col("pixel_id").alias("src_pixel_id"))


def rotate(image: DataFrame, rotation: DataFrame) -> DataFrame:
    """view, pixel_id, v and other keys: images (pixel_id, v; with view if they differ by view) gathered through a permutation."""
    source = image.withColumnRenamed("pixel_id", "src_pixel_id")
    keys = ["view", "src_pixel_id"] if "view" in image.columns else ["src_pixel_id"]
    others = [c for c in image.columns if c not in ("view", "pixel_id", "v")]
    return rotation.join(source, keys).select(*others, "view", "pixel_id", "v")


def all_planes(rotation: DataFrame, layer_size: int, planes: int) -> DataFrame:
    """A layer's permutation repeated on each plane, shifted by the layer's size."""
    z = rotation.sparkSession.range(planes).select(F.col("id").cast("int").alias("z"))
    shift = lambda c: (F.col(c) + F.col("z") * layer_size).cast("int").alias(c)
    return rotation.crossJoin(F.broadcast(z)).select("view", shift("pixel_id"), shift("src_pixel_id"))


def runs(df: DataFrame, value: Column, order: list[str], tolerance: float, *keys: str) -> DataFrame:
    """``run``: numbers stretches of rows, in order, whose value differs from the row before by at most ``tolerance``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.abs(value - F.lag(value).over(w)) > tolerance).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w).cast("int")).drop("__new")


def nearest(df: DataFrame, dimension: DataFrame, distance: Callable[[Column], Column], k: int, tie: str, role: str) -> DataFrame:
    """``df`` with role, place (from 1), the tie's value and d2 of the k entries of each role of a small dimension that are nearest, equal ones by the tie. distance: of an entry, as a struct of the dimension's columns. The dimension goes along as an array a role, so a row is worked on by itself: nothing is shuffled, and only its own entries are sorted."""
    entries = dimension.groupBy(role).agg(F.collect_list(F.struct(*[c for c in dimension.columns if c != role])).alias("__all"))
    best = F.slice(F.sort_array(F.transform("__all", lambda d: F.struct(distance(d).alias("d2"), d[tie].alias(tie)))), 1, k)
    met = df.crossJoin(F.broadcast(entries))  # a row a role
    return met.select(*df.columns, role, F.posexplode(best).alias("place", "__best")).select(*df.columns, role, (F.col("place") + 1).alias("place"), f"__best.{tie}", "__best.d2")


def nearest_value(df: DataFrame, value: str, dimension: DataFrame, entry: str) -> DataFrame:
    """``df`` with the entry of a small dimension nearest to its value (the smaller of two alike). The dimension goes along as one array."""
    entries = dimension.agg(F.sort_array(F.collect_set(entry)).alias("__all"))
    best = F.array_min(F.transform("__all", lambda x: F.struct(F.abs(x - F.col(value)).alias("d"), x.alias("x"))))
    return df.crossJoin(F.broadcast(entries)).withColumn("nearest", best["x"]).drop("__all")
