"""Volumes: phantoms, interpolation, projections of an image, alignment, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry


def phantom(grid: DataFrame, x: Column, y: Column, rods: list[tuple[float, float, float, float]], body_radius: float, body: float) -> DataFrame:
    """``grid`` with ``v``: a rod's activity inside a rod (cx, cy, radius, activity; the first one counts), the body's elsewhere in it, 0 outside."""
    v = F.when(geometry.in_disk(x, y, 0, 0, body_radius), F.lit(float(body))).otherwise(0.0)
    for cx, cy, radius, activity in reversed(rods):
        v = F.when(geometry.in_disk(x, y, cx, cy, radius), F.lit(float(activity))).otherwise(v)
    return grid.withColumn("v", v)


def raster(grid: DataFrame, p: geometry.Point, shapes: list[tuple]) -> DataFrame:
    """``grid`` with ``v``: the activity of the first shape that a point lies in, 0 outside of all. Shapes are (kind, centre, sizes, activity): a cylinder along z has (radius, half height), an ellipsoid three axes, a box three half sides."""
    v = F.lit(0.0)
    for kind, centre, sizes, activity in reversed(shapes):
        if kind == "cylinder":
            inside = geometry.in_cylinder(p[0], p[1], p[2] - centre[2], centre[0], centre[1], *sizes)
        elif kind == "ellipsoid":
            inside = geometry.in_ellipsoid(p, centre, sizes)
        elif kind == "box":
            inside = geometry.in_box(p, centre, sizes)
        else:
            raise ValueError(f"no shape {kind!r}")
        v = F.when(inside, F.lit(float(activity))).otherwise(v)
    return grid.withColumn("v", v)


def halo_blocks(volume: DataFrame, axes: list[str], size: int, *on: str) -> DataFrame:
    """A volume (axes, v and any keys) in blocks of ``size`` cells an axis with one more at the upper end: block (an array of its numbers) and values, the first axis running last. Cells that aren't there count as 0."""
    wide = size + 1
    spread = volume.select(*on, *axes, "v")
    for a in axes:  # a cell at a block's lower end is in the block before, too
        own = F.floor(F.col(a) / size)
        both = F.when(F.col(a) % size == 0, F.array(own - 1, own)).otherwise(F.array(own))
        spread = spread.withColumn(f"__{a}", F.explode(both.cast("array<int>")))
    at = F.lit(0)
    for a in axes:
        at = at * wide + (F.col(a) - F.col(f"__{a}") * size)
    held = spread.groupBy(*on, F.array(*[F.col(f"__{a}") for a in axes]).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), F.coalesce("v", F.lit(0.0))))).alias("__held"))
    every = F.sequence(F.lit(0), F.lit(wide ** len(axes) - 1))
    return held.select(*on, "block", F.transform(every, lambda k: F.coalesce(F.try_element_at("__held", k), F.lit(0.0))).alias("values"))


def linear(points: DataFrame, volume: DataFrame, places: dict[str, Column], ids: list[str], *on: str, size: int = 4) -> DataFrame:
    """ids and v: values of a volume (axes, v and the keys ``on``, which the points have too) at fractional places on its axes. A point meets one block that holds all its corners; corners outside count as 0."""
    axes = list(places)
    wide = size + 1
    own = points.select(*dict.fromkeys([*ids, *on]), *[places[a].alias(f"__{a}") for a in axes])
    own = own.withColumn("block", F.array(*[F.floor(F.floor(f"__{a}") / size).cast("int") for a in axes]))
    met = own.join(halo_blocks(volume, axes, size, *on), [*on, "block"], "left")
    total = F.lit(0.0)
    for corner in range(1 << len(axes)):
        at, weight = F.lit(0), F.lit(1.0)
        for k, a in enumerate(axes):
            step = corner >> k & 1
            low, share = F.floor(f"__{a}"), F.col(f"__{a}") - F.floor(f"__{a}")
            at = at * wide + (low - F.get("block", F.lit(k)) * size + step)
            weight = weight * (share if step else 1 - share)
        total = total + weight * F.coalesce(F.get("values", at.cast("int")), F.lit(0.0))
    return met.select(*ids, total.alias("v"))


def bilinear(points: DataFrame, image: DataFrame, u: Column, w: Column, ids: list[str], *on: str) -> DataFrame:
    """Values of images (ix, iy, v) at fractional places (u, w)."""
    return linear(points, image, {"ix": u, "iy": w}, ids, *on, size=8)


def trilinear(points: DataFrame, volume: DataFrame, u: Column, v: Column, w: Column, ids: list[str], *on: str) -> DataFrame:
    """Values of volumes (ix, iy, iz, v) at fractional places (u, v, w)."""
    return linear(points, volume, {"ix": u, "iy": v, "iz": w}, ids, *on)


def maximum_projection(volume: DataFrame, *keep: str) -> DataFrame:
    return volume.groupBy(*keep).agg(F.max("v").alias("v"))


def slab_mean(volume: DataFrame, lo: int, hi: int, *keys: str) -> DataFrame:
    """Mean over planes lo to hi, both included."""
    return volume.filter(F.col("iz").between(lo, hi)).groupBy(*keys, "ix", "iy").agg(F.avg("v").alias("v"))


def block_average(volume: DataFrame, k: int, *keys: str) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return volume.groupBy(*keys, at("ix"), at("iy"), at("iz")).agg(F.avg("v").alias("v"))


def roughness(volume: DataFrame, *keys: str) -> DataFrame:
    """Mean absolute first difference of each volume along each axis: keys, axis, pairs, roughness."""
    out = None
    for axis, others in (("ix", ("iy", "iz")), ("iy", ("ix", "iz"))):
        w = Window.partitionBy(*keys, *others).orderBy(axis)
        d = volume.select(*keys, F.abs(F.col("v") - F.lag("v").over(w)).alias("d"))
        row = d.groupBy(*keys, F.lit(axis).alias("axis")).agg(F.count("d").alias("pairs"), F.avg("d").alias("roughness"))
        out = row if out is None else out.unionByName(row)
    return out


def laplacian(volume: DataFrame, *groups: str) -> DataFrame:
    """Sum over the neighbours that exist, along all axes, of own value less theirs; ``groups`` tell volumes apart."""
    axes = ["ix", "iy", "iz"]
    keys = [*groups, *axes]
    shift = lambda axis, by: F.struct(*[(F.col(c) + (by if c == axis else 0)).cast("int").alias(c) for c in axes])
    sent = volume.select(*groups, F.explode(F.array(*[shift(a, b) for a in axes for b in (-1, 1)])).alias("to"), "v").select(*groups, "to.*", "v")
    got = sent.groupBy(*keys).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return volume.join(got, keys, "left").select(*keys, (F.col("v") * F.coalesce("n", F.lit(0)) - F.coalesce("s", F.lit(0.0))).alias("v"))


def best_pose(points: DataFrame, images: DataFrame, size: int, turns: int, ids: list[str], *keys: str) -> DataFrame:
    """Scores of all turns of 360/turns degrees and two flips of points (x, y) on each image (keys, ix, iy, v), read at rounded places; rank 1 is an image's best, the earlier pose among equals. Points are a marker's, a few dozen."""
    spark = points.sparkSession
    poses = spark.range(2 * turns).select((F.col("id") % 2).cast("int").alias("flip"), F.floor(F.col("id") / 2).cast("int").alias("turn"))
    x = F.when(F.col("flip") == 1, -F.col("x")).otherwise(F.col("x"))
    rx, ry = geometry.rotate(x, F.col("y"), F.col("turn") * (360.0 / turns))
    at = lambda c: F.floor(c + (size - 1) / 2 + 0.5 + 1e-9).cast("int")
    placed = points.crossJoin(F.broadcast(poses)).select("flip", "turn", *ids, at(rx).alias("ix"), at(ry).alias("iy"))
    every = images.select(*keys).distinct().crossJoin(F.broadcast(placed)) if keys else placed  # a pose's few points for each image
    met = every.join(images.select(*keys, "ix", "iy", "v"), [*keys, "ix", "iy"], "left")
    scored = met.groupBy(*keys, "flip", "turn").agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "flip", "turn")))  # a row a pose


def midpoints(rods: DataFrame, distance: float, tolerance: float) -> DataFrame:
    """Midpoints of rods (id, x, y) that lie at a distance: the valleys between neighbours. Rods are a phantom's, a few dozen."""
    a, b = (rods.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "x", "y")]) for s in "ab")
    d = F.sqrt((F.col("x_a") - F.col("x_b")) ** 2 + (F.col("y_a") - F.col("y_b")) ** 2)
    pairs = a.join(F.broadcast(b), (F.col("id_a") < F.col("id_b")) & (F.abs(d - distance) <= tolerance))
    return pairs.select("id_a", "id_b", ((F.col("x_a") + F.col("x_b")) / 2).alias("x"), ((F.col("y_a") + F.col("y_b")) / 2).alias("y"))


def ssim(a: DataFrame, b: DataFrame, block: int, dynamic: float, *groups: str) -> DataFrame:
    """Structural similarity of two volumes over blocks of a grid (uniform windows), and their mean is the index."""
    keys = ["ix", "iy", "iz"]
    both = a.join(b.withColumnRenamed("v", "w"), [*groups, *keys])
    at = [F.floor(F.col(c) / block).cast("int").alias(f"b{c}") for c in keys]
    s = both.groupBy(*groups, *at).agg(F.avg("v").alias("ma"), F.avg("w").alias("mb"), F.var_pop("v").alias("va"), F.var_pop("w").alias("vb"), F.covar_pop("v", "w").alias("c"))
    c1, c2 = (0.01 * dynamic) ** 2, (0.03 * dynamic) ** 2
    ma, mb = F.col("ma"), F.col("mb")
    index = (2 * ma * mb + c1) * (2 * F.col("c") + c2) / ((ma * ma + mb * mb + c1) * (F.col("va") + F.col("vb") + c2))
    return s.select(*groups, *[f"b{c}" for c in keys], index.alias("ssim"))


def fisher(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """Diagonal of H' D H and the sum of the weighted rows: pixel_id, fisher, weighted. matrix: bin_id, pixel_id, h; weights: bin_id, d."""
    d = matrix.join(weights, "bin_id")
    return d.groupBy("pixel_id").agg(F.sum(F.col("h") * F.col("h") * F.col("d")).alias("fisher"), F.sum(F.col("h") * F.col("d")).alias("weighted"))


def detector_mixing(detectors: DataFrame, sigma: float) -> DataFrame:
    """a, b, w: Gaussian kernel of the distance of detectors, normalised by a. The table is of the machine's size."""
    a, b = (detectors.select(*[F.col(c).alias(f"{c}_{s}") for c in ("det_id", "x", "y", "z")]) for s in "ab")
    d2 = sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "xyz")
    k = a.crossJoin(F.broadcast(b)).select(F.col("det_id_a").alias("a"), F.col("det_id_b").alias("b"), F.exp(-0.5 * d2 / sigma**2).alias("k"))
    return k.withColumn("w", F.col("k") / F.sum("k").over(Window.partitionBy("a"))).drop("k")
