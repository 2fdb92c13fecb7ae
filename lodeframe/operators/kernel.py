"""Event kernels: each event's row of pixel probabilities, and the coarse grids that keep such rows short."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import energy, geometry
from ..session import prepare

# Crystal sizes in mm (x, y, z) of the front layers and of the rear layer.
FRONT_CRYSTAL, REAR_CRYSTAL = (3.0, 3.0, 3.0), (2.0, 6.0, 2.0)


def position_variance(rear: Column, axis: int, extra: float = 0.0, layers: int = 4) -> Column:
    """Variance of a hit's coordinate in a crystal of its layer: size squared over 12, plus extra squared. Crystals' sizes are known of machines with four layers; of others only extra counts."""
    if layers != 4:
        return F.lit(max(extra, 0.0) ** 2)
    return F.when(rear, REAR_CRYSTAL[axis] ** 2 / 12).otherwise(FRONT_CRYSTAL[axis] ** 2 / 12) + extra * extra


def energy_sigma(e1: Column, e0: float, resolution: float, beta: Column, theta: Column) -> Column:
    """Angular sigma from the energy: the angle's change at e1 plus or minus sigma, on the side where beta lies."""
    sigma = e1 * (resolution / energy.FWHM) * F.sqrt(F.lit(e0) / e1)
    at = lambda e: energy.scatter_angle(geometry.clamp(e, 1e-7, e0 - 1e-7), e0)
    return F.when(beta >= theta, F.greatest(at(e1 + sigma) - theta, F.lit(1e-7))).otherwise(F.greatest(theta - at(e1 - sigma), F.lit(1e-7)))


def position_sigma(source: geometry.Point, hit1: geometry.Point, hit2: geometry.Point, variance1: geometry.Point, variance2: geometry.Point, source_leg: bool = False) -> Column:
    """Angular sigma from the hits' positions, by the gradient of the angle at the first hit."""
    a, b = geometry.minus(hit1, source), geometry.minus(hit2, hit1)
    na, nb = (F.greatest(geometry.norm(v), F.lit(1e-7)) for v in (a, b))
    ua, ub = tuple(c / na for c in a), tuple(c / nb for c in b)
    cosine = geometry.dot(ua, ub)
    sine = F.sqrt(F.greatest(1 - cosine * cosine, F.lit(1e-12)))
    across = tuple((p - cosine * q) / nb for p, q in zip(ua, ub, strict=True))
    along = tuple((q - cosine * p) / na for p, q in zip(ua, ub, strict=True))
    total = F.lit(0.0)
    for c, l, v1, v2 in zip(across, along, variance1, variance2, strict=True):
        g1 = (c - l) / sine if source_leg else c / sine
        g2 = c / sine
        total = total + g1 * g1 * v1 + g2 * g2 * v2
    return F.sqrt(F.greatest(total, F.lit(1e-12)))


def kernel(e1: Column, e0: float, beta: Column, theta: Column, sigma: Column) -> Column:
    """Gaussian of the angle times the Klein-Nishina factor."""
    d, s = beta - theta, F.sin(beta)
    return F.exp(-d * d / (2 * sigma * sigma)) * (F.lit(e0) / (e0 - e1) + (e0 - e1) / e0 - s * s)


#: Cells (events times pixels) that a task works on at once.
CELLS = 1 << 20


def rows(located_events: DataFrame, pixels: DataFrame, matrix: DataFrame, e0: float, resolution: float, support: float, extra: float = 0.0, source_leg: bool = False, layers: int = 4, generate: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """event_id, cp1, t (an array over the pixels) and the effective support 1 / sum t^2 of the events that pass it; rows whose sum isn't positive and finite go.

    Each event meets its first hit's matrix row (bin_id, h) once. Its row of
    kernels is worked out with numpy, normalised and judged in the same task, so
    the product of events and pixels is never shuffled. The pixels' centres, of
    the size of the grid, go along. The steps are those of the column functions
    above (``energy_sigma``, ``position_sigma``, ``kernel``).

    generate: a hook on the kernels before they meet the matrix, each over its
    largest number, as images (events, side, side) of a square grid; other grids,
    as coarse ones are, are refused.
    """
    grid = np.array([tuple(r) for r in pixels.orderBy("pixel_id").select("x", "y", "z").collect()], float)  # a row a pixel
    side = math.isqrt(len(grid))
    if generate is not None and side * side != len(grid):
        raise ValueError("generated kernels need a square grid")
    names = ("x1", "y1", "z1", "x2", "y2", "z2", "e1", "rear1", "rear2")
    met = located_events.join(matrix.select(F.col("bin_id").cast("int").alias("cp1"), "h"), "cp1").select("event_id", "cp1", *[F.col(n).cast("double").alias(n) for n in names], "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(grid))
        for whole in batches:
            for a in range(0, len(whole), step):
                b = whole.slice(a, step)
                column = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
                h = b.column("h").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)
                t = _kernels(column, grid, e0, resolution, extra, source_leg, layers)
                if generate is not None:
                    t = np.asarray(generate((t / t.max(axis=1, keepdims=True)).reshape(len(t), side, side)), float).reshape(len(t), -1)
                t = t * h
                total = t.sum(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    t = t / total[:, None]
                    wide = 1 / (t * t).sum(axis=1)
                good = np.flatnonzero(np.isfinite(total) & (total > 0) & (wide >= support))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * len(grid)), pa.array(t[good].ravel()))
                yield pa.RecordBatch.from_arrays([b.column("event_id").take(pa.array(good)), b.column("cp1").take(pa.array(good)), flat, pa.array(wide[good])], ["event_id", "cp1", "t", "support"])

    prepare(located_events.sparkSession)
    return met.mapInArrow(run, f"event_id {met.schema['event_id'].dataType.simpleString()}, cp1 int, t array<double>, support double")


def _kernels(c: dict[str, np.ndarray], grid: np.ndarray, e0: float, resolution: float, extra: float, source_leg: bool, layers: int = 4) -> np.ndarray:
    """(events, pixels): angle kernels of events' columns."""
    hit1, hit2 = (np.stack([c[f"{axis}{k}"] for axis in "xyz"], axis=1) for k in (1, 2))
    a, b = hit1[:, None] - grid[None], hit2 - hit1
    na, nb = np.sqrt((a * a).sum(axis=2)), np.sqrt((b * b).sum(axis=1))[:, None]
    ab = np.einsum("epk,ek->ep", a, b)
    e1, edge = c["e1"][:, None], 1 - 1e-7
    angle = lambda e: np.arccos(np.clip(1 - energy.ELECTRON * e / ((e0 - e) * e0), -edge, edge))
    theta = angle(e1)
    beta = np.arccos(np.clip(ab / np.maximum(na * nb, 1e-7), -edge, edge))
    blur = e1 * (resolution / energy.FWHM) * np.sqrt(e0 / e1)
    at = lambda e: angle(np.clip(e, 1e-7, e0 - 1e-7))
    by_energy = np.where(beta >= theta, np.maximum(at(e1 + blur) - theta, 1e-7), np.maximum(theta - at(e1 - blur), 1e-7))
    na, nb = np.maximum(na, 1e-7), np.maximum(nb, 1e-7)
    ua, ub = a / na[:, :, None], (b / nb)[:, None]
    cosine = (ua * ub).sum(axis=2)
    square = np.maximum(1 - cosine * cosine, 1e-12)
    by_place = np.zeros_like(cosine)
    for k in range(3):
        v1, v2 = (np.where(c[f"rear{i}"] > 0, REAR_CRYSTAL[k] ** 2 / 12, FRONT_CRYSTAL[k] ** 2 / 12)[:, None] * (layers == 4) + max(extra, 0.0) ** 2 for i in (1, 2))
        across = (ua[:, :, k] - cosine * ub[:, :, k]) / nb
        along = (ub[:, :, k] - cosine * ua[:, :, k]) / na if source_leg else 0.0
        by_place += ((across - along) ** 2 * v1 + across**2 * v2) / square
    sigma2 = np.maximum(by_energy**2 + np.maximum(by_place, 1e-12), 1e-12)
    d, s = beta - theta, np.sin(beta)
    return np.exp(-d * d / (2 * sigma2)) * (e0 / (e0 - e1) + (e0 - e1) / e0 - s * s)


def weight_array(weights: DataFrame, fine: int, coarse: int) -> np.ndarray:
    """(fine, coarse) array of weights (fine, coarse, w), which are as many as a grid has pixels."""
    out = np.zeros((fine, coarse))
    for r in weights.select("fine", "coarse", "w").collect():
        out[r["fine"], r["coarse"]] = r["w"]
    return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long rows as stretches: pixels of one event that follow one another, as their first pixel and the array of their values."""
    for b in batches:
        if len(b):
            event, cp1, pixel = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            new = (event[1:] != event[:-1]) | (cp1[1:] != cp1[:-1]) | (pixel[1:] != pixel[:-1] + 1)
            start = np.concatenate([[0], np.flatnonzero(new) + 1])
            t = pa.ListArray.from_arrays(pa.array(np.append(start, len(b)).astype(np.int32)), b.column(3))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(start)) for k in range(3)], t], ["event_id", "cp1", "pixel_id", "t"])


def packed(rows: DataFrame) -> DataFrame:
    """event_id, cp1 and t, an array over the pixels in order, of long rows (event_id, cp1, pixel_id, t); every pixel must be there once. Rows that lie beside each other are put together before they travel, so a value costs its own bytes and not a row's."""
    prepare(rows.sparkSession)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("event_id", "cp1", "pixel_id"))
    some = rows.select("event_id", "cp1", "pixel_id", "t").mapInArrow(_stretches, f"{kinds}, t array<double>")
    cells = F.sort_array(F.collect_list(F.struct("pixel_id", "t")))
    return some.repartition("event_id", "cp1").groupBy("event_id", "cp1").agg(F.flatten(F.transform(cells, lambda c: c["t"])).alias("t"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "cp1", F.posexplode("t").alias("pixel_id", "t"))


def ring_stride(length: int, views: int, wanted: int) -> int:
    """The largest stride up to ``wanted`` that divides a ring and a view's step on it; 1 if none does."""
    step = length // views if length % views == 0 else 1
    return max((k for k in range(1, max(1, wanted) + 1) if length % k == 0 and step % k == 0), default=1)


def reduce_weights(pixels: DataFrame, stride: int) -> DataFrame:
    """coarse, fine, w: each ring's every ``stride``-th pixel, as it is."""
    return pixels.filter(F.col("theta_id") % stride == 0).select((F.floor(F.col("base") / stride) + F.floor(F.col("theta_id") / stride)).cast("int").alias("coarse"), F.col("pixel_id").alias("fine"), F.lit(1.0).alias("w"))


def expand_weights(pixels: DataFrame, stride: int) -> DataFrame:
    """fine, coarse, w: linear along each ring, which closes on itself."""
    m = (F.col("n") / stride).cast("int")
    lo, part = F.floor(F.col("theta_id") / stride).cast("int"), (F.col("theta_id") % stride) / stride
    base = F.floor(F.col("base") / stride).cast("int")
    two = F.array(F.struct((base + lo).alias("coarse"), (1 - part).alias("w")), F.struct((base + F.pmod(lo + 1, m)).alias("coarse"), part.alias("w")))
    return pixels.select(F.col("pixel_id").alias("fine"), F.explode(two).alias("e")).select("fine", "e.coarse", "e.w").filter("w > 0")


def reduce_weights_line(spark: SparkSession, n: int, stride: int) -> DataFrame:
    """coarse, fine, w on a line of n cells, which doesn't close on itself: the two cells beside the middle of each ``stride``, linearly."""
    middle = (F.col("id") + 0.5) * stride - 0.5
    left = F.least(F.greatest(F.floor(middle), F.lit(0)), F.lit(n - 1)).cast("int")
    right = F.least(left + 1, F.lit(n - 1))
    share = F.when(right == left, 0.0).otherwise(middle - left)
    two = F.array(F.struct(left.alias("fine"), (1 - share).alias("w")), F.struct(right.alias("fine"), share.alias("w")))
    return spark.range(n // stride).select(F.col("id").cast("int").alias("coarse"), F.explode(two).alias("e")).select("coarse", "e.fine", "e.w").filter("w > 0")


def expand_weights_line(spark: SparkSession, n: int, stride: int) -> DataFrame:
    """fine, coarse, w on a line of n cells: linear between the middles of the strides, and the end's value beyond them."""
    m = n // stride
    place = F.least(F.greatest((F.col("id") + 0.5) / stride - 0.5, F.lit(0.0)), F.lit(float(m - 1)))
    left = F.floor(place).cast("int")
    two = F.array(F.struct(left.alias("coarse"), (1 - (place - left)).alias("w")), F.struct((left + 1).alias("coarse"), (place - left).alias("w")))
    return spark.range(n).select(F.col("id").cast("int").alias("fine"), F.explode(two).alias("e")).select("fine", "e.coarse", "e.w").filter("w > 0")


def weighted(image: DataFrame, weights: DataFrame, source: str, target: str, *groups: str) -> DataFrame:
    """Images (groups, pixel_id, v) through weights (source, target, w): the sum of w v by target. With the ends exchanged it is the adjoint."""
    return image.withColumnRenamed("pixel_id", source).join(F.broadcast(weights), source).groupBy(*groups, F.col(target).alias("pixel_id")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
