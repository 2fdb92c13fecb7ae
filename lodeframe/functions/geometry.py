"""Points, angles, boxes and masks as column expressions. A point is a triple of columns, in mm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def point(prefix: str = "") -> Point:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def minus(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Point, b: Point) -> Column:
    return reduce(lambda s, t: s + t, (p * q for p, q in zip(a, b, strict=True)))


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def clamp(x: Column, lo: float | Column, hi: float | Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, as_column(lo)), as_column(hi))


def angle(a: Point, b: Point, eps: float = 1e-7, floor: float = 1e-7) -> Column:
    """The angle between two vectors; the product of their lengths counts as ``floor`` at least."""
    return F.acos(clamp(dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor)), -1 + eps, 1 - eps))


def rotate(x: Column, y: Column, degrees: float | Column) -> tuple[Column, Column]:
    r = F.radians(degrees if isinstance(degrees, Column) else F.lit(float(degrees)))
    return x * F.cos(r) - y * F.sin(r), x * F.sin(r) + y * F.cos(r)


def in_disk(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius


def in_cylinder(x: Column, y: Column, z: Column, cx: float, cy: float, radius: float, half_height: float) -> Column:
    return in_disk(x, y, cx, cy, radius) & (F.abs(z) <= half_height)


def in_ellipsoid(p: Point, centre: tuple[float, float, float], axes: tuple[float, float, float]) -> Column:
    return reduce(lambda s, t: s + t, (((v - c) / a) * ((v - c) / a) for v, c, a in zip(p, centre, axes, strict=True))) <= 1


def in_box(p: Point, centre: tuple[float, float, float], half: tuple[float, float, float]) -> Column:
    return reduce(lambda s, t: s & t, (F.abs(v - c) <= h for v, c, h in zip(p, centre, half, strict=True)))


def box_length(start: Point, end: Point, centre: Point, half: tuple[float, float, float]) -> Column:
    """How much of the segment from start to end lies in an axis-aligned box (slab method)."""
    enter, leave, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for s, e, c, h in zip(start, end, centre, half, strict=True):
        d, lo, hi = e - s, c - h, c + h
        flat = F.abs(d) < 1e-12
        safe = F.when(flat, F.lit(1.0)).otherwise(d)
        a, b = (lo - s) / safe, (hi - s) / safe
        enter = F.when(flat, enter).otherwise(F.greatest(enter, F.least(a, b)))
        leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(a, b)))
        outside = outside | (flat & ((s < lo) | (s > hi)))
    inside = F.greatest(leave - enter, F.lit(0.0)) * norm(minus(end, start))
    return F.when(outside, F.lit(0.0)).otherwise(inside)


def ring_shift(n: Column | int, views: int, view: Column, theta: Column) -> Column:
    """Place on a ring of n pixels that turns into place ``theta`` at a view (0-based)."""
    length = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(theta + (view * length / views).cast("int"), length)


def voxel_centre(index: Column, n: int, size: float) -> Column:
    """Coordinate of the centre of a 0-based voxel on an axis of n."""
    return (index - (n - 1) / 2.0) * size


def flat_index(i: Column, j: Column, k: Column, shape: tuple[int, int, int], order: str = "C") -> Column:
    """Flat position of a 3-D index; C: last axis runs first, F: first axis."""
    a, b, c = shape
    return (i * b + j) * c + k if order == "C" else i + a * (j + b * k)
