"""Scattered interpolation on a Delaunay triangulation: linear in each triangle, no value outside the hull.

The triangulation is that of a grid's points on a plane, of the machine's size; it
is made once on the driver. Points are then located by cells of the plane: a
triangle is a row for each cell that its bounds reach into, so points, which may
be as many as events, meet their few candidates by an equi-join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: By how much of the extent points are moved, by their number, before circles are compared: points of a ring lie on one circle, which leaves the choice open.
NUDGE = 1e-7
#: How far outside a triangle, in barycentric terms, still counts as inside.
EDGE = 1e-9


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (three numbers of points each, in counterclockwise order) of distinct points (n, 2), point by point."""
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), int)
    middle = (points.min(axis=0) + points.max(axis=0)) / 2
    extent = float(np.ptp(points, axis=0).max()) or 1.0
    i = np.arange(n)
    p = (points - middle) / extent + NUDGE * np.stack([np.sin(12.9898 * i + 1), np.sin(78.233 * i + 2)], axis=1)
    p = np.concatenate([p, 1e4 * np.array([[-1.0, -1.0], [1.0, -1.0], [0.0, 1.5]])])
    triangle, circle = np.array([[n, n + 1, n + 2]]), np.array([_circle(p, n, n + 1, n + 2)])
    for k in range(n):
        far = ((circle[:, :2] - p[k]) ** 2).sum(axis=1)
        hit = far < circle[:, 2]
        edges: dict[tuple[int, int], int] = {}
        for a, b, c in triangle[hit].tolist():
            for e in ((a, b), (b, c), (c, a)):
                if e[::-1] in edges:
                    del edges[e[::-1]]
                else:
                    edges[e] = 1
        new = [(a, b, k) for a, b in edges]
        triangle = np.concatenate([triangle[~hit], np.array(new)])
        circle = np.concatenate([circle[~hit], np.array([_circle(p, *t) for t in new])])
    out = triangle[(triangle < n).all(axis=1)]
    a, b, c = (points[out[:, k]] for k in range(3))
    area = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    out = out[np.abs(area) > 1e-9 * extent * extent]  # what the nudge makes of points on a line
    return out[np.lexsort(out.T[::-1])]


def _circle(p: np.ndarray, i: int, j: int, k: int) -> tuple[float, float, float]:
    """Centre and squared radius of the circle through three points."""
    (ax, ay), b, c = p[i], p[j] - p[i], p[k] - p[i]
    d = 2 * (b[0] * c[1] - b[1] * c[0])
    d = d if d else 1e-300
    bb, cc = b @ b, c @ c
    x, y = (c[1] * bb - b[1] * cc) / d, (b[0] * cc - c[0] * bb) / d
    return ax + x, ay + y, x * x + y * y


def triangle_table(spark: SparkSession, ids: list[int], points: np.ndarray) -> DataFrame:
    """triangle, and p0 .. p2 with x0 .. y2: the corners' ids and places."""
    rows = []
    for t, corners in enumerate(triangulate(points).tolist()):
        rows.append((t, *[int(ids[c]) for c in corners], *[float(v) for c in corners for v in points[c]]))
    return spark.createDataFrame(rows, "triangle int, p0 int, p1 int, p2 int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")


def shares(x: Column, y: Column) -> list[Column]:
    """Barycentric shares of a point at the corners of the row's triangle."""
    c = {k: F.col(k) for k in ("x0", "y0", "x1", "y1", "x2", "y2")}
    whole = (c["x1"] - c["x0"]) * (c["y2"] - c["y0"]) - (c["y1"] - c["y0"]) * (c["x2"] - c["x0"])
    one = ((x - c["x0"]) * (c["y2"] - c["y0"]) - (y - c["y0"]) * (c["x2"] - c["x0"])) / whole
    two = ((c["x1"] - c["x0"]) * (y - c["y0"]) - (c["y1"] - c["y0"]) * (x - c["x0"])) / whole
    return [1 - one - two, one, two]


def located(points: DataFrame, triangles: DataFrame, cell: float, ids: list[str]) -> DataFrame:
    """ids and corners, an array of (pixel_id, w), of the triangle that each point (x, y) lies in, the first one where it lies on an edge; points outside of all have none."""
    at = lambda c: F.floor(c / cell).cast("int")
    bounds = lambda f, c: f(*[F.col(f"{c}{k}") for k in range(3)])
    spread = triangles
    for c in "xy":
        slack = EDGE * (bounds(F.greatest, c) - bounds(F.least, c)) + 1e-9
        spread = spread.withColumn(f"__c{c}", F.explode(F.sequence(at(bounds(F.least, c) - slack), at(bounds(F.greatest, c) + slack))))
    own = points.select(*ids, "x", "y", at(F.col("x")).alias("__cx"), at(F.col("y")).alias("__cy"))
    share = shares(F.col("x"), F.col("y"))
    met = own.join(spread, ["__cx", "__cy"]).filter(F.least(*share) >= -EDGE)
    corners = F.array(*[F.struct(F.col(f"p{k}").alias("pixel_id"), w.alias("w")) for k, w in enumerate(share)])
    return met.groupBy(*ids).agg(F.min_by(corners, "triangle").alias("corners"))


def weight_matrix(placed: DataFrame, point: str, pixels: int, points: int) -> np.ndarray:
    """(pixels, points) of located grid points, for products with rows that are arrays; NaN where a point has no triangle. The points are a display grid's."""
    out = np.zeros((pixels, points))
    out[:] = np.nan
    for r in placed.select(point, "corners").collect():
        out[:, r[0]] = 0.0
        for c in r["corners"]:
            out[c["pixel_id"], r[0]] += c["w"]
    return out


def interpolated(points: DataFrame, placed: DataFrame, images: DataFrame, ids: list[str], *on: str) -> DataFrame:
    """ids and v of points that ask an image (keys ``on``, pixel_id, v) each; null outside the hull, or where a corner has no value."""
    asked = points.select(*dict.fromkeys([*ids, *on])).join(placed, ids, "left")
    each = asked.select(*dict.fromkeys([*ids, *on]), F.explode_outer("corners").alias("c")).select(*dict.fromkeys([*ids, *on]), "c.pixel_id", "c.w")
    met = each.join(images, [*on, "pixel_id"], "left")
    whole = F.count(F.col("v") * F.col("w")) == F.count(F.lit(1))
    return met.groupBy(*ids).agg(F.when(whole, F.sum(F.col("v") * F.col("w"))).alias("v"))
