"""Which boxes a segment meets: a uniform grid over space, so that segments and boxes meet by an equi-join.

A box is a row for each cell that it reaches into. A segment is a row for each
cell that it crosses, found from where it crosses the grid's planes, so their
number grows with its length and not with the boxes. A pair can share several
cells, but a segment's cells within a box's range of cells follow one another;
so the pair counts where the segment enters that range, and nothing has to be
made distinct. Boxes are taken a hair larger, so that what only touches a plane
isn't missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

AXES = "xyz"
HAIR = 1e-6


def box_cells(boxes: DataFrame, cell: float) -> DataFrame:
    """``boxes`` (low_x .. high_z) once for each cell (cx, cy, cz) that they reach into, with the range of their cells (from_x .. to_z)."""
    at = lambda c: F.floor(c / cell).cast("long")
    out = boxes.withColumns({f"from_{a}": at(F.col(f"low_{a}") - HAIR * cell) for a in AXES} | {f"to_{a}": at(F.col(f"high_{a}") + HAIR * cell) for a in AXES})
    for a in AXES:
        out = out.withColumn(f"c{a}", F.explode(F.sequence(f"from_{a}", f"to_{a}")))
    return out


def _crossed(planes: Column, cell: float, start: Column, end: Column) -> Column:
    """Where on a segment, from 0 to 1, it crosses planes of these numbers."""
    return F.transform(planes, lambda k: (k * cell - start) / (end - start))


def segment_cells(segments: DataFrame, cell: float) -> DataFrame:
    """``segments`` (sx .. ez) once for each cell (cx, cy, cz) that they cross, with the cell before it (before_x .. before_z; null at the start)."""
    cuts = F.array(F.lit(0.0), F.lit(1.0))
    for a in AXES:
        s, e = F.col(f"s{a}"), F.col(f"e{a}")
        lo, hi = F.floor(F.least(s, e) / cell) + 1, F.floor(F.greatest(s, e) / cell)
        planes = F.when((lo <= hi) & (F.abs(e - s) > 1e-12), _crossed(F.sequence(lo, F.greatest(lo, hi)), cell, s, e))
        cuts = F.concat(cuts, F.coalesce(planes, F.array().cast("array<double>")))
    cuts = F.array_sort(F.array_distinct(F.filter(cuts, lambda t: (t >= 0) & (t <= 1))))
    middles = F.zip_with(F.slice(F.col("__cuts"), 1, F.size("__cuts") - 1), F.slice(F.col("__cuts"), 2, F.size("__cuts") - 1), lambda a, b: (a + b) / 2)
    place = lambda t: F.struct(*[F.floor((F.col(f"s{a}") + t * (F.col(f"e{a}") - F.col(f"s{a}"))) / cell).cast("long").alias(f"c{a}") for a in AXES])
    out = segments.withColumn("__cuts", cuts).withColumn("__cells", F.transform(middles, place)).drop("__cuts")
    earlier = F.concat(F.array(F.lit(None)), F.slice("__cells", 1, F.size("__cells") - 1))
    out = out.select(*segments.columns, F.explode(F.zip_with("__cells", earlier, lambda cell, before: F.struct(cell.alias("cell"), before.alias("before")))).alias("__at"))
    return out.select(*segments.columns, *[F.col(f"__at.cell.c{a}").alias(f"c{a}") for a in AXES], *[F.col(f"__at.before.c{a}").alias(f"before_{a}") for a in AXES])


def met_boxes(segments: DataFrame, boxes: DataFrame, cell: float, how: str = "inner") -> DataFrame:
    """Pairs of a segment and a box that share a cell, once each; with ``how`` "left" a segment also has rows without a box. Columns of both must differ."""
    placed = box_cells(boxes, cell)
    known = F.lit(True)
    for a in AXES:
        known = known & F.col(f"before_{a}").between(F.col(f"from_{a}"), F.col(f"to_{a}"))
    first = F.col("before_x").isNull() | ~known
    keys = [f"c{a}" for a in AXES]
    own = segment_cells(segments, cell)
    pairs = own.join(placed, keys) if how == "inner" else own.join(placed, keys, "left")
    dropped = keys + [f"{p}_{a}" for p in ("before", "from", "to", "low", "high") for a in AXES]
    return (pairs.filter(first) if how == "inner" else pairs.filter(F.col("from_x").isNull() | first)).drop(*dropped)


def ball_bounds(boxes: DataFrame, radius: float | Column) -> DataFrame:
    """``boxes`` (x, y, z) with the bounds of a ball around them."""
    return boxes.withColumns({f"low_{a}": F.col(a) - radius for a in AXES} | {f"high_{a}": F.col(a) + radius for a in AXES})


def bounds(boxes: DataFrame) -> DataFrame:
    """``boxes`` (x, y, z and sizes sx, sy, sz) with their bounds."""
    return boxes.withColumns({f"low_{a}": F.col(a) - F.col(f"s{a}") / 2 for a in AXES} | {f"high_{a}": F.col(a) + F.col(f"s{a}") / 2 for a in AXES})


def cell_size(boxes: DataFrame) -> float:
    """A cell's edge: the mean size of the boxes' bounds, so that a box lies in a few cells."""
    sides = [F.avg(F.col(f"high_{a}") - F.col(f"low_{a}")) for a in AXES]
    return float(boxes.agg(F.greatest(*sides).alias("side")).first()["side"] or 1.0) or 1.0


def blockers(segments: DataFrame, boxes: DataFrame, radius: float) -> DataFrame:
    """Boxes (det_id, x, y, z) whose centre comes within a radius of a segment (a, b and sx .. ez), between its ends, and aren't its ends a and b."""
    named = ball_bounds(boxes.select("det_id", *AXES), radius)
    start, end, centre = tuple(F.col(f"s{k}") for k in AXES), tuple(F.col(f"e{k}") for k in AXES), geometry.point()
    way, to = geometry.minus(end, start), geometry.minus(centre, start)
    t = geometry.dot(way, to) / F.greatest(geometry.dot(way, way), F.lit(1e-12))
    near = tuple(s + t * w for s, w in zip(start, way, strict=True))
    pairs = met_boxes(segments, named, 2.0 * radius)
    return pairs.filter((F.col("det_id") != F.col("a")) & (F.col("det_id") != F.col("b")) & (t > 0) & (t < 1) & (geometry.norm(geometry.minus(centre, near)) <= radius))


def blocked_length(segments: DataFrame, boxes: DataFrame, keys: list[str], ends: list[str], cell: float | None = None) -> DataFrame:
    """keys and ``blocked``, what of a segment (sx .. ez) lies in boxes (det_id, x, y, z and sizes) other than those of its ends. Each task adds up its own pairs first."""
    box = bounds(boxes.select("det_id", *AXES, *[f"s{a}" for a in AXES]))
    cell = cell or cell_size(box)
    box = box.select(F.col("det_id").alias("box"), *[F.col(a).alias(f"centre_{a}") for a in AXES], *[(F.col(f"s{a}") / 2).alias(f"half_{a}") for a in AXES], *[f"{p}_{a}" for p in ("low", "high") for a in AXES])
    other = F.col("box").isNotNull()
    for e in ends:
        other = other & (F.col("box") != F.col(e))
    named = lambda p: tuple(F.col(f"{p}{a}") for a in AXES)
    length = geometry.box_length(named("s"), named("e"), named("centre_"), named("half_"))
    pairs = met_boxes(segments.select(*dict.fromkeys([*keys, *ends]), *[f"{p}{a}" for p in "se" for a in AXES]), box, cell, "left")
    return pairs.groupBy(*keys).agg(F.coalesce(F.sum(F.when(other, length)), F.lit(0.0)).alias("blocked"))
