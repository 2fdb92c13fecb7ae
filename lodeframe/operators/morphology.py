"""Shapes of masks on grids: dilation, erosion, opening, closing, connected parts, holes.

A mask is a table of the cells that are on (groups, ix, iy, iz). Cells go to
blocks of ``BLOCK`` cells an axis, with a halo of their neighbours where a window
needs one; numpy works on a block, and no task sees more than a block. Connected
parts are named within blocks first; only pairs of parts that touch across a
block's face travel on, and a few rounds of a join over those pairs name the
whole parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, written

AXES = ["ix", "iy", "iz"]
BLOCK = 16


def ball(radius: int, flat: bool = False) -> list[tuple[int, int, int]]:
    """Offsets within a radius; ``flat``: of a disk in a plane."""
    r = range(-radius, radius + 1)
    return [(x, y, z) for x in r for y in r for z in ([0] if flat else r) if x * x + y * y + z * z <= radius * radius]


CROSS = [o for o in ball(1) if any(o)]


def in_blocks(mask: DataFrame, halo: tuple[int, int, int], *groups: str, size: int = BLOCK) -> DataFrame:
    """``mask`` with block, an array of the three numbers of each block whose cells, or whose halo (cells by axis), it lies in."""
    out = mask.select(*groups, *AXES)
    for a, h in zip(AXES, halo, strict=True):
        at = lambda by, a=a: F.floor((F.col(a) + by) / size)
        place = F.explode(F.sequence(at(-h), at(h)).cast("array<int>")) if h else at(0).cast("int")
        out = out.withColumn(f"__{a}", place)
    return out.withColumn("block", F.array(*[F.col(f"__{a}") for a in AXES])).drop(*[f"__{a}" for a in AXES])


#: Cells of blocks that a task works on at once.
CELLS = 1 << 20


def _by_blocks(mask: DataFrame, halo: tuple[int, int, int], groups: tuple[str, ...], size: int, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], kinds: str) -> DataFrame:
    """What ``work`` makes of blocks with their halo, many at a time.

    A block travels as one row: its groups, its number and the places of its cells
    that are on. work gets (cells on, origins) of some blocks, as arrays (blocks,
    x, y, z) and (blocks, 3), and gives rows (block in the array, ix, iy, iz) and
    further columns. kinds: the schema of the rows, groups first.
    """
    wide = [size + 2 * h for h in halo]
    place = F.lit(0)
    for k, (a, h, w) in enumerate(zip(AXES, halo, wide, strict=True)):
        place = place * w + (F.col(a) - F.col("block")[k] * size + h)
    rows = in_blocks(mask, halo, *groups, size=size).groupBy(*groups, "block").agg(F.collect_list(place.cast("int")).alias("on"))
    step = max(1, CELLS // math.prod(wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), step):
                b = whole.slice(start, step)
                lists = b.column("on")
                on = np.zeros((len(b), math.prod(wide)), bool)
                on[np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
                origin = b.column("block").flatten().to_numpy().reshape(-1, 3).astype(int) * size - np.array(halo)
                at, more = work(on.reshape(-1, *wide), origin)
                own = {g: b.column(g).take(pa.array(at[:, 0])) for g in groups}
                yield pa.RecordBatch.from_pydict(own | {a: pa.array(at[:, 1 + k].astype(np.int32)) for k, a in enumerate(AXES)} | {n: pa.FixedSizeListArray.from_arrays(pa.array(v.astype(np.int32).ravel()), 3).cast(pa.list_(pa.int32())) for n, v in more.items()})

    prepare(mask.sparkSession)
    return rows.mapInArrow(run, kinds)


def _kinds(df: DataFrame, groups: tuple[str, ...]) -> str:
    return ", ".join([*[f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups], "ix int, iy int, iz int"])


def _windowed(mask: DataFrame, shape: tuple[int, int, int], offsets: list[tuple[int, int, int]], every: bool, groups: tuple[str, ...], size: int) -> DataFrame:
    halo = tuple(max(abs(o[k]) for o in offsets) for k in range(3))

    def work(on: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        if every:  # what lies beyond the grid counts as on
            for k, n in enumerate(shape):
                at = origin[:, k, None] + np.arange(on.shape[1 + k])
                on |= np.expand_dims((at < 0) | (at >= n), tuple(j for j in (1, 2, 3) if j != 1 + k))
        inner = lambda o: on[(slice(None), *[slice(h + d, h + d + size) for h, d in zip(halo, o, strict=True)])]
        out = (np.logical_and if every else np.logical_or).reduce([inner(o) for o in offsets])
        at = np.stack(np.nonzero(out), axis=1)
        at[:, 1:] += origin[at[:, 0]] + np.array(halo)
        return at[((at[:, 1:] >= 0) & (at[:, 1:] < np.array(shape))).all(axis=1)], {}

    return _by_blocks(mask, halo, groups, size, work, _kinds(mask, groups))


def dilated(mask: DataFrame, shape: tuple[int, int, int], offsets: list[tuple[int, int, int]], *groups: str, size: int = BLOCK) -> DataFrame:
    """Cells with a cell that is on at one of the offsets."""
    return _windowed(mask, shape, [tuple(-d for d in o) for o in offsets], False, groups, size)


def eroded(mask: DataFrame, shape: tuple[int, int, int], offsets: list[tuple[int, int, int]], *groups: str, size: int = BLOCK) -> DataFrame:
    """Cells that are on at all offsets; what lies beyond the grid counts as on."""
    return _windowed(mask, shape, offsets, True, groups, size)


def opened(mask: DataFrame, shape: tuple[int, int, int], offsets: list[tuple[int, int, int]], *groups: str, size: int = BLOCK) -> DataFrame:
    return dilated(eroded(mask, shape, offsets, *groups, size=size), shape, offsets, *groups, size=size)


def closed(mask: DataFrame, shape: tuple[int, int, int], offsets: list[tuple[int, int, int]], *groups: str, size: int = BLOCK) -> DataFrame:
    return eroded(dilated(mask, shape, offsets, *groups, size=size), shape, offsets, *groups, size=size)


def _parts(on: np.ndarray, near: list[tuple[int, int, int]]) -> np.ndarray:
    """Number, from 1, of each cell's part within its block of an array (blocks, x, y, z); 0 where it is off. Cells take the least number around them, and then that cell's, until nothing changes."""
    n = on[0].size
    name = np.where(on, np.arange(1, n + 1).reshape(on.shape[1:]), 0)
    while True:
        wide = np.pad(np.where(on, name, n + 1), ((0, 0), (1, 1), (1, 1), (1, 1)), constant_values=n + 1)
        least = name.copy()
        for o in near:
            least = np.minimum(least, wide[(slice(None), *[slice(1 + d, 1 + d + s) for d, s in zip(o, on.shape[1:], strict=True)])])
        least = np.where(on, least, 0)
        jump = np.pad(least.reshape(len(on), n), ((0, 0), (1, 0)))
        least = np.where(on, np.take_along_axis(jump, least.reshape(len(on), n), axis=1).reshape(on.shape), 0)
        if (least == name).all():
            return name
        name = least


def _spread(df: DataFrame) -> DataFrame:
    """Tables of cells and parts grow with the masks, and their files are far smaller than their rows: joins with them must not send them to the driver."""
    return df.hint("merge")


def components(pairs: DataFrame) -> DataFrame:
    """node and root, the least node that it hangs together with, of pairs (a, b). Each round every node takes the least root around it and then that root's own; rounds grow with the logarithm of a part's length, and each is written."""
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        seen = both.join(_spread(roots.select(F.col("node").alias("b"), F.col("root").alias("r"))), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hung = roots.join(_spread(seen), "node").select("node", F.col("root").alias("before"), F.least("root", "r").alias("low"))
        told = hung.groupBy(F.col("before").alias("top")).agg(F.min("low").alias("its"))  # a root hears what its nodes have found
        next_ = hung.join(_spread(told), hung["low"] == told["top"], "left").join(_spread(told.select(F.col("top").alias("old"), F.col("its").alias("olds"))), hung["before"] == F.col("old"), "left")
        next_ = written(next_.select("node", "before", F.least("low", F.coalesce("its", "low"), F.coalesce("olds", "low")).alias("root")), "roots")
        if next_.filter("root <> before").isEmpty():
            return next_.select("node", "root")
        roots = next_.select("node", "root")


def labelled(mask: DataFrame, *groups: str, near: list[tuple[int, int, int]] | None = None, size: int = BLOCK) -> DataFrame:
    """``mask`` with part, a number that the cells of one connected part share (within their group). near: offsets of neighbours; cells that share a face, if none are given."""
    near = near or CROSS
    kinds = _kinds(mask, groups)

    def inside(on: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        at = np.stack(np.nonzero(on), axis=1)
        first = np.stack(np.unravel_index(_parts(on, near)[tuple(at.T)] - 1, on.shape[1:]), axis=1) + origin[at[:, 0]]  # the part's first cell
        at[:, 1:] += origin[at[:, 0]]
        return at, {"first": first}

    local = _by_blocks(mask, (0, 0, 0), groups, size, inside, f"{kinds}, first array<int>")
    node = F.struct(*[F.col(g) for g in groups], F.col("first"))
    local = written(local.withColumn("node", node).drop("first"), "local")
    half = [o for o in near if o > (0, 0, 0)]
    outer = lambda a: (F.col(a) % size == 0) | (F.col(a) % size == size - 1)
    rim = local.filter(outer("ix") | outer("iy") | outer("iz"))
    ask = rim.select(*groups, F.col("node").alias("a"), F.explode(F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(AXES, o, strict=True)]) for o in half])).alias("to")).select(*groups, "a", "to.*")
    met = ask.join(_spread(rim.select(*groups, *AXES, F.col("node").alias("b"))), [*groups, *AXES]).filter(F.col("a") != F.col("b")).select("a", "b").distinct()
    met = written(met, "touching")
    if met.isEmpty():
        named = local.withColumn("root", F.col("node"))
    else:
        named = local.join(_spread(components(met)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.select(*groups, *AXES, F.col("root.first").alias("part"))


def largest(parts: DataFrame, *groups: str) -> DataFrame:
    """The cells of each group's largest part, of equal ones the one with the least name."""
    sizes = parts.groupBy(*groups, "part").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy(*groups).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("part"))).alias("b")).select(*groups, F.col("b.part").alias("part"))
    return parts.join(_spread(best), [*groups, "part"], "left_semi")


def complement(mask: DataFrame, shape: tuple[int, int, int], *groups: str) -> DataFrame:
    """The cells of the grid that are off, of every group that has one that is on."""
    axis = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    every = mask.select(*groups).distinct() if groups else mask.limit(1).select(F.lit(0).alias("__one"))
    for a, n in zip(AXES, shape, strict=True):
        every = every.withColumn(a, F.explode(axis(n)))
    return every.join(_spread(mask.select(*groups, *AXES)), [*groups, *AXES], "left_anti").select(*groups, *AXES)


def filled(mask: DataFrame, shape: tuple[int, int, int], *groups: str, flat: bool = False, size: int = BLOCK) -> DataFrame:
    """``mask`` and its holes: parts of the background that don't reach the grid's border. flat: in each plane by itself."""
    near = [o for o in CROSS if not (flat and o[2])]
    parts = labelled(complement(mask, shape, *groups), *groups, near=near, size=size)
    sides = [(a, n) for a, n in zip(AXES, shape, strict=True) if not (flat and a == "iz")]
    rim = F.lit(False)
    for a, n in sides:
        rim = rim | (F.col(a) == 0) | (F.col(a) == n - 1)
    open_ = parts.filter(rim).select(*groups, "part").distinct()
    holes = parts.join(_spread(open_), [*groups, "part"], "left_anti").select(*groups, *AXES)
    return mask.select(*groups, *AXES).unionByName(holes)
