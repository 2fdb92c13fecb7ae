"""Local contrast recovery and variance of a penalised reconstruction, without and with the Fisher matrix.

For a matrix H with rows' sums p, F = H' diag(1/p) H and a quadratic penalty R of
neighbours on a 3-D grid, a pixel j has, with A = F + beta R, the contrast
recovery (inv(A) F)_jj and the variance (inv(A) F inv(A))_jj.

Matrix-free (``contrast_variance``): block conjugate gradients. All pixels and all
betas are columns of one right-hand side, so an iteration is one pass over the
rows whatever their number; each column stops by itself, and finished ones are
no longer multiplied. Columns go in blocks of ``COLUMNS``, which bounds what a
task and the driver hold.

Direct (``fisher_tiles``, ``cholesky``, ``solved``): F is a table of tiles, summed
from row blocks; a blocked factorisation works on the table, a step a tile column,
each step an equi-join of tiles, written so that no plan grows. No task ever
holds more than three tiles or ``HELD`` bytes of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, written
from .recon import _rows

#: Right-hand sides that are solved at once.
COLUMNS = 512
#: Numbers in a row of a distributed sum.
STRIP = 4096
#: Bytes of tiles that a task sums up by itself; beyond it, tiles meet by their place.
HELD = 256 << 20


def _add_strips(table: pa.Table) -> pa.Table:
    key = table.column(0)[0].as_py()
    total = sum(x.values.to_numpy() for x in table.column(1).combine_chunks())
    return pa.table({"strip": pa.array([key], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})


def summed_block(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all batches of an array of a fixed shape: a task adds up its own, and strips are added by their place."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += partial(b).ravel()
        if total.any():
            cut = [total[a : a + STRIP] for a in range(0, size, STRIP)]
            yield pa.RecordBatch.from_pydict({"strip": pa.array(range(len(cut)), pa.int32()), "v": pa.array(cut, pa.list_(pa.float64()))})

    prepare(df.sparkSession)
    out = np.zeros(size)
    for r in df.mapInArrow(run, "strip int, v array<double>").groupBy("strip").applyInArrow(_add_strips, "strip int, v array<double>").collect():  # the result's size
        out[r["strip"] * STRIP : (r["strip"] + 1) * STRIP] = r["v"]
    return out.reshape(shape)


def weighted_rows(matrix: DataFrame, floor: float = 1e-12) -> DataFrame:
    """h and d, one over the row's sum, which counts as ``floor`` at least."""
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return matrix.select("h", (1 / F.greatest(total, F.lit(floor))).alias("d"))


def fisher_times(weighted: DataFrame, x: np.ndarray) -> np.ndarray:
    """F times the columns of x. One distributed sum."""

    def partial(b: pa.RecordBatch) -> np.ndarray:
        h, d = _rows(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
        return h.T @ (d[:, None] * (h @ x))

    return summed_block(weighted.select("h", "d"), partial, x.shape)


def fisher_diagonal(weighted: DataFrame, pixels: int) -> np.ndarray:
    return summed_block(weighted.select("h", "d"), lambda b: (_rows(b.column(0)) ** 2 * b.column(1).to_numpy(zero_copy_only=False)[:, None]).sum(axis=0), (pixels,))


def penalty_weights(spacing: tuple[float, float, float] | None) -> tuple[float, float, float]:
    """Weights of differences along x, y and z: one over the squared spacing if it is given."""
    return tuple(1.0 / (s * s) for s in spacing) if spacing else (1.0, 1.0, 1.0)


def penalty_times(x: np.ndarray, shape: tuple[int, int, int], spacing: tuple[float, float, float] | None = None) -> np.ndarray:
    """R times the columns of x: own value less the neighbours', on a grid of nx, ny, nz pixels (x runs first)."""
    grid = x.reshape(*shape[::-1], -1)
    out = np.zeros_like(grid)
    for axis, w in zip((2, 1, 0), penalty_weights(spacing), strict=True):
        step = w * np.diff(grid, axis=axis)
        low, high = [slice(None)] * 4, [slice(None)] * 4
        low[axis], high[axis] = slice(None, -1), slice(1, None)
        out[tuple(high)] += step
        out[tuple(low)] -= step
    return out.reshape(x.shape)


def penalty_matrix(shape: tuple[int, int, int], spacing: tuple[float, float, float] | None = None) -> Iterator[tuple[int, int, float]]:
    """(i, j, value) of R where it isn't 0."""
    nx, ny, nz = shape
    diagonal: dict[int, float] = {}
    for z in range(nz):
        for y in range(ny):
            for x in range(nx):
                i = (z * ny + y) * nx + x
                for (j, inside), w in zip(((i + 1, x + 1 < nx), (i + nx, y + 1 < ny), (i + nx * ny, z + 1 < nz)), penalty_weights(spacing), strict=True):
                    if inside:
                        yield i, j, -w
                        yield j, i, -w
                        diagonal[i], diagonal[j] = diagonal.get(i, 0.0) + w, diagonal.get(j, 0.0) + w
    for i, w in diagonal.items():
        yield i, i, w


def block_conjugate_gradients(times: Callable[[np.ndarray, np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray, tolerance: float = 1e-8, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(x, iterations) of times(x) = b for all columns at once, preconditioned by diagonals; times(x, columns) multiplies the columns of these numbers. A column whose residual is small enough leaves the block."""
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal
    p, rz = z.copy(), (r * z).sum(axis=0)
    limit, steps = tolerance * np.linalg.norm(b, axis=0), np.zeros(b.shape[1], int)
    for _ in range(most):
        go = np.flatnonzero(np.linalg.norm(r, axis=0) > limit)
        if not len(go):
            break
        ap = times(p[:, go], go)
        alpha = rz[go] / np.maximum((p[:, go] * ap).sum(axis=0), 1e-300)
        x[:, go] += p[:, go] * alpha
        r[:, go] -= ap * alpha
        steps[go] += 1
        z = r[:, go] / diagonal[:, go]
        now = (r[:, go] * z).sum(axis=0)
        p[:, go] = z + p[:, go] * (now / np.maximum(rz[go], 1e-300))
        rz[go] = now
    return x, steps


def contrast_variance(matrix: DataFrame, shape: tuple[int, int, int], betas: list[float], pixels: list[int] | None = None, spacing: tuple[float, float, float] | None = None, tolerance: float = 1e-8, most: int = 500) -> DataFrame:
    """beta, pixel_id, contrast, variance and iterations of each pixel (all, if none are named) for each beta. matrix: h, an array over the pixels of the grid."""
    weighted = written(weighted_rows(matrix), "weighted")
    n = int(np.prod(shape))
    wanted = [(b, p) for b in betas for p in (range(n) if pixels is None else pixels)]
    fisher, penalty = fisher_diagonal(weighted, n), np.zeros(n)
    for i, j, w in penalty_matrix(shape, spacing):
        penalty[i] += w if i == j else 0.0
    rows = []
    for a in range(0, len(wanted), COLUMNS):
        beta, pixel = (np.array(x) for x in zip(*wanted[a : a + COLUMNS], strict=True))
        unit = np.zeros((n, len(beta)))
        unit[pixel, np.arange(len(beta))] = 1
        x, steps = block_conjugate_gradients(lambda v, go, beta=beta: fisher_times(weighted, v) + beta[go] * penalty_times(v, shape, spacing), unit, np.maximum(fisher[:, None] + beta * penalty[:, None], 1e-12), tolerance, most)
        fx = fisher_times(weighted, x)
        rows += zip(beta.tolist(), pixel.tolist(), fx[pixel, np.arange(len(beta))].tolist(), (x * fx).sum(axis=0).tolist(), steps.tolist(), strict=True)
    return matrix.sparkSession.createDataFrame(rows, "beta double, pixel_id int, contrast double, variance double, iterations int")


def curve(study: DataFrame, weights: DataFrame) -> DataFrame:
    """beta, contrast and variance: means over sample pixels (pixel_id, weight), the curve of a system."""
    met = study.join(F.broadcast(weights), "pixel_id")  # a grid's sample pixels
    return met.groupBy("beta").agg(F.sum(F.col("contrast") * F.col("weight")).alias("contrast"), F.sum(F.col("variance") * F.col("weight")).alias("variance"))


def beta_schedule(low: int, high: int, steps: tuple[float, ...] = (1.0, 2.0, 5.0)) -> list[float]:
    """The steps times each power of ten from ``low`` to the one before ``high``."""
    return [m * 10.0**k for k in range(low, high) for m in steps]


_TILES = "i int, j int, tile array<double>"


def _tile(x) -> np.ndarray:
    return np.asarray(x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) else x, float)


def _row(i: int, j: int, tile: np.ndarray) -> tuple[int, int, np.ndarray]:
    return i, j, np.ascontiguousarray(tile).ravel()


def _batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"i": pa.array([r[0] for r in rows], pa.int32()), "j": pa.array([r[1] for r in rows], pa.int32()), "tile": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})


def _edges(pixels: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, pixels)) for a in range(0, pixels, size)]


def _add_tiles(table: pa.Table) -> pa.Table:
    total = sum(_tile(x) for x in table.column("tile").combine_chunks())
    return pa.Table.from_batches([_batch([(table.column("i")[0].as_py(), table.column("j")[0].as_py(), total)])])


def fisher_tiles(matrix: DataFrame, pixels: int, size: int) -> DataFrame:
    """Tiles (i, j, tile: row by row) of F with i >= j."""
    edges = _edges(pixels, size)
    pairs = [(i, j) for i in range(len(edges)) for j in range(i + 1)]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's own sums, where they fit."""
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if len(b):
                h, d = _rows(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
                for i, j in pairs:
                    part = h[:, slice(*edges[i])].T @ (d[:, None] * h[:, slice(*edges[j])])
                    total[i, j] = total[i, j] + part if (i, j) in total else part
        for (i, j), tile in total.items():
            yield _batch([_row(i, j, tile)])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both sides of each tile, a row a batch of rows: tile holds the two, one after the other."""
        for b in batches:
            if len(b):
                h, root = _rows(b.column(0)), np.sqrt(b.column(1).to_numpy(zero_copy_only=False))[:, None]
                for i, j in pairs:
                    yield _batch([(i, j, np.concatenate([(h[:, slice(*edges[i])] * root).ravel(), (h[:, slice(*edges[j])] * root).ravel()]))])

    def multiplied(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        wide, high, total = edges[i][1] - edges[i][0], edges[j][1] - edges[j][0], 0.0
        for x in table.column("tile").combine_chunks():
            both = _tile(x)
            n = len(both) // (wide + high)
            total = total + both[: n * wide].reshape(n, wide).T @ both[n * wide :].reshape(n, high)
        return pa.Table.from_batches([_batch([_row(i, j, total)])])

    weighted = weighted_rows(matrix)
    prepare(matrix.sparkSession)
    if 8 * pixels * (pixels + size) // 2 <= HELD:
        return weighted.mapInArrow(alone, _TILES).groupBy("i", "j").applyInArrow(_add_tiles, _TILES)
    parts = F.spark_partition_id() % 64  # what meets at a tile, in parts
    met = weighted.mapInArrow(sent, _TILES).withColumn("part", parts).groupBy("i", "j", "part").applyInArrow(lambda t: multiplied(t.drop(["part"])), _TILES)
    return met.groupBy("i", "j").applyInArrow(_add_tiles, _TILES)


def entries(tiles: DataFrame, pixels: int, size: int) -> DataFrame:
    """i, j and v: the numbers of a symmetric matrix's tiles, both halves."""
    wide = F.least(F.lit(size), F.lit(pixels) - F.col("j") * size)
    flat = tiles.select("i", "j", wide.alias("wide"), F.posexplode("tile").alias("at", "v"))
    low = flat.select((F.col("i") * size + F.floor(F.col("at") / F.col("wide"))).cast("int").alias("i"), (F.col("j") * size + F.col("at") % F.col("wide")).cast("int").alias("j"), "v")
    return low.unionByName(low.filter("i div {0} <> j div {0}".format(size)).select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def penalised(tiles: DataFrame, beta: float, shape: tuple[int, int, int], size: int, spacing: tuple[float, float, float] | None = None) -> DataFrame:
    """Tiles of F + beta R."""
    n = int(np.prod(shape))
    edges = _edges(n, size)
    held: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for p, q, w in penalty_matrix(shape, spacing):  # a few numbers a pixel
        if p // size >= q // size:
            held.setdefault((p // size, q // size), []).append((p % size, q % size, beta * w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                tile = _tile(x).copy().reshape(edges[i][1] - edges[i][0], -1)
                for p, q, w in held.get((i, j), ()):
                    tile[p, q] += w
                yield _batch([_row(i, j, tile)])

    return tiles.mapInArrow(run, _TILES)


def _solve_lower(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """inv(low) b for a lower triangle, a row a step."""
    x = b.copy()
    for k in range(len(low)):
        x[k] = (x[k] - low[k, :k] @ x[:k]) / low[k, k]
    return x


def _mapped(df: DataFrame, f: Callable[..., np.ndarray]) -> DataFrame:
    """i, j and f of a row's further columns, arrays of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                i, j, *rest = (b.column(c)[k] for c in range(b.num_columns))
                yield _batch([_row(i.as_py(), j.as_py(), f(i.as_py(), j.as_py(), *[_tile(x) for x in rest]))])

    return df.mapInArrow(run, _TILES)


def cholesky(tiles: DataFrame, pixels: int, size: int) -> DataFrame:
    """Tiles of the lower factor L of a symmetric positive matrix. A step a tile column: the diagonal tile is factored, the tiles below are solved with it, and what is right of them is updated by two equi-joins."""
    edges = _edges(pixels, size)
    high = [b - a for a, b in edges]
    left, done = written(tiles, "tiles"), None
    for k in range(len(edges)):
        column = left.filter(F.col("j") == k)
        top = column.filter(F.col("i") == k).select(F.col("tile").alias("top"))  # one tile
        panel = _mapped(column.crossJoin(F.broadcast(top)), lambda i, j, t, d, k=k: np.linalg.cholesky(d.reshape(high[k], high[k])) if i == k else _solve_lower(np.linalg.cholesky(d.reshape(high[k], high[k])), t.reshape(high[i], high[k]).T).T)
        panel = written(panel, f"panel{k}")
        done = panel if done is None else done.unionByName(panel)
        if k + 1 < len(edges):
            below = panel.filter(F.col("i") > k)
            rest = left.filter(F.col("j") > k)
            met = rest.join(below.select("i", F.col("tile").alias("a")), "i").join(below.select(F.col("i").alias("j"), F.col("tile").alias("b")), "j").select("i", "j", "tile", "a", "b")
            left = written(_mapped(met, lambda i, j, t, a, b, k=k: t.reshape(high[i], high[j]) - a.reshape(high[i], high[k]) @ b.reshape(high[j], high[k]).T), f"left{k}")
    return written(done, "factor")


def solved(factor: DataFrame, right: DataFrame, pixels: int, size: int) -> DataFrame:
    """Tiles X (i, j: a block of columns) of L L' X = B: once down the tile rows, once up."""
    edges = _edges(pixels, size)
    high = [b - a for a, b in edges]
    n, x = len(edges), written(right, "right")
    for up in (False, True):
        out = None
        for k in reversed(range(n)) if up else range(n):
            top = factor.filter((F.col("i") == k) & (F.col("j") == k)).select(F.col("tile").alias("top"))  # one tile
            mine = x.filter(F.col("i") == k).crossJoin(F.broadcast(top))
            one = written(_mapped(mine, lambda i, j, t, d, k=k, up=up: np.linalg.solve(d.reshape(high[k], high[k]).T if up else d.reshape(high[k], high[k]), t.reshape(high[k], -1))), f"row{k}")
            out = one if out is None else out.unionByName(one)
            others = x.filter(F.col("i") < k if up else F.col("i") > k)
            by = factor.filter((F.col("i") == k) & (F.col("j") < k)).select(F.col("j").alias("i"), F.col("tile").alias("l")) if up else factor.filter((F.col("j") == k) & (F.col("i") > k)).select("i", F.col("tile").alias("l"))
            if k != (0 if up else n - 1):
                met = others.join(by, "i").join(one.select("j", F.col("tile").alias("y")), "j").select("i", "j", "tile", "l", "y")
                x = written(_mapped(met, lambda i, j, t, l, y, k=k, up=up: t.reshape(high[i], -1) - (l.reshape(high[k], high[i]).T if up else l.reshape(high[i], high[k])) @ y.reshape(high[k], -1)), f"left{k}")
        x = written(out, "solved")
    return x


def times_tiles(tiles: DataFrame, x: DataFrame, pixels: int, size: int) -> DataFrame:
    """Tiles of a symmetric matrix (its lower half) times X."""
    high = [b - a for a, b in _edges(pixels, size)]
    both = tiles.select("i", "j", "tile", F.lit(0.0).alias("turned")).unionByName(tiles.filter("i > j").select(F.col("j").alias("i"), F.col("i").alias("j"), "tile", F.lit(1.0).alias("turned")))
    met = both.join(x.select(F.col("i").alias("m"), F.col("j").alias("c"), F.col("tile").alias("x")), F.col("j") == F.col("m"))
    met = met.select("i", F.col("c").alias("j"), "tile", "x", F.array("turned", F.col("m").cast("double")).alias("how"))
    part = _mapped(met, lambda i, j, t, v, how: (t.reshape(high[int(how[1])], high[i]).T if how[0] else t.reshape(high[i], high[int(how[1])])) @ v.reshape(high[int(how[1])], -1))
    return part.groupBy("i", "j").applyInArrow(_add_tiles, _TILES)


def direct_contrast_variance(matrix: DataFrame, shape: tuple[int, int, int], betas: list[float], size: int, pixels: list[int] | None = None, spacing: tuple[float, float, float] | None = None) -> DataFrame:
    """beta, pixel_id, contrast and variance by the factored matrix; the same numbers as ``contrast_variance``."""
    n = int(np.prod(shape))
    chosen = list(range(n)) if pixels is None else list(pixels)
    spark, edges, blocks = matrix.sparkSession, _edges(n, size), _edges(len(chosen), size)
    fisher = written(fisher_tiles(matrix, n, size), "fisher")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.array(chosen[slice(*blocks[j])])
                yield _batch([_row(i, j, (np.arange(*edges[i])[:, None] == own[None, :]).astype(float))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x, fx in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                own = np.array(chosen[slice(*blocks[j])])
                x, fx = _tile(x).reshape(-1, len(own)), _tile(fx).reshape(-1, len(own))
                here = np.arange(*edges[i])[:, None] == own[None, :]
                yield pa.RecordBatch.from_pydict({"pixel_id": own.astype(np.int32), "contrast": (fx * here).sum(axis=0), "variance": (x * fx).sum(axis=0)})

    at = spark.range(len(edges) * len(blocks)).select(F.floor(F.col("id") / len(blocks)).cast("int").alias("i"), (F.col("id") % len(blocks)).cast("int").alias("j"))
    out = None
    for beta in betas:
        x = solved(cholesky(penalised(fisher, beta, shape, size, spacing), n, size), at.mapInArrow(units, _TILES), n, size)
        both = x.join(times_tiles(fisher, x, n, size).select("i", "j", F.col("tile").alias("fx")), ["i", "j"])
        one = both.mapInArrow(measure, "pixel_id int, contrast double, variance double").groupBy("pixel_id").agg(F.sum("contrast").alias("contrast"), F.sum("variance").alias("variance")).select(F.lit(float(beta)).alias("beta"), "pixel_id", "contrast", "variance")
        out = one if out is None else out.unionByName(one)
    return out
