"""Iterative multiplicative reconstruction: projections, sensitivities, MLEM, OSEM, list-mode and joint updates.

A system matrix is a table of rows (bin_id, h array over the pixels), a list of
events one of rows (t array). Each update is one distributed aggregate: a task
multiplies its batches of rows with numpy and returns one partial vector, and
the vectors are summed by pixel. The image, whose size is that of the grid and
not of the data, stays on the driver between updates, so no plan grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare, written

FLOOR = 1e-12


def _rows(column) -> np.ndarray:
    """(rows, pixels) of a column of arrays of one length; nulls within count as 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.nan_to_num(flat).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _summed(df: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray | None], pixels: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pixels)
        for b in batches:
            if len(b):
                total += partial(b)
        if total.any():
            yield pa.RecordBatch.from_pydict({"pixel_id": np.arange(pixels, dtype=np.int32), "v": total})

    prepare(df.sparkSession)
    got = df.mapInArrow(run, "pixel_id int, v double").groupBy("pixel_id").agg(F.sum("v").alias("v")).collect()  # a row a pixel
    out = np.zeros(pixels)
    for r in got:
        out[r["pixel_id"]] = r["v"]
    return out


def _whole(column) -> np.ndarray:
    """Rows over their sums; those whose sum isn't positive and finite go."""
    t = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    total = t.sum(axis=1)
    good = np.isfinite(total) & (total > 0)
    return t[good] / total[good, None]


def sensitivity(matrix: DataFrame, pixels: int, column: str = "h", normalised: bool = False) -> np.ndarray:
    """Sum of the rows; ``normalised``: of the rows over their sums, as ``normalised_rows`` makes them, within the same worker."""
    part = _whole if normalised else _rows
    return _summed(matrix.select(column), lambda b: part(b.column(0)).sum(axis=0), pixels)


def _table(ids: list, names: list[str], rows: np.ndarray) -> pa.RecordBatch:
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))
    return pa.RecordBatch.from_arrays([*ids, flat], names)


def normalised_rows(rows: DataFrame, column: str = "t", times: str | None = None) -> DataFrame:
    """Event rows (an array over the pixels), first times another row if asked, over their sums. Rows whose sum isn't positive and finite go. Other columns stay."""
    keys = [c for c in rows.columns if c not in (column, times)]
    df = rows.select(*keys, column, *[times] * (times is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                t = b.column(len(keys)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)
                if times:
                    t = t * b.column(len(keys) + 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)
                total = t.sum(axis=1)
                good = np.isfinite(total) & (total > 0)
                if good.any():
                    yield _table([b.column(k).filter(pa.array(good)) for k in range(len(keys))], [*keys, column], t[good] / total[good, None])

    prepare(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    return df.mapInArrow(run, f"{schema}, `{column}` array<double>")


def through(matrix: DataFrame, weights: np.ndarray, column: str = "h") -> DataFrame:
    """bin_id and rows (an array over the fine pixels) times weights (fine, coarse): a matrix on a coarse grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _table([b.column(0)], ["bin_id", column], _rows(b.column(1)) @ weights)

    prepare(matrix.sparkSession)
    return matrix.select("bin_id", column).mapInArrow(run, f"bin_id {matrix.schema['bin_id'].dataType.simpleString()}, `{column}` array<double>")


def forward(matrix: DataFrame, image: np.ndarray) -> DataFrame:
    """bin_id and expected: each bin's row times the image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_rows(b.column(1)) @ image)], ["bin_id", "expected"])

    prepare(matrix.sparkSession)
    return matrix.select("bin_id", "h").mapInArrow(run, "bin_id long, expected double")


def back(measured: DataFrame, image: np.ndarray, floor: float | None = FLOOR) -> np.ndarray:
    """Sum over bins of h * y / (h . image); the expected counts are at least ``floor`` if given."""

    def partial(b: pa.RecordBatch) -> np.ndarray:
        h, y = _rows(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
        expected = h @ image
        expected = np.maximum(expected, floor) if floor is not None else np.where(expected == 0, np.nan, expected)
        return h.T @ np.nan_to_num(y / expected)

    return _summed(measured.select("h", "y"), partial, len(image))


def list_back(events: DataFrame, image: np.ndarray, floor: float | None = FLOOR) -> np.ndarray:
    """Sum over events of t / (t . image)."""

    def partial(b: pa.RecordBatch) -> np.ndarray:
        t = _rows(b.column(0))
        expected = t @ image
        return t.T @ (1 / np.maximum(expected, floor if floor is not None else np.finfo(float).tiny))

    return _summed(events.select("t"), partial, len(image))


def update_raw(image: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """image * w / s; infinite or NaN where s is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return image * w / s


def update_safe(image: np.ndarray, w: np.ndarray, s: np.ndarray, eps: float = FLOOR) -> np.ndarray:
    """0 where s isn't over eps; weights at least 0; NaN counts as 0."""
    out = np.where(s > eps, image * np.maximum(w, 0) / np.where(s > eps, s, 1), 0.0)
    return np.nan_to_num(out, nan=0.0)


def update_clamped(image: np.ndarray, w: np.ndarray, s: np.ndarray, eps: float = FLOOR, most: float = 1e12) -> np.ndarray:
    """s at least eps; a NaN ratio counts as 1, an infinite one as 1e6; results at most ``most``."""
    ratio = np.nan_to_num(w / np.maximum(s, eps), nan=1.0, posinf=1e6, neginf=0.0)
    return np.clip(np.nan_to_num(image * ratio, nan=0.0, posinf=most), 0.0, most)


UPDATES = {"raw": update_raw, "safe": update_safe, "clamped": update_clamped}


def mlem(measured: DataFrame, pixels: int, iterations: int, update: str = "safe", save_every: int = 0) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Image after some iterations from ones, and those saved on the way. measured: h and y."""
    measured = measured.persist()
    s, image, saved = sensitivity(measured, pixels), np.ones(pixels), []
    for i in range(1, iterations + 1):
        image = UPDATES[update](image, back(measured, image), s)
        if save_every and i % save_every == 0:
            saved.append((i, image))
    measured.unpersist()
    return image, saved


def osem(measured: DataFrame, pixels: int, iterations: int, subsets: int, subset: Column, update: str = "safe", turns: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Ordered subsets: one update a subset. ``subset``: a row's number from 0. turns[view]: the image that a view sees is image[turns[view]]; measured then has a column view."""
    measured = measured.withColumn("__subset", subset).persist()
    views = turns or {0: np.arange(pixels)}
    seen = lambda df, v: df.filter(F.col("view") == v) if turns else df
    unturn = {v: np.argsort(t) for v, t in views.items()}
    s = sum(sensitivity(seen(measured, v), pixels)[unturn[v]] for v in views) / len(views)
    image = np.ones(pixels)
    for _ in range(iterations):
        for k in range(subsets):
            part = measured.filter(F.col("__subset") == k)
            w = sum(back(seen(part, v), image[t])[unturn[v]] for v, t in views.items())
            image = UPDATES[update](image, w, s)
    measured.unpersist()
    return image


def joint(measured: DataFrame, events: DataFrame, pixels: int, iterations: int, alpha: float = 1.0, update: str = "safe") -> np.ndarray:
    """Joint updates: alpha times the bins' weights plus 2 - alpha times the events', over sensitivities mixed alike."""
    measured, events = measured.persist(), events.persist()
    s = alpha * sensitivity(measured, pixels) + (2 - alpha) * sensitivity(events, pixels, "t")
    image = np.ones(pixels)
    for _ in range(iterations):
        w = alpha * back(measured, image) + (2 - alpha) * list_back(events, image)
        image = UPDATES[update](image, w, s)
    for df in (measured, events):
        df.unpersist()
    return image


def turned_back(images: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Sum of images (views, pixels), each turned back from its view."""
    out = np.zeros(images.shape[1])
    for seen, turn in zip(images, turns, strict=True):
        out[turn] += seen
    return out


def views_back(measured: DataFrame, image: np.ndarray, turns: np.ndarray, floor: float | None = FLOOR) -> np.ndarray:
    """Weights of bins over all views, in one pass: measured has h and y, an array over the views; view v sees image[turns[v]]. A batch of rows is multiplied with the images of all views at once."""
    seen = image[turns].T

    def partial(b: pa.RecordBatch) -> np.ndarray:
        h, y = _rows(b.column(0)), _rows(b.column(1))
        expected = h @ seen
        expected = np.maximum(expected, floor) if floor is not None else np.where(expected == 0, np.nan, expected)
        return turned_back((h.T @ np.nan_to_num(y / expected)).T, turns)

    return _summed(measured.select("h", "y"), partial, len(image))


def views_list_back(events: DataFrame, image: np.ndarray, turns: np.ndarray, floor: float | None = FLOOR) -> np.ndarray:
    """Weights of event rows (view from 0, t) over all views, in one pass."""

    def partial(b: pa.RecordBatch) -> np.ndarray:
        t, view = _rows(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
        out = np.zeros(len(image))
        for v in np.unique(view):
            mine = t[view == v]
            expected = np.maximum(mine @ image[turns[v]], floor if floor is not None else np.finfo(float).tiny)
            out[turns[v]] += mine.T @ (1 / expected)
        return out

    return _summed(events.select("t", "view"), partial, len(image))


def views_sensitivity(turns: np.ndarray, measured: DataFrame | None = None, events: DataFrame | None = None, alpha: float = 1.0) -> np.ndarray:
    """Bins: the mean over the views of the rows' sum, turned back; events: the sum of their rows, turned back. Both are mixed as alpha and 2 - alpha."""
    pixels = turns.shape[1]
    bins = listed = np.zeros(pixels)
    if measured is not None:
        bins = turned_back(np.tile(sensitivity(measured, pixels), (len(turns), 1)), turns) / len(turns)

    def partial(b: pa.RecordBatch) -> np.ndarray:
        t, view = _rows(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
        out = np.zeros(pixels)
        for v in np.unique(view):
            out[turns[v]] += t[view == v].sum(axis=0)
        return out

    if events is not None:
        listed = _summed(events.select("t", "view"), partial, pixels)
    return bins if events is None else listed if measured is None else alpha * bins + (2 - alpha) * listed


def by_subset(df: DataFrame, subset: Column, name: str) -> list[DataFrame]:
    """The subsets 0, 1, .. of a table, written once in folders of their own, so that an update reads its subset alone."""
    table = written(df.withColumn("subset", subset.cast("int")).repartition("subset", F.spark_partition_id() % 8), name, "subset")  # some files a subset, not one of each task
    held = sorted(r["subset"] for r in table.select("subset").distinct().collect())  # a row a subset
    return [table.filter(F.col("subset") == k) for k in range(held[-1] + 1)] if held else []


def ordered(turns: np.ndarray, s: np.ndarray, iterations: int, bins: list[DataFrame] | None = None, events: list[DataFrame] | None = None, alpha: float = 1.0, update: str = "safe", save_every: int = 0, denoise: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Ordered subsets over bins (h, y over the views), over events (view, t), or over both with weights alpha and 2 - alpha.

    bins and events: a table a subset (see ``by_subset``). Rows of several
    energies are just more rows, as all weights of a subset are summed before the
    image is updated. An update is one pass over its subset for all views and
    energies. turns (views, pixels): view v sees image[turns[v]]. s: the
    sensitivity (``views_sensitivity``). Images are saved every so many
    iterations; ``denoise`` works on each updated image, cut off at 0 then.
    """
    image, saved = np.ones(turns.shape[1]), []
    both = bins is not None and events is not None
    steps = max(len(x) for x in (bins, events) if x is not None)
    for i in range(1, iterations + 1):
        for k in range(steps):
            w = np.zeros_like(image)
            if bins is not None and k < len(bins):
                w += (alpha if both else 1.0) * views_back(bins[k], image, turns)
            if events is not None and k < len(events):
                w += (2 - alpha if both else 1.0) * views_list_back(events[k], image, turns)
            image = UPDATES[update](image, w, s)
            if denoise is not None:
                image = np.maximum(denoise(image), 0)
        if save_every and i % save_every == 0:
            saved.append((i, image.copy()))
    return image, saved


def image_table(like: DataFrame, image: np.ndarray) -> DataFrame:
    """pixel_id and v of an image."""
    return like.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(image)], "pixel_id int, v double")


def safe_update(image: Column, w: Column, s: Column, eps: float = FLOOR) -> Column:
    return F.when(s > eps, F.coalesce(F.nanvl(image * F.greatest(w, F.lit(0.0)) / F.when(s > eps, s), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)


def clamped_update(image: Column, w: Column, s: Column, eps: float = FLOOR, most: float = 1e12) -> Column:
    r = F.nanvl(w / F.greatest(s, F.lit(eps)), F.lit(1.0))
    return F.least(F.greatest(image * F.when(r == float("inf"), 1e6).when(r == float("-inf"), 0.0).otherwise(r), F.lit(0.0)), F.lit(most))


def project_long(matrix: DataFrame, image: DataFrame) -> DataFrame:
    """Forward projection of a long matrix (bin_id, pixel_id, h) as a join and a sum."""
    return matrix.join(image, "pixel_id").groupBy("bin_id").agg(F.sum(F.col("h") * F.col("v")).alias("expected"))


def back_long(matrix: DataFrame, ratio: DataFrame) -> DataFrame:
    """Back-projection of a ratio (bin_id, r) through a long matrix."""
    return matrix.join(ratio, "bin_id").groupBy("pixel_id").agg(F.sum(F.col("h") * F.col("r")).alias("w"))


def summed(parts: list[DataFrame]) -> DataFrame:
    """pixel_id and v: the sum of images (pixel_id, v), as of several energies."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("pixel_id").agg(F.sum("v").alias("v"))
