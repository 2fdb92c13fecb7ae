"""Settings of a reconstruction run, their checks, hooks on images and kernels, and runs of several settings."""

from __future__ import annotations

import argparse
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernel, recon

#: A hook on an image on its square grid, as a denoiser: shape (ny, nx) in and out.
Hook = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Run:
    """Options of a run; ``checked`` says what doesn't fit."""

    nx: int = 8
    ny: int = 8
    iterations: int = 4
    saves: int = 2
    subsets: int = 1
    views: int = 1
    alpha: float = 1.0
    sparse: bool = False
    stride: int = 1

    def checked(self) -> Run:
        for f in fields(self):
            if f.type == "int" and getattr(self, f.name) < 1:
                raise ValueError(f"{f.name} must be 1 or more")
        if self.iterations % self.saves:
            raise ValueError("saves must divide iterations")
        if not 0 <= self.alpha <= 2:
            raise ValueError("alpha goes from 0 to 2")
        if self.stride > 1 and not self.sparse:
            raise ValueError("a stride needs sparse rows")
        return self


def parsed(words: list[str] | None = None) -> Run:
    """A run from a command line: an option for each field."""
    p = argparse.ArgumentParser(description="reconstruction run")
    for f in fields(Run):
        kind = {"int": int, "float": float}.get(f.type)
        p.add_argument(f"--{f.name}", **({"type": kind} if kind else {"action": "store_true"}), default=f.default)
    return Run(**vars(p.parse_args(words))).checked()


def reconstruct(measured: DataFrame | None, run: Run, denoise: Hook | None = None, events: DataFrame | None = None, turns: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """Saved images (iteration, image) of a run with all its options: ordered subsets over all views of bins (bin_id, h, y: an array over the views, or one number for one view), of events (event_id, view from 0, t), or of both with the run's alpha.

    turns (views, pixels): view v sees image[turns[v]]; without it no view is
    turned. ``denoise`` works on the square image after each update.
    """
    run = run.checked()
    pixels = run.nx * run.ny
    turns = np.tile(np.arange(pixels), (run.views, 1)) if turns is None else np.asarray(turns)
    if turns.shape != (run.views, pixels):
        raise ValueError(f"turns must have {run.views} views of {pixels} pixels")
    if measured is None and events is None:
        raise ValueError("nothing to reconstruct from")
    if measured is not None and measured.schema["y"].dataType.typeName() != "array":
        measured = measured.withColumn("y", F.array(*[F.col("y")] * run.views))
    part = lambda id_col: F.pmod(F.xxhash64(id_col), F.lit(run.subsets))
    bins = None if measured is None else recon.by_subset(measured, part("bin_id"), "bins")
    lists = None if events is None else recon.by_subset(events, part("event_id"), "events")
    s = recon.views_sensitivity(turns, measured, events, run.alpha)
    square = None if denoise is None else (lambda image: np.asarray(denoise(image.reshape(run.ny, run.nx)), float).reshape(-1))
    return recon.ordered(turns, s, run.iterations, bins, lists, run.alpha, save_every=run.iterations // run.saves, denoise=square)[1]


def event_rows(located_events: DataFrame, pixels: DataFrame, matrix: DataFrame, run: Run, e0: float, resolution: float, support: float, generate: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Event rows of a run (see ``kernel.rows``); kernels of sparse rows and coarse grids can't be generated."""
    if generate is not None and (run.checked().sparse or run.stride > 1):
        raise ValueError("kernels of sparse rows can't be generated")
    return kernel.rows(located_events, pixels, matrix, e0, resolution, support, generate=generate)


def experiment(base: Run, changes: Iterable[dict], one: Callable[[Run], dict]) -> list[dict]:
    """What ``one`` gives for each change of the settings, with the change itself; a run that fails is told and doesn't end the others."""
    out = []
    for c in changes:
        try:
            out.append({**c, **one(replace(base, **c).checked()), "error": None})
        except (ValueError, ArithmeticError) as e:
            out.append({**c, "error": str(e)})
    return out
