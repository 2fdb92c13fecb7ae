"""Analytic responses of detector pairs, the older event kernel, and small tools on matrices and volumes."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import energy, geometry
from . import cells, simulate

# Coefficients of a rational approximation of the error function (error below 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def erf(x: Column) -> Column:
    """The error function to 1.5e-7."""
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def bin_mass(centre: Column, sigma: float, lo: Column, hi: Column) -> Column:
    """Share of a Gaussian in [lo, hi); with sigma 0, whether the centre lies there."""
    if sigma <= 0:
        return ((centre >= lo) & (centre < hi)).cast("double")
    s = sigma * math.sqrt(2)
    return (erf((hi - centre) / s) - erf((lo - centre) / s)) / 2


def older_kernel(e1: Column, e0: float, resolution: float, d01: Column, d12: Column, beta: Column, delta1: float, delta2: float) -> Column:
    """The kernel with second-order errors of the energy and hits blurred by their crystals' angles."""
    rest, ee = e0 - e1, energy.ELECTRON
    cosine = energy.scatter_cosine(e1, e0)
    theta, sine = F.acos(cosine), F.sqrt(1 - cosine * cosine)
    er = e1 * (resolution / energy.FWHM) * F.sqrt(F.lit(e0) / e1)
    first = ee / (sine * rest * rest)
    second = ee / (sine * rest * rest * rest) * (2 - cosine / (sine * sine) * ee / rest)
    side = F.when(beta >= theta, 0.5).otherwise(-0.5)
    se = F.abs(first * er + side * second * er * er)
    p, q = d01 / d12, delta1 / delta2
    sp = F.atan(F.lit(delta1) / d01) * F.sqrt(1 + p * p * (1 + q * q) + 2 * p * cosine)
    s = F.sin(beta)
    return F.exp(-(beta - theta) * (beta - theta) / (2 * (se * se + sp * sp))) * (F.lit(e0) / rest + rest / e0 - s * s)


TINY = 1e-12


def integration_cells(detectors: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """Each crystal (det_id, x, y, z, sx, sy, sz) cut into cells: det_id, cell, centre x, y, z, area of the face, thickness, depth (what of the crystal lies before it, seen from the plane y = 0) and whole, the crystal's thickness."""
    grid = F.sequence(F.lit(0), F.lit(nx * ny * nz - 1))
    at = detectors.withColumn("cell", F.explode(grid))
    ix, iy, iz = F.floor(F.col("cell") / (ny * nz)), F.floor(F.col("cell") / nz) % ny, F.col("cell") % nz
    share = lambda i, n: (i + 0.5) / n - 0.5
    outward = F.when(F.col("y") >= 0, 1.0).otherwise(-1.0)
    return at.select(
        "det_id",
        "cell",
        (F.col("x") + share(ix, nx) * F.col("sx")).alias("x"),
        (F.col("y") + outward * share(iy, ny) * F.col("sy")).alias("y"),
        (F.col("z") + share(iz, nz) * F.col("sz")).alias("z"),
        (F.col("sx") * F.col("sz") / (nx * nz)).alias("area"),
        (F.col("sy") / ny).alias("thickness"),
        (iy * F.col("sy") / ny).alias("depth"),
        F.col("sy").alias("whole"),
    )


def density_norm(e0: float, points: int = 4097) -> float:
    """The Klein-Nishina density over all directions, by trapezoids of the cosine."""
    mu = np.linspace(-1, 1, points)
    k = 1 / (1 + e0 / energy.ELECTRON * (1 - mu))
    f = k * k * (k + 1 / k - (1 - mu * mu))
    return float(2 * math.pi * ((f[1:] + f[:-1]) / 2 * np.diff(mu)).sum())


def response(voxels: DataFrame, first: DataFrame, second: DataFrame, boxes: DataFrame, sections: DataFrame, e0: float, edges: list[float], resolution: float) -> DataFrame:
    """voxel, first, second, e1_bin and w: how likely a photon of a voxel scatters in one crystal, leaves a first deposit of that bin there, and is stopped in another.

    voxels: voxel, x, y, z. first, second: cells of crystals (``integration_cells``);
    either may lie in front, so both orders of hits are made by two calls.
    boxes: all crystals (det_id, x, y, z, sx, sy, sz). sections: energy, total and
    incoherent in 1/cm, a row an energy. resolution: 0 for deposits without blur.
    Ways through other crystals attenuate, of which those inside the first crystal
    after the scatter too. All pairs of cells are wanted, as the tensor is dense:
    what hangs on the cells alone is worked out once for the machine, and voxels
    spread over tasks; cells are summed before the shuffle.
    """
    v = voxels.select("voxel", *[F.col(c).alias(f"s{c}") for c in "xyz"])
    f = first.select(F.col("det_id").alias("first"), F.col("cell").alias("cell1"), *[F.col(c).alias(f"e{c}") for c in "xyz"], *[F.col(c).alias(f"{c}1") for c in ("area", "thickness", "depth")])
    held = {round(r[0], 12): r for r in sections.select("energy", "total", "incoherent").orderBy("energy").collect()}  # a table of a few hundred energies
    total0, part0 = (float(np.interp(e0, list(held), [r[k] for r in held.values()])) for k in (1, 2))
    legs = v.crossJoin(F.broadcast(f))  # voxels times a machine's cells
    legs = legs.join(cells.blocked_length(legs, boxes, ["voxel", "first", "cell1"], ["first"]), ["voxel", "first", "cell1"])
    way = tuple(F.col(f"e{c}") - F.col(f"s{c}") for c in "xyz")
    n1 = geometry.norm(way)
    cos1 = way[1] / n1 * F.when(F.col("ey") >= 0, 1.0).otherwise(-1.0)
    legs = legs.withColumn("n1", n1).withColumn("cos1", F.when(F.col("n1") > TINY, cos1)).filter("cos1 > 0")
    reach = F.col("area1") * F.col("cos1") / (4 * math.pi * F.col("n1") * F.col("n1"))
    inside = F.exp(-total0 * F.col("depth1") / F.col("cos1") / 10) * (1 - F.exp(-total0 * F.col("thickness1") / F.col("cos1") / 10))
    scatter = reach * inside * (part0 / total0) * F.exp(-total0 * F.col("blocked") / 10)
    legs = legs.select("voxel", "first", "cell1", *[(w / F.col("n1")).alias(f"u{c}") for c, w in zip("xyz", way, strict=True)], scatter.alias("scatter"))

    start = f.select("first", "cell1", *[F.col(f"e{c}").alias(f"s{c}") for c in "xyz"])
    end = second.select(F.col("det_id").alias("second"), F.col("cell").alias("cell2"), *[F.col(c).alias(f"e{c}") for c in "xyz"], "area", "thickness", "depth", "whole")
    pairs = start.crossJoin(F.broadcast(end)).filter("first <> second")  # a machine's pairs of cells
    pairs = pairs.join(cells.blocked_length(pairs, boxes, ["first", "cell1", "second", "cell2"], ["first", "second"]), ["first", "cell1", "second", "cell2"])
    own = boxes.select(F.col("det_id").alias("first"), *[F.col(c).alias(f"c{c}") for c in "xyz"], *[(F.col(f"s{c}") / 2).alias(f"h{c}") for c in "xyz"])
    pairs = pairs.join(F.broadcast(own), "first").withColumn("n2", geometry.norm(way)).filter(F.col("n2") > TINY)
    pairs = pairs.select("*", *[(w / F.col("n2")).alias(f"o{c}") for c, w in zip("xyz", way, strict=True)])
    exits = [F.when(F.abs(F.col(f"o{c}")) >= TINY, (F.col(f"c{c}") + F.signum(f"o{c}") * F.col(f"h{c}") - F.col(f"s{c}")) / F.col(f"o{c}")) for c in "xyz"]
    signed = F.col("oy") * F.when(F.col("ey") >= 0, 1.0).otherwise(-1.0)
    cos2 = F.abs(signed)
    before = F.when(signed >= 0, F.col("depth")).otherwise(F.col("whole") - F.col("depth") - F.col("thickness"))
    pairs = pairs.filter(cos2 > 0).select(
        "first",
        "cell1",
        "second",
        *[f"o{c}" for c in "xyz"],
        (F.col("area") * cos2 / (F.col("n2") * F.col("n2"))).alias("seen"),
        ((F.greatest(F.least(*exits), F.lit(0.0)) + F.col("blocked") + before / cos2) / 10).alias("way_cm"),
        (F.col("thickness") / cos2 / 10).alias("stop_cm"),
    )
    met = legs.join(pairs, ["first", "cell1"]).withColumn("cosine", geometry.clamp(sum(F.col(f"u{c}") * F.col(f"o{c}") for c in "xyz"), -1.0, 1.0))
    met = met.withColumn("left", energy.scattered_energy(F.col("cosine"), e0))
    met = simulate.interpolated(met, "left", sections.select(F.col("energy").alias("e"), "total"), "e", ["total"])
    stopped = F.exp(-F.col("total") * F.col("way_cm")) * (1 - F.exp(-F.col("total") * F.col("stop_cm")))
    base = F.col("scatter") * energy.klein_nishina_pdf(F.col("cosine"), e0 / energy.ELECTRON) / density_norm(e0) * F.col("seen") * stopped
    met = met.select("voxel", "first", "second", base.alias("base"), (F.lit(e0) - F.col("left")).alias("deposit"))
    masses = [F.sum(F.col("base") * centre_mass(F.col("deposit"), e0, resolution, float(a), float(b))) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = met.groupBy("voxel", "first", "second").agg(F.array(*masses).alias("w"))
    return out.select("voxel", "first", "second", F.posexplode("w").alias("e1_bin", "w"))


def by_place(sources: DataFrame, place: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``sources`` with what ``work`` makes of their places: it gets each distinct place once and keeps its columns, so what sources share isn't worked out anew for each."""
    made = work(sources.select(*place).distinct())
    made = made.withColumnsRenamed({c: f"__{c}" for c in place})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in place]
    return sources.join(made, same).drop(*[f"__{c}" for c in place])


def centre_mass(deposit: Column, e0: float, resolution: float, lo: float, hi: float) -> Column:
    """Mass of a bin of deposits, by the blurred deposit's density at its middle; without blur, whether the deposit lies in it."""
    middle, width = (lo + hi) / 2, hi - lo
    if resolution <= 0:
        return (F.abs(deposit - middle) <= width / 2).cast("double")
    sigma = F.greatest(deposit * (resolution / energy.FWHM) * F.sqrt(F.lit(e0) / F.greatest(deposit, F.lit(1e-6))), F.lit(1e-6))
    off = (middle - deposit) / sigma
    return F.exp(-0.5 * off * off) * (width / math.sqrt(2 * math.pi)) / sigma


def tensor_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Counts of finite and zero values, and min, max, mean and sum of the finite ones."""
    v = F.col(value)
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return df.groupBy(*keys).agg(F.count(finite).alias("finite"), F.sum((finite == 0).cast("long")).alias("zeros"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"), F.sum(finite).alias("sum"))


def mean_matched(image: DataFrame, truth: DataFrame, keys: list[str], *groups: str) -> DataFrame:
    """Images scaled so that their mean over the truth's positive voxels is the truth's; ``groups`` of the keys tell images apart."""
    both = image.join(truth.withColumnRenamed("v", "__t"), keys)
    w = both.groupBy(*groups).agg(F.avg(F.when(F.col("__t") > 0, F.col("v"))).alias("__a"), F.avg(F.when(F.col("__t") > 0, F.col("__t"))).alias("__b"))
    met = both.join(w, list(groups)) if groups else both.crossJoin(F.broadcast(w))  # one row
    return met.select(*keys, F.when(F.col("__a") != 0, F.col("v") * F.col("__b") / F.col("__a")).otherwise(0.0).alias("v"))


def ratio_map(a: DataFrame, b: DataFrame, key: str, floor: float = 1e-12) -> DataFrame:
    """a over b by key; 0 where b isn't over the floor."""
    return a.join(b.withColumnRenamed("v", "__b"), key).select(key, F.when(F.col("__b") > floor, F.col("v") / F.when(F.col("__b") > floor, F.col("__b"))).otherwise(0.0).alias("v"))


def grouped_back(events: DataFrame, matrix: DataFrame) -> DataFrame:
    """Back-projection of events (bin_id, r) that share their first hit's row: ratios are summed by bin before the matrix is touched."""
    by_bin = events.groupBy("bin_id").agg(F.sum("r").alias("r"))
    return matrix.join(by_bin, "bin_id").groupBy("pixel_id").agg(F.sum(F.col("h") * F.col("r")).alias("w"))


def shown_iterations(most: int, step: int) -> list[int]:
    """Iterations worth showing: parts of the last one, snapped to what was saved."""
    wanted = [most / k for k in (100, 50, 20, 10, 2, 1)]
    return sorted({min(most, max(step, round(x / step) * step)) for x in wanted})


def slices(volume: DataFrame, centre: tuple[int, int, int], *keys: str, flipped: dict[str, int] | None = None) -> DataFrame:
    """The three orthogonal slices through a voxel of each volume: keys, axis, i, j, v. flipped: axes that run the other way, with their numbers of cells."""
    out, at_of = None, lambda c: (F.lit(flipped[c] - 1) - F.col(c)).cast("int") if c in (flipped or {}) else F.col(c)
    for axis, at in zip(("ix", "iy", "iz"), centre, strict=True):
        i, j = [c for c in ("ix", "iy", "iz") if c != axis]
        s = volume.filter(at_of(axis) == at).select(*keys, F.lit(axis).alias("axis"), at_of(i).alias("i"), at_of(j).alias("j"), "v")
        out = s if out is None else out.unionByName(s)
    return out


def smoothed(volume: DataFrame, sigma: float, reach: int, *keys: str) -> DataFrame:
    """Gaussian smoothing along z by a window of rows on each side, its weights renormalised at the ends."""
    w = Window.partitionBy(*keys).orderBy("iz")
    total, weight = F.lit(0.0), F.lit(0.0)
    for k in range(-reach, reach + 1):
        g, other = math.exp(-0.5 * (k / sigma) ** 2), F.lag("v", -k).over(w)
        total, weight = total + g * F.coalesce(other, F.lit(0.0)), weight + F.when(other.isNotNull(), g).otherwise(0.0)
    return volume.select(*keys, "iz", (total / weight).alias("v"))
