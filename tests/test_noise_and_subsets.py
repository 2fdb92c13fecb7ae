"""Poisson numbers, table lookups, weights on a line, and ordered subsets against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import kernel, recon, simulate


def test_poisson_has_its_mean_and_variance(spark):
    means = [0.0, -1.0, 0.3, 4.0, 30.0, 200.0]
    df = spark.range(6000).select("id", F.explode(F.array(*map(F.lit, means))).alias("m"))
    got = df.select("m", simulate.noisy(F.col("m"), F.col("id"), "poisson").alias("n")).groupBy("m").agg(F.avg("n").alias("a"), F.var_pop("n").alias("v"), F.min("n").alias("least")).collect()
    for r in got:
        want = max(r["m"], 0)
        assert r["least"] >= 0 and r["a"] == pytest.approx(want, abs=5 * np.sqrt(want / 6000)) and r["v"] == pytest.approx(want, rel=0.1)


def test_lookup_holds_the_ends_and_nulls(spark):
    t = spark.createDataFrame([(2.0, 20.0), (1.0, 10.0), (4.0, 0.0)], "k double, v double")
    x = spark.createDataFrame([(0.5,), (1.5,), (3.0,), (9.0,), (None,)], "x double")
    got = {r["x"]: r["v"] for r in simulate.interpolated(x, "x", t, "k", ["v"]).collect()}
    assert got == {0.5: 10.0, 1.5: 15.0, 3.0: 10.0, 9.0: 0.0, None: None}


@pytest.mark.parametrize("n, stride", [(12, 4), (6, 3), (5, 1), (4, 4)])
def test_line_weights(spark, n, stride):
    down = kernel.weight_array(kernel.reduce_weights_line(spark, n, stride), n, n // stride)
    up = kernel.weight_array(kernel.expand_weights_line(spark, n, stride), n, n // stride)
    middles = (np.arange(n // stride) + 0.5) * stride - 0.5
    x = np.arange(n) ** 2.0
    assert np.allclose(x @ down, np.interp(middles, np.arange(n), x))
    y = np.arange(n // stride) ** 2.0 + 1
    assert np.allclose(up @ y, np.interp(np.arange(n), middles, y))


@pytest.mark.parametrize("which", ["bins", "events", "both"])
def test_ordered_subsets_equal_plain_loops(spark, which):
    rng = np.random.default_rng(1)
    pixels, views = 6, 3
    turns = np.array([rng.permutation(pixels) for _ in range(views)])
    h, y = rng.random((8, pixels)), rng.integers(0, 9, (8, views)).astype(float)
    t, view = rng.random((10, pixels)), rng.integers(0, views, 10)
    bins = spark.createDataFrame([(i % 2, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(h, y))], "k int, h array<double>, y array<double>")
    events = spark.createDataFrame([(i % 2, a.tolist(), int(v)) for i, (a, v) in enumerate(zip(t, view))], "k int, t array<double>, view int")
    one, two, alpha = which != "events", which != "bins", 0.7
    s = recon.views_sensitivity(turns, bins if one else None, events if two else None, alpha)
    got, saved = recon.ordered(turns, s, 2, recon.by_subset(bins, F.col("k"), "bins") if one else None, recon.by_subset(events, F.col("k"), "events") if two else None, alpha, save_every=1)

    def back(v, w):
        out = np.zeros(pixels)
        for p in range(pixels):
            out[turns[v][p]] += w[p]
        return out

    a, b = (alpha, 2 - alpha) if which == "both" else (1, 1)
    want_s = a * one * sum(back(v, h.sum(axis=0)) for v in range(views)) / views + b * two * sum(back(v, r) for r, v in zip(t, view))
    image = np.ones(pixels)
    for step in range(4):
        w = np.zeros(pixels)
        for v in range(views):
            if one:
                rows = h[step % 2 :: 2]
                w += a * back(v, rows.T @ (y[step % 2 :: 2, v] / (rows @ image[turns[v]])))
        if two:
            for r, v in zip(t[step % 2 :: 2], view[step % 2 :: 2]):
                w += b * back(v, r / (r @ image[turns[v]]))
        image = image * w / want_s
    assert np.allclose(s, want_s) and np.allclose(got, image) and [i for i, _ in saved] == [1, 2]


def test_ordered_subsets_of_no_rows(spark):
    none = spark.createDataFrame([], "k int, h array<double>, y array<double>")
    turns = np.arange(4)[None]
    assert recon.by_subset(none, F.col("k"), "bins") == [] and (recon.ordered(turns, np.ones(4), 1, [])[0] == 1).all()
