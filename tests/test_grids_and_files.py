"""Grids, files, samples, hooks and networks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions import random
from lodeframe.operators import classifier, grids, kernel, metrics, recon, sampling
from lodeframe.plans import event_queries, runs, views
from lodeframe.sources import readers, writers


def test_random_numbers_of_any_id(spark):
    ids = [0, 5, 2**31, 2**31 + 5, 9_000_000_000, 2**62, -7, -(2**62)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id long").select(random.uniform(F.col("id"), 3)).collect()]
    assert all(0 < x < 1 for x in got) and len(set(got)) == len(ids)


def test_sweep_does_not_depend_on_partitions(spark):
    df = spark.range(30_000).select("id", ((F.col("id") * 7919 % 97) / 97.0).alias("confidence"), (F.col("id") % 3 > 0).alias("correct"))
    got = [[tuple(r) for r in metrics.rejection_sweep(df.repartition(n), "id", [0.0, 0.05, 0.5, 0.9], buckets=n).orderBy("reject_count").collect()] for n in (2, 7)]
    rows = sorted((r["confidence"], r["id"], r["correct"]) for r in df.collect())
    assert got[0] == got[1]
    for r, f in zip(got[0], (0.0, 0.05, 0.5, 0.9), strict=True):
        cut = int(f * len(rows))
        assert r[2] == cut and r[3] == len(rows) - cut and r[5] == sum(x[2] for x in rows[cut:])


def test_samples_of_one_large_group(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") < 19_000, 0).otherwise(F.col("id") % 5 + 1).alias("view"))
    got = sampling.first_of_each(df, random.uniform(F.col("id")), "id", F.lit(37), "view")
    number = {r["id"]: r["u"] for r in df.select("id", random.uniform(F.col("id")).alias("u")).collect()}
    for v in range(6):
        own = sorted((number[r["id"]], r["id"]) for r in df.filter(F.col("view") == v).collect())[:37]
        assert sorted(r["id"] for r in got.filter(F.col("view") == v).collect()) == sorted(i for _, i in own)
    assert sampling.subsample_files(df, 1e-9, "id", "view").groupBy("view").count().filter("count = 1").count() == 6


def test_normalised_rows_guard(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0])], "event_id long, t array<double>")
    assert [tuple(r) for r in recon.normalised_rows(df).collect()] == [(1, [0.25, 0.75])]


def test_kernels_equal_column_functions(spark, sf_dir):
    """The batch form against the column functions, on a few events and pixels."""
    from lodeframe.functions import energy, geometry

    rng = np.random.default_rng(2)
    n, e0 = 40, views.E0
    c = {f"{a}{k}": rng.normal(scale=20, size=n) + (100 if k == 2 and a == "y" else 0) for k in (1, 2) for a in "xyz"}
    c |= {"e1": rng.uniform(0.05, 0.3, n), "rear1": rng.integers(0, 2, n).astype(float), "rear2": rng.integers(0, 2, n).astype(float)}
    grid = rng.normal(scale=5, size=(6, 3)) - np.array([0, 60, 0])
    df = spark.createDataFrame([(i, j, *map(float, grid[j]), *[float(c[k][i]) for k in c]) for i in range(n) for j in range(6)], "i int, j int, px double, py double, pz double, " + ", ".join(f"{k} double" for k in c))
    source, hits = tuple(F.col(f"p{a}") for a in "xyz"), [tuple(F.col(f"{a}{k}") for a in "xyz") for k in (1, 2)]
    theta, beta = energy.scatter_angle(F.col("e1"), e0), geometry.angle(geometry.minus(hits[0], source), geometry.minus(hits[1], hits[0]))
    variance = [tuple(kernel.position_variance(F.col(f"rear{k}") > 0, a, 0.5) for a in range(3)) for k in (1, 2)]
    for leg in (False, True):
        se = kernel.energy_sigma(F.col("e1"), e0, 0.13, beta, theta)
        sp = kernel.position_sigma(source, *hits, *variance, source_leg=leg)
        want = df.select("i", "j", kernel.kernel(F.col("e1"), e0, beta, theta, F.sqrt(F.greatest(se * se + sp * sp, F.lit(1e-12)))).alias("k")).orderBy("i", "j").collect()
        got = kernel._kernels(c, grid, e0, 0.13, 0.5, leg)
        assert got.ravel() == pytest.approx([r["k"] for r in want], rel=1e-6, abs=1e-12)


def test_scalars():
    assert grids.spacing_to_cm("mm") == 0.1 and grids.spacing_to_cm("cm") == 1.0
    assert grids.regridded_spacing(5, 2.0, 9) == 1.0 and grids.regridded_spacing(1, 2.0, 9) == 2.0
    for bad in (lambda: grids.spacing_to_cm("m"), lambda: grids.regridded_spacing(0, 1.0, 2), lambda: grids.hemisphere(None, "left")):
        with pytest.raises(ValueError):
            bad()


def test_matrix_slice_and_detectors(spark, tmp_path):
    m = np.arange(6 * 50, dtype="<f4").reshape(6, 50)  # pixels, bins
    m.tofile(tmp_path / "m.bin")
    got = {r["bin_id"]: r["h"] for r in readers.matrix_slice(spark, str(tmp_path / "m.bin"), 6, 50, 7, 21, 2.0, step=4).collect()}
    assert got == {b: (m[:, b] * 2.0).tolist() for b in range(7, 21)}
    d = np.concatenate([[3], np.arange(36)]).astype("<f4")
    d.tofile(tmp_path / "d.bin")
    assert [r["p11"] for r in readers.detector_binary(spark, str(tmp_path / "d.bin"), 3).orderBy("det_id").collect()] == [11.0, 23.0, 35.0]
    with pytest.raises(Exception, match="don't hold 4"):
        readers.detector_binary(spark, str(tmp_path / "d.bin"), 4).collect()


def test_tables_that_are_kept(spark, tmp_path):
    path, built = str(tmp_path / "t"), []
    build = lambda: built.append(1) or spark.range(len(built))
    assert [readers.kept_or_built(spark, path, build, again).count() for again in (False, False, True)] == [1, 1, 2] and len(built) == 2
    spark.createDataFrame([(1, 2.5)], "a int, b double").write.csv(str(tmp_path / "x.csv"))
    assert readers.named_array(spark, [str(tmp_path / "x.parquet"), str(tmp_path / "x.csv")]).first()["_c1"] == 2.5


def read_text(folder):
    return "".join(open(folder / f).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))


def test_writers(spark, tmp_path):
    writers.tensors({"a": spark.createDataFrame([(1, 2, 0.5)], "i0 int, i1 int, v double")}, str(tmp_path / "t"))
    assert tuple(spark.read.parquet(str(tmp_path / "t")).first()) == ([1, 2], 0.5, "a")
    writers.samples_csv(spark.range(3), str(tmp_path / "s"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "s")).count() == 3
    writers.projection_csv(spark.createDataFrame([(2, 1, 5.0), (1, 3, 7.0)], "view int, bin_id int, y double"), str(tmp_path / "p"), 3)
    assert read_text(tmp_path / "p").split() == ["0.0,0.0,7.0", "5.0,0.0,0.0"]
    writers.flat_text(spark.createDataFrame([(1, 0, 2), (0, 1, 1), (0, 0, 0)], "iy int, ix int, v int"), ["iy", "ix"], "v", str(tmp_path / "f"))
    assert read_text(tmp_path / "f").strip() == "0\t1\t2"
    writers.event_rows(spark.createDataFrame([(1, [0.5]), (2, [0.5])], "view int, t array<double>"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).filter("view = 2").count() == 1
    writers.metrics_csv(spark.range(2), str(tmp_path / "m"))
    writers.summary_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 == spark.read.option("header", "true").csv(str(tmp_path / "m")).count()
    assert writers.report(spark.range(2), "t").splitlines()[0] == "t"
    with pytest.raises(ValueError):
        writers.report(spark.range(5), "t", most=4)


def test_meta_volume(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0, 2.0), (0, 1, 2, 3.0)], "ix int, iy int, iz int, v double")
    writers.meta_volume(df, str(tmp_path / "v"), (2, 2, 4), (1.0, 1.0, 2.5))
    got = np.fromfile(tmp_path / "v.raw", "<f4").reshape(4, 2, 2)
    want = np.zeros((4, 2, 2))
    want[0, 0, 1], want[2, 1, 0] = 2, 3
    assert got.tolist() == want.tolist() and "DimSize = 2 2 4" in open(tmp_path / "v.mhd").read()


def test_runs_and_hooks(spark):
    assert runs.parsed(["--iterations", "6", "--saves", "3"]).iterations == 6
    for bad in ({"saves": 3}, {"nx": 0}, {"alpha": 3.0}, {"stride": 2}):
        with pytest.raises(ValueError):
            runs.Run(**bad).checked()
    df = spark.createDataFrame([(b, [0.1 + (b * k) % 3 for k in range(4)], 2.0 + b) for b in range(12)], "bin_id long, h array<double>, y double")
    seen = []
    run = runs.Run(nx=2, ny=2, iterations=4, saves=2)
    saved = runs.reconstruct(df, run, lambda image: seen.append(image.shape) or np.full_like(image, image.mean()))
    assert [k for k, _ in saved] == [2, 4] and seen == [(2, 2)] * 4 and np.ptp(saved[-1][1]) == 0
    with pytest.raises(ValueError):
        runs.event_rows(df, df, df, runs.Run(nx=2, ny=2, sparse=True), 0.5, 0.1, 1.0, generate=lambda k: k)
    with pytest.raises(ValueError):
        runs.reconstruct(None, run)
    told = runs.experiment(run, [{"iterations": 4}, {"iterations": 5}], lambda r: {"n": r.iterations})
    assert told[0]["n"] == 4 and told[1]["error"]


def test_network_is_saved_with_its_scaling(spark, sf_dir, tmp_path):
    data, names = classifier.order_data(event_queries.scored(spark, sf_dir), views.E0)
    model, tried = classifier.train_network(data, names, (8,), (3, 6))
    classifier.save(model, str(tmp_path / "m"))
    again = classifier.load(str(tmp_path / "m"))
    held = data.filter("held")
    right = again.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right == max(a for _, a in tried)


def test_long_rows_travel_as_stretches(spark):
    """Packing puts the pixels of an event in order, wherever its rows lie, and rows beside each other travel as one."""
    from pyspark.sql import functions as F

    from lodeframe.operators import kernel

    long = spark.range(30).select(F.col("id").alias("event_id"), (F.col("id") % 4).cast("int").alias("cp1"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.col("id") * 10.0 + j)).alias("pixel_id", "t"))
    want = {(i, i % 4): [i * 10.0 + j for j in range(8)] for i in range(30)}
    for rows in (long, long.repartition(5), long.orderBy(F.desc("pixel_id"), "event_id")):
        assert {(r["event_id"], r["cp1"]): r["t"] for r in kernel.packed(rows).collect()} == want
    assert long.mapInArrow(kernel._stretches, "event_id long, cp1 int, pixel_id int, t array<double>").count() == 30


def test_dealt_rows_are_made_after_they_travel(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodeframe.sources import shards

    ids = spark.range(500).select(F.col("id").alias("event_id"), (F.col("id") % 2).alias("energy"), F.lit(1).alias("view"), (F.col("id") % 3).alias("subset"))
    seen = []

    def made(placed):
        seen.append(placed.columns)
        return placed.filter("event_id <> 7").withColumn("t", F.array(F.col("event_id") * 0.5))

    path = str(tmp_path / "s")
    told = shards.kept_or_built(spark, path, lambda: ids, chunk_rows=20, made=made)
    assert seen == [[*shards.KEYS, "event_id", "chunk"]] and told.agg(F.sum("rows")).first()[0] == 499
    assert shards.damaged(spark, path).count() == 0
    assert {(r["event_id"], r["t"][0]) for r in shards.read(spark, path).collect()} == {(i, i / 2) for i in range(500) if i != 7}


def test_event_rows_meet_their_matrix_without_a_shuffle(spark, sf_dir):
    """The machine's rows of the matrix go to the events, whatever the tables' sizes, and columns of the events come along."""
    from lodeframe.plans import recon_queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = recon_queries.list_rows(spark, sf_dir, "view", "cp1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plan and plan.count("Join") == 1


def test_sums_of_normalised_rows_take_one_worker(spark):
    from lodeframe.operators import recon

    rows = spark.createDataFrame([(1, [1.0, 3.0]), (2, [0.0, 0.0]), (3, [2.0, float("nan")]), (4, [5.0, 5.0]), (5, [-2.0, 1.0])], "event_id int, t array<double>")
    assert recon.sensitivity(rows, 2, "t", normalised=True).tolist() == [0.75, 1.25] == recon.sensitivity(recon.normalised_rows(rows), 2, "t").tolist()
