"""Invariants of the domain's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.functions import energy, random
from lodeframe.operators import classifier, image, kernel, metrics, recon, response, rotation, sampling, simulate, variance
from lodeframe.plans import event_queries, recon_queries, views
from lodeframe.sources import macros, readers, writers


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    h = rng.uniform(0.1, 1, (30, 6))
    truth = np.array([1, 4, 2, 8, 0.5, 3])
    rows = [(i, h[i].tolist(), float(h[i] @ truth)) for i in range(30)]
    return spark.createDataFrame(rows, "bin_id long, h array<double>, y double"), h, truth


def test_mlem_keeps_mass_and_likelihood_rises(small):
    df, h, truth = small
    y, s = h @ truth, h.sum(axis=0)
    last, saved = recon.mlem(df, 6, 12, "raw", save_every=1)
    assert [i for i, _ in saved] == list(range(1, 13)) and np.array_equal(saved[-1][1], last)
    like = [float((y * np.log(h @ x) - h @ x).sum()) for _, x in saved]
    assert np.all(np.diff(like) >= -1e-9)
    for _, x in saved:
        assert s @ x == pytest.approx(y.sum())


def test_mlem_equals_numpy(small):
    df, h, truth = small
    y, x = h @ truth, np.ones(6)
    for _ in range(5):
        x = x * (h.T @ (y / (h @ x))) / h.sum(axis=0)
    assert recon.mlem(df, 6, 5)[0] == pytest.approx(x, abs=1e-10)


def test_update_variants_differ_where_they_should():
    x, w, s = np.ones(4), np.array([1.0, -1.0, np.nan, 2.0]), np.array([0.0, 1.0, 1.0, 2.0])
    assert recon.update_safe(x, w, s).tolist() == [0, 0, 0, 1]
    assert recon.update_clamped(x, w, s).tolist() == [1e12, 0, 1, 1]
    assert np.isinf(recon.update_raw(x, w, s)[0])


def test_osem_with_turned_views(spark, small):
    df, h, truth = small
    turns = {0: np.arange(6), 1: np.roll(np.arange(6), 2)}
    parts = [df.select("bin_id", "h", F.lit(v).alias("view")).join(spark.createDataFrame([(i, float(h[i] @ truth[t])) for i in range(30)], "bin_id long, y double"), "bin_id") for v, t in turns.items()]
    got = recon.osem(parts[0].unionByName(parts[1]), 6, 60, 1, F.lit(0), turns=turns)
    # The sensitivity is a mean over the views and the weights are their sum, so each update doubles the mass.
    assert got / got.sum() == pytest.approx(truth / truth.sum(), abs=0.05)


def test_joint_is_invariant_to_row_scale(spark, small):
    df, h, _ = small
    t = [(i, (h[i] / h[i].sum()).tolist()) for i in range(10)]
    a = recon.list_back(spark.createDataFrame(t, "event_id int, t array<double>"), np.ones(6))
    b = recon.list_back(spark.createDataFrame([(i, [7 * v for v in r]) for i, r in t], "event_id int, t array<double>"), np.ones(6))
    assert a == pytest.approx(b)


def test_rotations_are_permutations_with_inverses(spark):
    rot = rotation.rotation_map(views.pixels(spark), 8).toPandas()
    for _, g in rot.groupby("view"):
        assert sorted(g["src_pixel_id"]) == list(range(views.PIXELS))
    assert (rot[rot["view"] == 0]["pixel_id"] == rot[rot["view"] == 0]["src_pixel_id"]).all()


def test_expand_rows_sum_to_one_and_adjoint(spark):
    p = views.pixels(spark)
    e = kernel.expand_weights(p, 2).toPandas()
    assert e.groupby("fine")["w"].sum().to_numpy() == pytest.approx(1)
    rng = np.random.default_rng(1)
    c, f = rng.normal(size=32), rng.normal(size=64)
    table = lambda v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "pixel_id int, v double")
    up = kernel.weighted(table(c), kernel.expand_weights(p, 2), "coarse", "fine").toPandas().sort_values("pixel_id")["v"].to_numpy()
    down = kernel.weighted(table(f), kernel.expand_weights(p, 2), "fine", "coarse").toPandas().sort_values("pixel_id")["v"].to_numpy()
    assert up @ f == pytest.approx(c @ down)


def test_ring_stride():
    assert [kernel.ring_stride(40, 8, 4), kernel.ring_stride(40, 8, 5), kernel.ring_stride(16, 8, 2), kernel.ring_stride(7, 5, 3)] == [1, 5, 2, 1]


def test_kernel_rows_are_distributions(spark, sf_dir):
    t = recon_queries.kernel_rows(spark, sf_dir).select(F.aggregate("t", F.lit(0.0), lambda a, x: a + x).alias("s"), F.col("support").alias("n")).toPandas()
    assert len(t) and t["s"].to_numpy() == pytest.approx(1) and t["n"].between(5, 64).all()


def test_thinning_keeps_totals(spark):
    c = spark.createDataFrame([(1, 1, 5), (1, 2, 0), (1, 3, 7), (2, 1, 2)], "view int, bin int, y int")
    kept = sampling.thin_without_replacement(c, "y", F.lit(6), random.uniform(F.col("bin") * 100 + F.col("unit")), "view").toPandas()
    assert (kept["kept"] <= kept["y"]).all() and kept.groupby("view")["kept"].sum().tolist() == [6, 2]
    assert sampling.greedy_groups([3, 3, 5, 1, 9, 1], 6) == [0, 0, 1, 1, 2, 3]


def test_random_numbers_do_not_depend_on_partitions(spark):
    u = lambda n: [r[0] for r in spark.range(0, 1000, 1, n).select(random.uniform(F.col("id"), 2)).collect()]
    assert u(1) == u(7) and 0.45 < np.mean(u(1)) < 0.55
    z = np.array([r[0] for r in spark.range(5000).select(random.normal(F.col("id"))).collect()])
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1


def test_free_paths_near_published_means(spark):
    """Published means for 511 keV: free path 1.8893 cm, scatter angle 69.676 degrees; 20,000 photons here."""
    p = simulate.scattered(spark.range(20_000), 0.511, views.cross_sections(spark)).select(F.avg("path"), F.avg(F.degrees(F.acos("mu")))).first()
    assert p[0] == pytest.approx(1.8893, rel=0.06) and p[1] == pytest.approx(69.676, rel=0.02)


def test_slab_outcomes_near_published_shares(spark):
    """Transmission follows exp(-mu t); published share for 10 mm: 0.72175."""
    mu = 0.08883 * energy.NAI_DENSITY
    n = simulate.slab(spark.range(20_000), 1.0, 0.01595 * energy.NAI_DENSITY, mu - 0.01595 * energy.NAI_DENSITY, 0.56).groupBy("outcome").count().toPandas().set_index("outcome")["count"]
    assert n.sum() == 20_000 and n["transmitted"] / 20_000 == pytest.approx(0.72175, abs=4 * 0.0032)


def test_laplacian_of_a_constant_is_zero(spark, sf_dir):
    v = views.voxels(spark, sf_dir).withColumn("v", F.lit(3.0))
    assert image.laplacian(v, "vol").filter("v <> 0").count() == 0


def test_ssim_of_itself_is_one(spark, sf_dir):
    v = views.voxels(spark, sf_dir)
    assert image.ssim(v, v, 4, 23.0, "vol").agg(F.min("ssim")).first()[0] == pytest.approx(1)


def test_contrast_and_variance_of_all_pixels(spark, monkeypatch):
    rng = np.random.default_rng(5)
    h = rng.random((40, 12)) * (rng.random((40, 12)) < 0.6)
    h[3] = 0
    df = spark.createDataFrame([(r.tolist(),) for r in h], "h array<double>").repartition(3)
    f, r = h.T @ (h / np.maximum(h.sum(axis=1), 1e-12)[:, None]), np.zeros((12, 12))
    for i, j, w in variance.penalty_matrix((3, 2, 2), (1.0, 2.0, 0.5)):
        r[i, j] += w
    x = rng.random((12, 3))
    assert np.allclose(variance.penalty_times(x, (3, 2, 2), (1.0, 2.0, 0.5)), r @ x) and np.allclose(r.sum(axis=0), 0)
    monkeypatch.setattr(variance, "COLUMNS", 7)
    want = {}
    for beta in (0.1, 5.0):
        inverse = np.linalg.inv(f + beta * r)
        want |= {(beta, p): ((inverse @ f)[p, p], (inverse @ f @ inverse)[p, p]) for p in range(12)}
    study = variance.contrast_variance(df, (3, 2, 2), [0.1, 5.0], spacing=(1.0, 2.0, 0.5), tolerance=1e-10).collect()
    assert {(r["beta"], r["pixel_id"]): pytest.approx((r["contrast"], r["variance"]), rel=1e-6) for r in study} == want
    assert len({r["iterations"] for r in study}) > 1  # each column stops by itself
    for held in (variance.HELD, 0):  # sums in tasks, and tiles that meet by their place
        monkeypatch.setattr(variance, "HELD", held)
        got = np.zeros((12, 12))
        for e in variance.entries(variance.fisher_tiles(df, 12, 5), 12, 5).collect():
            got[e["i"], e["j"]] = e["v"]
        assert np.allclose(got, f)
    direct = variance.direct_contrast_variance(df, (3, 2, 2), [0.1], 5, [0, 4, 11, 7, 2, 9, 1], (1.0, 2.0, 0.5)).collect()
    assert {r["pixel_id"]: pytest.approx((r["contrast"], r["variance"]), rel=1e-9) for r in direct} == {p: want[0.1, p] for p in (0, 4, 11, 7, 2, 9, 1)}


def test_cholesky_of_a_table_of_tiles(spark):
    rng = np.random.default_rng(2)
    m = rng.random((11, 11))
    m = m @ m.T + np.eye(11)
    edges = variance._edges(11, 4)
    tiles = spark.createDataFrame([(i, j, m[slice(*edges[i]), slice(*edges[j])].ravel().tolist()) for i in range(3) for j in range(i + 1)], "i int, j int, tile array<double>")
    low = np.zeros((11, 11))
    for t in variance.cholesky(tiles, 11, 4).collect():
        (a, b), (c, d) = edges[t["i"]], edges[t["j"]]
        low[a:b, c:d] = np.array(t["tile"]).reshape(b - a, d - c)
    assert np.allclose(low, np.linalg.cholesky(m))
    assert variance.beta_schedule(-1, 1) == pytest.approx([0.1, 0.2, 0.5, 1, 2, 5])


def test_classifier_beats_chance(spark, sf_dir):
    r = classifier.order_accuracy(event_queries.scored(spark, sf_dir), 0.511).first()
    assert r["n"] == r["tp"] + r["fn"] + r["fp"] + r["tn"] and 0 <= r["brier"] <= 1


def test_list_reader(spark, tmp_path):
    (tmp_path / "1.csv").write_text("3,0.1,9,0.4,77\n4,0.2,8,0.3,77\n")
    (tmp_path / "2.csv").write_text("5,0.25,7,0.26\n")
    (tmp_path / "3.csv").write_text("")
    (tmp_path / "compton_1.csv").write_text("1,1,1,1\n")
    (tmp_path / "note.csv").write_text("1,1,1,1\n")
    got = sorted(map(tuple, readers.list_mode(spark, str(tmp_path)).collect()))
    assert got == [(1, 3, 0.1, 9, 0.4), (1, 4, 0.2, 8, 0.3), (2, 5, 0.25, 7, 0.26)]


def test_matrix_detector_and_table_readers(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)  # bins x pixels
    (tmp_path / "m.f32").write_bytes(m.T.tobytes())
    got = readers.float_matrix(spark, str(tmp_path / "m.f32"), 3).orderBy("bin_id").collect()
    assert [r["h"] for r in got] == m.tolist()
    with pytest.raises(Exception, match="don't hold rows"):
        readers.float_matrix(spark, str(tmp_path / "m.f32"), 5).collect()
    t = readers.float_tensor(spark, str(tmp_path / "m.f32"), (4, 3)).collect()
    assert {(r["i0"], r["i1"]): r["v"] for r in t} == {(i, j): float(m[i, j]) for i in range(4) for j in range(3)}
    (tmp_path / "d.csv").write_text("9,1.0,2.0,3.0\n9,4,5,6\n")
    assert [tuple(r) for r in readers.detectors(spark, str(tmp_path / "d.csv")).collect()] == [(1, 1.0, 2.0, 3.0), (2, 4.0, 5.0, 6.0)]
    (tmp_path / "xs.txt").write_text("energy a b c\n\n0.01 1 2 3\n 0.02\t4 5 6 \nend\n")
    assert [tuple(r)[1:] for r in readers.cross_sections(spark, str(tmp_path / "xs.txt")).collect()] == [(0.01, 1.0, 2.0, 3.0), (0.02, 4.0, 5.0, 6.0)]
    (tmp_path / "s.json").write_text('{"sigma": {"mean": 2.5, "zero": 0}}')
    assert readers.json_value(spark, str(tmp_path / "s.json"), "sigma", "mean") == 2.5
    with pytest.raises(ValueError):
        readers.json_value(spark, str(tmp_path / "s.json"), "sigma", "zero")
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "s.json")]).endswith("s.json")
    (tmp_path / "c.csv").write_text("1,2\n3,4\n5,6\n")
    assert readers.counts_csv(spark, str(tmp_path / "c.csv")).agg(F.sum("y"), F.max("view"), F.max("bin_id")).first()[:] == (21.0, 3, 2)


def test_names_and_writers(spark, tmp_path):
    name = writers.output_name("SC", 5000, 100, 20, 511, 2.5e8)
    assert writers.scientific(1e9) == "1e9" and "2.5e8" in name
    assert tuple(spark.range(1).select(*readers.name_tokens(F.lit(name))).first()) == (5000, 100, 20, 511)
    writers.image_stack(spark, str(tmp_path / "img"), "SC", [(1, np.ones(3)), (2, np.zeros(3))])
    assert spark.read.parquet(str(tmp_path / "img")).filter("iter = 1").agg(F.sum("v")).first()[0] == 3
    files = spark.createDataFrame([("10.csv",), ("2.csv",), ("b.csv",), ("a.csv",)], "name string")
    assert [r["name"] for r in readers.file_order(files).orderBy("place").collect()] == ["2.csv", "10.csv", "a.csv", "b.csv"]


def test_macros_without_sources(spark):
    lines = spark.createDataFrame([("a.mac", 1, "/run/beamOn 5"), ("a.mac", 2, "/gps/particle gamma")], "file string, line_no int, line string")
    assert macros.parse(lines).count() == 0


def test_exact_percentiles(spark, monkeypatch):
    """Ranges about approximate percentiles give numpy's numbers, with ties, a hot key, a null key, nulls and an empty table."""
    monkeypatch.setattr(metrics, "FEW", 50)
    monkeypatch.setattr(metrics, "NEAR", 0.01)
    id = F.col("id")
    rows = spark.range(9000).select(F.when(id % 7 > 0, "hot").when(id % 14 == 0, "few").alias("k"), F.when(id % 11 > 0, F.floor(id * id % 1013 / 3).cast("double")).alias("v"))
    rows = rows.filter("k <> 'few' OR k IS NULL OR v < 9").unionByName(spark.sql("SELECT 'none' AS k, CAST(NULL AS DOUBLE) AS v"))
    got = {r["k"]: r for r in metrics.summary(rows, F.col("v"), "k").collect()}
    frame = rows.toPandas()
    for k, r in got.items():
        v = frame[frame.k.isna() if k is None else frame.k == k].v.dropna().to_numpy()
        assert r["n"] == len(v)
        if k == "none":
            assert r["median"] is None and r["mean"] is None
            continue
        assert [r["p05"], r["median"], r["p95"]] == pytest.approx(np.quantile(v, [0.05, 0.5, 0.95]))
        assert (r["min"], r["max"]) == (v.min(), v.max())
    assert set(got) == {"hot", "few", None, "none"}
    assert metrics.summary(rows.filter("false"), F.col("v"), "k").count() == 0
    whole = metrics.summary(rows, F.col("v")).first()
    assert whole["median"] == pytest.approx(np.median(frame.v.dropna()))


def test_response_of_cells(spark):
    """A crystal's cells share its face and thickness, and one voxel's response to one pair of crystals on a line is the product of its parts."""
    crystal = spark.createDataFrame([(1, 0.0, 100.0, 0.0, 4.0, 6.0, 4.0), (2, 0.0, 200.0, 0.0, 4.0, 8.0, 4.0)], "det_id int, x double, y double, z double, sx double, sy double, sz double")
    cells = response.integration_cells(crystal, 2, 3, 2).groupBy("det_id").agg(F.sum("area").alias("area"), F.max("depth").alias("depth"), F.min("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("det_id").collect()
    assert [(r["area"], r["depth"], r["n"]) for r in cells] == [(48.0, 4.0, 12), (48.0, pytest.approx(16 / 3), 12)] and cells[0]["y"] == pytest.approx(98.0)
    table = spark.createDataFrame([(0.1, 2.0, 1.0), (0.511, 1.0, 0.5)], "energy double, total double, incoherent double")
    voxel = spark.createDataFrame([(7, 0.0, 0.0, 0.0)], "voxel int, x double, y double, z double")
    one, two = (response.integration_cells(crystal.filter(f"det_id = {i}"), 1, 1, 1) for i in (1, 2))
    got = response.response(voxel, one, two, crystal, table, 0.511, [-0.1, 0.1, 0.2], 0.0).orderBy("e1_bin").collect()
    first = 16 / (4 * np.pi * 100**2) * (1 - np.exp(-0.6)) * 0.5
    second = 2.0 / response.density_norm(0.511) * 16 / 100**2 * np.exp(-0.3) * (1 - np.exp(-0.8))  # straight on: no deposit, half of the first crystal on the way
    assert [r["w"] for r in got] == [pytest.approx(first * second), 0.0]


def test_places_are_worked_on_once(spark):
    """What hangs on a place alone is made once for it, and comes to all sources there, those without a place too."""
    sources = spark.createDataFrame([(i, None if i % 5 == 4 else float(i % 5), 0.5 * (i % 2)) for i in range(40)], "id int, x double, y double")
    seen = []

    def work(places):
        seen.append(places.count())
        return places.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("w", F.coalesce("x", F.lit(-1.0)) * 10 + F.col("y") + F.col("k"))

    got = response.by_place(sources, ["x", "y"], work)
    assert seen == [10] and got.columns == ["id", "x", "y", "k", "w"]
    want = {(i, k, (-1.0 if i % 5 == 4 else i % 5) * 10 + 0.5 * (i % 2) + k) for i in range(40) for k in (1, 2)}
    assert got.count() == 80 and {(r["id"], r["k"], r["w"]) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["top_k_response", "response_tensor"])
def test_responses_are_made_by_place(name, spark, sf_dir, tmp_path):
    """Sources at one place have the same response, and no more places are made than there are."""
    from lodeframe.plans import catalogue

    twice = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey < 3")
    period = 9 * 7 * 11
    twice.unionByName(twice.withColumn("s_suppkey", F.col("s_suppkey") + period)).write.parquet(f"{tmp_path}/supplier.parquet")
    out = catalogue.queries()[name](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    key = "source" if name == "top_k_response" else "voxel"
    assert f"Aggregate [{'px' if key == 'source' else 'x'}#" in plan  # distinct places
    first, again = (sorted(tuple(v for c, v in r.asDict().items() if c != key) for r in out.filter(c).collect()) for c in (f"{key} < {period}", f"{key} >= {period}"))
    assert first and first == again


def test_nearest_needs_no_shuffle(spark):
    rng = np.random.default_rng(8)
    places = [(i, float(a)) for i, a in enumerate(rng.integers(-5, 6, 60))] + [(99, None)]
    entries = [(i, "a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.integers(-6, 7, 20))] + [(50, "c", 0.0)]
    p = spark.createDataFrame(places, "id int, px double")
    d = spark.createDataFrame(entries, "det int, kind string, x double")
    got = rotation.nearest(p, d, lambda e: F.abs(e["x"] - F.col("px")), 2, "det", "kind")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    found = {(r["id"], r["kind"], r["place"]): (r["d2"], r["det"]) for r in got.collect()}
    want = {}
    for i, x in places:
        for kind in "abc":
            best = sorted((0 if x is None else abs(v - x), det) for det, k, v in entries if k == kind)[:2]
            want |= {(i, kind, n + 1): (None if x is None else b[0], b[1]) for n, b in enumerate(best)}
    assert found == want
