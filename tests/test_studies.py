"""Cells of space, triangles, shards, the order network, masks, hooks and run options against plain versions."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.operators import cells, events, image, kernel, metrics, morphology, network, recon, triangles
from lodeframe.plans import event_queries, runs, views
from lodeframe.sources import shards


def box_share(s, e, c, h):
    """Length of a segment in a box, by its slabs."""
    enter, leave = 0.0, 1.0
    for k in range(3):
        d = e[k] - s[k]
        if abs(d) < 1e-12:
            if abs(s[k] - c[k]) > h[k]:
                return 0.0
            continue
        a, b = sorted(((c[k] - h[k] - s[k]) / d, (c[k] + h[k] - s[k]) / d))
        enter, leave = max(enter, a), min(leave, b)
    return max(0.0, leave - enter) * float(np.linalg.norm(np.subtract(e, s)))


@pytest.mark.parametrize("cell", [3.0, 7.0, None])
def test_segments_meet_boxes_by_cells(spark, cell):
    rng = np.random.default_rng(4)
    boxes = [(i, *(rng.integers(-8, 9, 3) * 2.0).tolist(), *rng.choice([2.0, 3.0, 9.0], 3).tolist()) for i in range(60)]
    segments = [(i, *(rng.integers(-20, 21, 6) * 1.0).tolist(), int(rng.integers(60))) for i in range(150)]
    segments += [(150, 1.0, 1, 1, 1, 1, 1, 0), (151, -20.0, 2, 2, 20, 2, 2, 1), (152, 3.0, -20, 6, 3, 20, 6, 2), (153, -0.0, 0, 0, 0, 0, 30, 3)]
    b = spark.createDataFrame(boxes, "det_id int, x double, y double, z double, sx double, sy double, sz double")
    s = spark.createDataFrame([(*x[:1], *map(float, x[1:7]), x[7]) for x in segments], "seg int, sx double, sy double, sz double, ex double, ey double, ez double, own int")
    got = {r["seg"]: r["blocked"] for r in cells.blocked_length(s, b, ["seg"], ["own"], cell).collect()}
    want = {x[0]: sum(box_share(x[1:4], x[4:7], c[1:4], [v / 2 for v in c[4:7]]) for c in boxes if c[0] != x[7]) for x in segments}
    assert got == pytest.approx(want)
    near = cells.blockers(s.select("*", F.col("own").alias("a"), F.lit(-1).alias("b")), b, 4.0).groupBy("seg").count().collect()
    plain = {}
    for x in segments:
        p, w = np.array(x[1:4], float), np.subtract(x[4:7], x[1:4]).astype(float)
        for c in boxes:
            t = w @ (np.array(c[1:4]) - p) / max(w @ w, 1e-12)
            if c[0] != x[7] and 0 < t < 1 and np.linalg.norm(np.array(c[1:4]) - p - t * w) <= 4.0:
                plain[x[0]] = plain.get(x[0], 0) + 1
    assert {r["seg"]: r["count"] for r in near} == plain
    plan = cells.blocked_length(s, b, ["seg"], ["own"], 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_triangles_are_delaunay_and_cover_the_hull():
    rng = np.random.default_rng(9)
    ring = np.array([(r * np.cos(2 * np.pi * t / n), r * np.sin(2 * np.pi * t / n)) for n, r in ((8, 6), (16, 12), (40, 18)) for t in range(n)])
    lattice = np.array(list(itertools.product(range(6), range(5))), float)
    for p, area in ((rng.random((80, 2)), None), (ring, 0.5 * 40 * 18 * 18 * np.sin(2 * np.pi / 40)), (lattice, 20.0)):
        t = triangles.triangulate(p)
        a, b, c = (p[t[:, k]] for k in range(3))
        sizes = ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
        assert (sizes > 0).all() and (area is None or sizes.sum() == pytest.approx(area))
        for corners in t:
            x, y, r2 = triangles._circle(p, *corners)
            assert (((p - [x, y]) ** 2).sum(axis=1) >= r2 * (1 - 1e-4)).all()
    assert len(triangles.triangulate(p[:2])) == 0


def test_interpolation_equals_a_search_of_all_triangles(spark):
    rng = np.random.default_rng(1)
    p = rng.random((30, 2)) * 10
    values = rng.random(30)
    asked = np.concatenate([rng.random((200, 2)) * 14 - 2, p[:5]])
    table = triangles.triangle_table(spark, list(range(100, 130)), p)
    points = spark.createDataFrame([(i, 1, float(x), float(y)) for i, (x, y) in enumerate(asked)], "id int, pic int, x double, y double")
    images = spark.createDataFrame([(1, 100 + i, float(v)) for i, v in enumerate(values)], "pic int, pixel_id int, v double")
    placed = triangles.located(points, table, 1.5, ["id"])
    got = {r["id"]: r["v"] for r in triangles.interpolated(points, placed, images, ["id"], "pic").collect()}
    for i, q in enumerate(asked):
        want = None
        for t in triangles.triangulate(p):
            w = np.linalg.solve(np.vstack([p[t].T, np.ones(3)]), [*q, 1])
            if w.min() >= -1e-9:
                want = float(w @ values[t])
                break
        assert got[i] == (None if want is None else pytest.approx(want))
    weights = triangles.weight_matrix(triangles.located(points, triangles.triangle_table(spark, list(range(30)), p), 1.5, ["id"]), "id", 30, len(asked))
    assert np.allclose(values @ np.nan_to_num(weights), [got[i] or 0 for i in range(len(asked))]) and np.isnan(weights[0]).sum() == sum(v is None for v in got.values())


def test_linear_sampling_by_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.random((5, 6, 7))
    volume = spark.createDataFrame([(1, *map(int, i), float(v[i])) for i in np.ndindex(v.shape)], "vol int, ix int, iy int, iz int, v double")
    places = rng.random((80, 3)) * 9 - 1
    points = spark.createDataFrame([(i, 1, *map(float, q)) for i, q in enumerate(places)] + [(99, 2, 1.0, 1.0, 1.0)], "id int, vol int, a double, b double, c double")
    wide = np.pad(v, 2)
    want = {99: 0.0}
    for i, q in enumerate(places):
        lo = np.floor(q).astype(int)
        want[i] = sum(np.prod([f if d else 1 - f for d, f in zip(o, q - lo, strict=True)]) * (wide[tuple(np.minimum(lo + o + 2, np.array(wide.shape) - 1))]) for o in itertools.product((0, 1), repeat=3))
    for size in (1, 3, 4):
        got = image.linear(points, volume, {"ix": F.col("a"), "iy": F.col("b"), "iz": F.col("c")}, ["id"], "vol", size=size)
        assert {r["id"]: r["v"] for r in got.collect()} == pytest.approx(want)


def test_shards_are_pruned_and_mended_alone(spark, tmp_path):
    rows = spark.range(900).select(F.col("id").alias("event_id"), (F.col("id") % 2).cast("int").alias("energy"), F.when(F.col("id") < 600, 1).otherwise(2).alias("view"), (F.col("id") % 3).cast("int").alias("subset"), F.array(F.col("id") * 0.5).alias("t"))
    path = str(tmp_path / "s")
    told = shards.kept_or_built(spark, path, lambda: rows, chunk_rows=30)
    assert told.agg(F.sum("rows")).first()[0] == 900
    assert told.filter("view = 1").count() > told.filter("view = 2").count()  # a frequent view has more chunks
    assert shards.kept_or_built(spark, path, lambda: pytest.fail("made again")).count() == told.count()
    one = shards.read(spark, path, subset=1, energy=0)
    assert one.count() == 150
    files = one.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("subset=1" in r["f"] and "energy=0" in r["f"] for r in files)
    scan = shards.read(spark, path, subset=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "subset" in scan.split("PartitionFilters")[1]
    steps = spark.createDataFrame([(0, 2, 1), (1, 0, 2)], "step int, subset int, view int")
    plan = shards.read(spark, path, steps.filter("step = 0"))
    assert plan.count() == 200 and plan.columns == shards.read(spark, path).columns
    assert "dynamicpruning" in plan._jdf.queryExecution().executedPlan().toString().lower()
    assert shards.damaged(spark, path).count() == 0
    files = sorted((p for p in (tmp_path / "s" / "rows").rglob("*.parquet")), key=str)
    before = {p: p.stat().st_mtime_ns for p in files}
    os.remove(files[3])  # a lost shard
    files[7].write_bytes(b"junk" * 30)  # a broken one
    for crc in (files[3], files[7]):
        (crc.parent / f".{crc.name}.crc").unlink(missing_ok=True)
    bad = shards.damaged(spark, path, rows)
    assert bad.count() == 2 and bad.agg(F.sum("found")).first()[0] == 0
    assert shards.mend(spark, path, rows) == 2
    assert shards.damaged(spark, path, rows).count() == 0
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "s" / "rows").rglob("*.parquet")}
    assert sum(after.get(p) == t for p, t in before.items()) == len(before) - 2
    assert sorted(r[0] for r in shards.read(spark, path).select("event_id").collect()) == list(range(900))
    with pytest.raises(ValueError):
        shards.damaged(spark, str(tmp_path / "none"))


def test_network_gradients_and_training(spark):
    rng = np.random.default_rng(2)
    sizes = [3, 5, 4, 1]
    flat = rng.normal(size=sum(a * b + b for a, b in zip(sizes[:-1], sizes[1:], strict=True)))
    x, y, ids = rng.normal(size=(20, 3)), (rng.random(20) > 0.5).astype(float), np.arange(20)
    for drop in (0.0, 0.3):
        at = lambda w, drop=drop: network.gradient(x, y, network._shaped(w, sizes), ids, 3, drop)
        _, g = at(flat)
        for k in rng.integers(0, len(flat), 12):
            step = np.zeros_like(flat)
            step[k] = 1e-6
            assert g[k] == pytest.approx((at(flat + step)[0] - at(flat - step)[0]) / 2e-6, rel=1e-4, abs=1e-6)
    assert network._mask(np.arange(20000), 3, 5, 0.1).mean() == pytest.approx(1, abs=0.01)
    rows = [(i, float(a), float(b), 7.0, float((a * b > 0))) for i, (a, b) in enumerate(rng.normal(size=(1200, 2)) * [1, 100])]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double, label double")
    model = network.train(df.filter("event_id < 900"), df.filter("event_id >= 900"), ["a", "b", "c"], hidden=(16, 8), epochs=12, batch=150, rate=0.02, drop=0.05, slices=8)
    best = max(h["accuracy"] for h in model.history)
    assert best > 0.9
    got = network.scored(df.filter("event_id >= 900"), model, ["a", "b", "c"])
    assert got.agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") > 0.5)).cast("int"))).first()[0] == pytest.approx(best)  # the best state is kept


def test_slices_are_read_by_many_tasks(spark, monkeypatch):
    """A slice of a table has several files, as a step reads one slice alone."""
    df = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("label"))
    seen, before = [], network.written

    def written(df, name="table", *parts):
        out = before(df, name, *parts)
        if name == "slices":
            seen.append((len(out.filter("slice = 1").inputFiles()), out.count()))
        return out

    monkeypatch.setattr(network, "written", written)
    network.train(df.filter("event_id < 3000"), df.filter("event_id >= 3000"), ["a"], hidden=(4,), epochs=1, batch=4000, slices=2)
    assert seen[0][0] >= 4 and seen[0][1] == 3000


def plain_parts(on):
    name = {c: c for c in zip(*map(list, np.nonzero(on)), strict=True)}
    changed = True
    while changed:
        changed = False
        for c in name:
            for k in range(3):
                d = tuple(v + (j == k) for j, v in enumerate(c))
                if d in name and name[c] != name[d]:
                    name[c] = name[d] = min(name[c], name[d])
                    changed = True
    return name


def test_masks_equal_plain_loops(spark):
    rng = np.random.default_rng(6)
    shape = (9, 7, 6)
    on = rng.random(shape) < 0.45
    on[2:6, 1:5, 1:5] = True
    on[3:5, 2:4, 2:4] = False  # a hole across blocks
    table = lambda m: spark.createDataFrame([(5, *map(int, c)) for c in zip(*np.nonzero(m), strict=True)], "vol int, ix int, iy int, iz int")
    cells_of = lambda df: {(r["ix"], r["iy"], r["iz"]) for r in df.collect()}
    mask, want = table(on), plain_parts(on)
    groups = {}
    for c, root in want.items():
        groups.setdefault(root, set()).add(tuple(map(int, c)))
    for size in (3, 16):
        parts = morphology.labelled(mask, "vol", size=size)
        got = {}
        for r in parts.collect():
            got.setdefault(tuple(r["part"]), set()).add((r["ix"], r["iy"], r["iz"]))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
        assert len(cells_of(morphology.largest(parts, "vol"))) == max(map(len, groups.values()))
    ball = morphology.ball(2)
    wide = np.zeros(shape, bool)
    for c in np.ndindex(shape):
        wide[c] = any(0 <= c[0] + o[0] < 9 and 0 <= c[1] + o[1] < 7 and 0 <= c[2] + o[2] < 6 and on[c[0] + o[0], c[1] + o[1], c[2] + o[2]] for o in ball)
    assert cells_of(morphology.dilated(mask, shape, ball, "vol", size=4)) == set(map(tuple, np.argwhere(wide).tolist()))
    thin = {tuple(map(int, c)) for c in np.ndindex(shape) if all(not (0 <= c[0] + o[0] < 9 and 0 <= c[1] + o[1] < 7 and 0 <= c[2] + o[2] < 6) or wide[c[0] + o[0], c[1] + o[1], c[2] + o[2]] for o in ball)}
    assert cells_of(morphology.closed(mask, shape, ball, "vol", size=4)) == thin
    off = plain_parts(~on)
    rim = {off[c] for c in off if c[0] in (0, 8) or c[1] in (0, 6) or c[2] in (0, 5)}
    full = {tuple(map(int, c)) for c in np.argwhere(on).tolist()} | {tuple(map(int, c)) for c, root in off.items() if root not in rim}
    assert cells_of(morphology.filled(mask, shape, "vol", size=4)) == full and (3, 2, 2) in full


def test_many_blocks_are_worked_on_at_once(spark, monkeypatch):
    """Blocks of several volumes go together, in any portions, and give what each volume gives by itself."""
    rng = np.random.default_rng(16)
    shape, volumes = (7, 6, 5), [rng.random((7, 6, 5)) < p for p in (0.3, 0.5, 0.6, 1.0)]
    mask = spark.createDataFrame([(f"v{k}", *map(int, c)) for k, on in enumerate(volumes) for c in np.argwhere(on)], "vol string, ix int, iy int, iz int")
    disk = morphology.ball(1, flat=True)
    assert morphology.in_blocks(mask, (1, 1, 0), "vol", size=3).filter("block[2] <> floor(iz / 3)").isEmpty()  # a flat disk has no halo along z
    for cells_at_once in (1, 60, 1 << 20):
        monkeypatch.setattr(morphology, "CELLS", cells_at_once)
        closed = {tuple(r) for r in morphology.closed(mask, shape, disk, "vol", size=3).collect()}
        parts = {}
        for r in morphology.labelled(mask, "vol", size=3).collect():
            parts.setdefault((r["vol"], tuple(r["part"])), set()).add((r["ix"], r["iy"], r["iz"]))
        for k, on in enumerate(volumes):
            within = lambda i, j: 0 <= i < 7 and 0 <= j < 6
            wide = {(i, j, z) for i, j, z in np.ndindex(shape) if any(within(i + a, j + b) and on[i + a, j + b, z] for a, b, _ in disk)}
            want = {(f"v{k}", i, j, z) for i, j, z in np.ndindex(shape) if all(not within(i + a, j + b) or (i + a, j + b, z) in wide for a, b, _ in disk)}
            assert {r for r in closed if r[0] == f"v{k}"} == want
            groups = {}
            for c, root in plain_parts(on).items():
                groups.setdefault(root, set()).add(tuple(map(int, c)))
            assert sorted(sorted(v) for (vol, _), v in parts.items() if vol == f"v{k}") == sorted(map(sorted, groups.values()))


def test_parts_are_not_broadcast(spark, sf_dir):
    """Small files of many rows don't make a join send them to the driver."""
    from lodeframe.plans import catalogue

    assert "Broadcast" not in catalogue.queries()["mask_parts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_long_parts_are_named_in_few_rounds(spark):
    n = 3000
    pairs = spark.range(n).select(((F.col("id") * 7919) % (n + 1)).alias("a"), (((F.col("id") + 1) * 7919) % (n + 1)).alias("b"))
    assert {r["root"] for r in morphology.components(pairs).collect()} == {0}


def test_generated_kernels_change_the_rows(spark, sf_dir):
    located = event_queries.located(spark, sf_dir).limit(40)
    pixels, matrix = views.pixels(spark), views.matrix(spark, sf_dir)
    plain = {r["event_id"]: r["t"] for r in kernel.rows(located, pixels, matrix, views.E0, event_queries.RES, 1.0).collect()}
    seen = {r["event_id"]: r["t"] for r in runs.event_rows(located, pixels, matrix, runs.Run(), views.E0, event_queries.RES, 1.0, generate=lambda k: k[:, ::-1, :]).collect()}
    assert plain and set(plain) == set(seen) and any(not np.allclose(plain[k], seen[k]) for k in plain)
    same = {r["event_id"]: r["t"] for r in kernel.rows(located, pixels, matrix, views.E0, event_queries.RES, 1.0, generate=lambda k: 3 * k).collect()}
    assert all(np.allclose(plain[k], same[k]) for k in plain)
    with pytest.raises(ValueError):
        kernel.rows(located, pixels.filter("pixel_id < 60"), matrix, views.E0, event_queries.RES, 1.0, generate=lambda k: k)


def test_runs_obey_their_options(spark):
    rng = np.random.default_rng(8)
    h, y, t = rng.random((12, 4)), rng.random((12, 2)) * 9, rng.random((10, 4))
    bins = spark.createDataFrame([(i, h[i].tolist(), y[i].tolist()) for i in range(12)], "bin_id long, h array<double>, y array<double>")
    listed = spark.createDataFrame([(i, i % 2, t[i].tolist()) for i in range(10)], "event_id long, view int, t array<double>")
    turns = np.array([[0, 1, 2, 3], [2, 3, 0, 1]])
    run = runs.Run(nx=2, ny=2, iterations=2, saves=1, subsets=3, views=2, alpha=0.7)
    saved = runs.reconstruct(bins, run, events=listed, turns=turns)
    s = recon.views_sensitivity(turns, bins, listed, 0.7)
    subset = {r["bin_id"]: r["k"] for r in bins.select("bin_id", F.pmod(F.xxhash64("bin_id"), F.lit(3)).alias("k")).collect()}
    other = {r["event_id"]: r["k"] for r in listed.select("event_id", F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("k")).collect()}
    image_ = np.ones(4)
    for _ in range(2):
        for k in range(3):
            w = np.zeros(4)
            for i in [i for i in range(12) if subset[i] == k]:
                for v in range(2):
                    seen = image_[turns[v]]
                    w[turns[v]] += 0.7 * h[i] * y[i, v] / (h[i] @ seen)
            for i in [i for i in range(10) if other[i] == k]:
                w[turns[i % 2]] += 1.3 * t[i] / (t[i] @ image_[turns[i % 2]])
            image_ = image_ * w / s
    assert np.allclose(saved[-1][1], image_)
    with pytest.raises(ValueError):
        runs.reconstruct(bins, run, turns=turns[:1])


def test_layers_and_ids_are_checked(spark):
    d = spark.createDataFrame([(1, 5.0), (2, -9.0), (3, 9.0)], "det_id int, y double")
    ok = events.layered(d)
    assert events.checked(ok, spark.createDataFrame([(1, 3)], "cp1 int, cp2 int")) is ok
    for rows, hits, what in (([(1, 5.0), (2, -5.0)], None, "layers"), ([(2, 5.0), (3, 9.0)], None, "ids"), ([(1, 5.0), (1, 9.0)], None, "ids"), ([(1, 5.0), (2, 9.0)], [(1, 7)], "7")):
        bad = events.layered(spark.createDataFrame(rows, "det_id int, y double"))
        with pytest.raises(ValueError, match=what):
            events.checked(bad, hits and spark.createDataFrame(hits, "cp1 int, cp2 int"))


def test_maps_and_sketches(spark):
    e = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b")], "file int, kind string")
    m = events.count_maps(e, "kind", "file")
    assert {r["file"]: r["counts"] for r in m.collect()} == {1: {"a": 2, "none": 1}, 2: {"b": 1}}
    assert events.added_maps(m, "counts").first()["counts"] == {"a": 2, "b": 1, "none": 1}
    two = m.filter("file = 1").select(F.col("counts").alias("x")).crossJoin(m.filter("file = 2").select(F.col("counts").alias("y")))
    assert two.select(events.map_difference("x", "y").alias("d")).first()["d"] == {"a": 2, "none": 1, "b": -1}
    many = spark.range(40000).select((F.col("id") % 9).alias("file"), (F.col("id") % 15000).alias("v"))
    got = metrics.merged_sketches(metrics.sketched(many, ["v"], "file"), ["v"]).first()["v"]
    assert abs(got - 15000) <= 5 * metrics.SKETCH_ERROR * 15000


def test_chunks_are_dealt_to_parts(spark):
    assert shards.dealt([5, 5, 5, 5], 2) == [0, 0, 1, 1]
    assert shards.dealt([90, 1, 1], 3) == [0, 1, 1]
    assert shards.dealt([1, 1, 90, 1], 3) == [0, 0, 0, 0]
    told = spark.createDataFrame([(1, v, 0, c, 10 * (c > 0), 5) for v in (1, 2) for c in range(5)], "energy int, view int, subset int, chunk int, rows int, chunks int")
    plan = shards.packed_plan(told, 2).collect()
    assert sorted((r["view"], r["chunk"], r["part"]) for r in plan) == [(v, c, int(c > 2)) for v in (1, 2) for c in range(1, 5)]


def test_binomial_numbers_follow_their_distribution(spark):
    from lodeframe.operators import sampling

    for n, p in ((0, 0.5), (1, 0.3), (37, 0.3), (37, 0.9), (5000, 0.01), (10**7, 0.4), (12, 0.0), (12, 1.0)):
        k = sampling.binomial(F.lit(n), p, F.col("id"), 3)
        got = spark.range(4000).select(k.alias("k")).agg(F.avg("k").alias("m"), F.var_pop("k").alias("v"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
        spread = n * p * (1 - p)
        assert got["m"] == pytest.approx(n * p, abs=5 * (spread / 4000) ** 0.5 + 1e-9) and got["v"] == pytest.approx(spread, rel=0.2, abs=1e-9)
        assert 0 <= got["lo"] <= got["hi"] <= n


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from lodeframe.streaming import events as stream

    path, folder = str(tmp_path / "in"), str(tmp_path / "state")
    rows = lambda days: spark.range(0, 48 * days).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 30 * id)").alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    rows(10).write.parquet(path)
    first = stream.hourly_counts(spark, path, folder=folder).collect()
    assert len(first) == 240 and {r["n"] for r in first} == {2}
    late = rows(12).filter("ts >= '2024-01-10 12:00'")
    late.write.mode("append").parquet(path)
    again = {r["hour"].day * 24 + r["hour"].hour: r["n"] for r in stream.hourly_counts(spark, path, folder=folder).collect()}
    assert len(again) == 288 and sum(again.values()) == 480 + late.count()  # open windows took the new rows, and no old row counts twice


def test_small_helpers(spark, tmp_path):
    from lodeframe.operators import response
    from lodeframe.sources import readers

    assert response.shown_iterations(1000, 50) == [50, 100, 500, 1000]
    (tmp_path / "a.mhd").write_text("NDims = 3\nElementDataFile = a.raw = b\n\nnothing\n")
    assert {(r["key"], r["value"]) for r in readers.headers(spark, str(tmp_path / "a.mhd")).collect()} == {("NDims", "3"), ("ElementDataFile", "a.raw = b")}
    one = spark.range(1).select(*[kernel.position_variance(F.lit(rear), 1, 0.5, layers).alias(f"v{rear}{layers}") for rear in (False, True) for layers in (3, 4)]).first()
    assert list(one) == pytest.approx([0.25, 9 / 12 + 0.25, 0.25, 36 / 12 + 0.25])


def test_rows_of_other_machines_have_no_crystal_sizes(spark, sf_dir):
    located = event_queries.located(spark, sf_dir).limit(10)
    rows = [kernel.rows(located, views.pixels(spark), views.matrix(spark, sf_dir), views.E0, event_queries.RES, 1.0, layers=n).select("event_id", "t").collect() for n in (3, 4)]
    assert any(a["t"] != b["t"] for a, b in zip(*rows, strict=False))


def test_macros_of_turned_phantoms(spark, tmp_path):
    from lodeframe.sources import macros

    rods = macros.contrast_rods(spark, [37.0, 28.0, 22.0], 240.0, 60.0, 4.0)
    lines = macros.run_text(macros.turned(rods, 6, (1.0, 2.0)), 511, 77, "view")
    one = [r["line"] for r in lines.filter("view = 1").orderBy("line_no").collect()]
    assert one[0] == "/gps/particle gamma" and one[-1] == "/run/beamOn 77" and sum(x.startswith("/gps/source/add") for x in one) == 3
    assert "/gps/pos/radius 120.0000 mm" in one and "/gps/pos/halfz 30.0000 mm" in one and not any("halfx" in x for x in one)
    back = {(r["view"], r["n"]): r for r in macros.parsed(lines, "view").collect()}
    assert len(back) == 24
    for (view, n), r in back.items():
        angle = 2 * np.pi * (n - 2) / 3 - 2 * np.pi * view / 6
        want = (1.0, 2.0) if n == 1 else (60 * np.cos(angle) + 1, 60 * np.sin(angle) + 2)
        assert (r["x"], r["y"]) == pytest.approx(want, abs=1e-4) and r["weight"] == pytest.approx(1.0 if n == 1 else 3 * (37, 28, 22)[n - 2] ** 2 / 240**2, abs=1e-8)
    macros.write(lines, str(tmp_path / "m"), "view")
    assert [x for f in sorted((tmp_path / "m" / "view=1").glob("part-*")) for x in f.read_text().splitlines()] == one
    spheres = macros.parsed(macros.run_text(macros.point_array(spark, (2, 3, 2), (10.0, 4.0, 6.0), 1.5).withColumn("view", F.lit(0)), 140, 5, "view"), "view").collect()
    assert sorted((r["x"], r["y"], r["z"]) for r in spheres) == [(x, y, z) for x in (-5.0, 5.0) for y in (-4.0, 0.0, 4.0) for z in (-3.0, 3.0)] and {r["radius"] for r in spheres} == {1.5}
