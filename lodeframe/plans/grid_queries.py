"""Queries on grids, groups of slices, curves and files, and on energies and packed rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import random
from ..operators import events as ev
from ..operators import grids, kernel, recon, rotation, sampling, simulate
from ..operators import triangles as tri
from . import views
from .catalogue import query
from .recon_queries import _LIST, list_events, list_rows, raw_rows

P = views.PIXELS


def r6(c):
    return F.round(c, 6)


@query("SELECT pixel_id, x, y, z, n, round(total, 6) AS total FROM (SELECT i::INTEGER AS pixel_id, (i % 20 - 9.5e0) * 3.0e0 AS x, (i // 20 - 7.5e0) * 3.0e0 AS y, 12.0e0 AS z FROM range(320) t(i)) JOIN (SELECT (event_id * 7 % 320)::INTEGER AS pixel_id, count(*)::BIGINT AS n, sum(value) AS total FROM events GROUP BY 1) USING (pixel_id)")
def plane_grid(spark, sf_dir):
    """Events on the pixels of a plane."""
    e = views.read(spark, sf_dir, "events").groupBy((F.col("event_id") * 7 % 320).cast("int").alias("pixel_id")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))
    return grids.plane(spark, 20, 16, 3.0, 3.0, 12.0).join(e, "pixel_id")


@query("SELECT side, view, count(*)::BIGINT AS n FROM (SELECT view, unnest(CASE WHEN round(y, 9) > 0 THEN ['front', 'all'] WHEN round(y, 9) < 0 THEN ['rear', 'all'] ELSE ['all'] END) AS side FROM v_event JOIN v_pix ON pixel_id = cp1 - 1) GROUP BY ALL")
def hemispheres(spark, sf_dir):
    """Events by the side that their first pixel lies on."""
    p = views.pixels(spark).select((F.col("pixel_id") + 1).alias("cp1"), F.round("y", 9).alias("y"))
    e = views.events(spark, sf_dir).join(F.broadcast(p), "cp1")
    parts = [grids.hemisphere(e, s).select(F.lit(s).alias("side"), "view") for s in ("front", "rear", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("side", "view").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey - 150.0e0 AS place, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 9) AS value FROM orders")
def line_profile(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("double").alias("place"), F.col("o_totalprice").alias("value"))
    return grids.normalised_profile(o, "place", ["value"], 150.0).withColumn("value", F.round("value", 9))


@query("SELECT view, min(cp1) AS first, max(cp1) AS last FROM (SELECT view, cp1, cp1 - row_number() OVER (PARTITION BY view ORDER BY cp1) AS run FROM (SELECT DISTINCT view, cp1 FROM v_event WHERE cp1 % 7 <> 3)) GROUP BY view, run")
def contiguous_groups(spark, sf_dir):
    return grids.contiguous(views.events(spark, sf_dir).filter("cp1 % 7 <> 3"), "cp1", "view")


_SLICES = "SELECT vec_id % 53 AS iz, vec_id AS ix, CASE WHEN vec_id % 53 % 6 IN (1, 4) OR vec_id % 53 BETWEEN 20 AND 29 THEN 0 ELSE label + 1 END AS v FROM embeddings"


@query(f"""SELECT g::INTEGER AS slice_group, coalesce(max(iz) FILTER (pos = 5), max(iz) FILTER (place = (n + 1) // 2)) AS iz FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY iz) AS place, count(*) OVER (PARTITION BY g) AS n
    FROM (SELECT DISTINCT iz, iz // 8 + 1 AS g, iz % 8 + 1 AS pos FROM ({_SLICES}) WHERE v > 0) WHERE g <= 53 // 8 AND pos NOT IN (3, 8)) GROUP BY g""")
def group_slices(spark, sf_dir):
    """Each row of ``embeddings`` is a cell of one of 53 slices, some of them empty."""
    i = F.col("vec_id") % 53
    v = views.read(spark, sf_dir, "embeddings").select(i.alias("iz"), F.when((i % 6).isin(1, 4) | i.between(20, 29), 0).otherwise(F.col("label") + 1).alias("v"))
    return grids.group_slices(v, 8, 53, (3, 8), 5)


_POINTS = """pts AS (SELECT least(greatest(round_even((i % 9 - 4.0e0) * 7.3e0 / 10 + 3.5e0, 0), 0), 7)::BIGINT + 8 * least(greatest(round_even((i // 9 % 9 - 4.0e0) * 7.3e0 / 10 + 3.5e0, 0), 0), 7)::BIGINT
    + 64 * least(greatest(round_even((i // 81 - 1.0e0) * 7.3e0 / 12 + 3.5e0, 0), 0), 7)::BIGINT AS index FROM range(243) t(i)), wts AS (SELECT index, count(*) / 243.0e0 AS weight FROM pts GROUP BY index)"""


def weights(spark):
    return grids.sample_weights(spark, (8, 8, 8), (10.0, 10.0, 12.0), (9, 9, 3), 7.3)


def indexed(spark, sf_dir):
    return views.voxels(spark, sf_dir).select("vol", (F.col("ix") + 8 * F.col("iy") + 64 * F.col("iz")).cast("long").alias("index"), "v")


@query(f"WITH {_POINTS} SELECT vol, index, round(weight, 9) AS weight, v FROM v_vox JOIN wts ON index = ix + 8 * iy + 64 * iz")
def sample_point_weights(spark, sf_dir):
    """The sampled voxels of every volume."""
    return indexed(spark, sf_dir).join(F.broadcast(weights(spark)), "index").select("vol", "index", F.round("weight", 9).alias("weight"), "v")


@query(f"WITH {_POINTS} SELECT vol, round(sum(v * weight), 6) AS mean FROM v_vox JOIN wts ON index = ix + 8 * iy + 64 * iz GROUP BY vol")
def weighted_sample_mean(spark, sf_dir):
    return grids.weighted_mean(indexed(spark, sf_dir), weights(spark), "index", "v", "vol").select("vol", r6("mean").alias("mean"))


@query("SELECT vol, ix, iy, iz, round(share, 9) AS share FROM (SELECT *, v / sum(v) OVER (PARTITION BY vol) AS share, row_number() OVER (PARTITION BY vol ORDER BY v DESC, ix, iy, iz) AS place FROM v_vox WHERE v > 1.5e0) WHERE place <= 5")
def heaviest_voxels(spark, sf_dir):
    """The five voxels of the largest share of every volume (a top-k report)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("vol").orderBy(F.desc("v"), "ix", "iy", "iz"))
    some = grids.active(views.voxels(spark, sf_dir), 1.5, "vol").withColumn("place", place).filter("place <= 5")
    return some.select("vol", "ix", "iy", "iz", F.round("share", 9).alias("share"))


@query("SELECT vol, (v % 3)::INTEGER AS kind, count(*)::BIGINT AS n FROM v_vox GROUP BY ALL")
def crystal_counts(spark, sf_dir):
    """How many voxels of every volume are of each kind."""
    return views.voxels(spark, sf_dir).groupBy("vol", (F.col("v") % 3).cast("int").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_CURVE = "curve AS (SELECT p_type AS rod, p_size AS iteration, avg(p_retailprice) AS mean, coalesce(stddev_pop(p_retailprice), 0) AS deviation FROM part GROUP BY 1, 2)"


def curves(spark, sf_dir):
    p = views.read(spark, sf_dir, "part")
    return p.groupBy(F.col("p_type").alias("rod"), F.col("p_size").alias("iteration")).agg(F.avg("p_retailprice").alias("mean"), F.coalesce(F.stddev_pop("p_retailprice"), F.lit(0.0)).alias("deviation"))


@query(f"""WITH {_CURVE}, seg AS (SELECT rod, iteration AS lo, lead(iteration) OVER w AS hi, mean, deviation, lead(mean) OVER w AS mean2, lead(deviation) OVER w AS deviation2 FROM curve WINDOW w AS (PARTITION BY rod ORDER BY iteration)),
    marks AS (SELECT i * 5 - 0.3e0 AS iteration FROM range(1, 11) t(i))
    SELECT rod, iteration, round(mean + (iteration - lo) / (hi - lo) * (mean2 - mean), 6) AS mean, round(deviation + (iteration - lo) / (hi - lo) * (deviation2 - deviation), 6) AS deviation
    FROM (SELECT DISTINCT rod FROM curve), marks LEFT JOIN seg USING (rod) WHERE lo <= iteration AND iteration < hi""".replace("FROM (SELECT DISTINCT rod FROM curve), marks LEFT JOIN seg USING (rod) WHERE", "FROM seg, marks WHERE"))
def shifted_markers(spark, sf_dir):
    """Mean and deviation of each rod's curve at shifted iterations."""
    at = spark.range(1, 11).select((F.col("id") * 5 - 0.3).alias("iteration"))
    out = grids.curve_at(curves(spark, sf_dir).withColumn("iteration", F.col("iteration").cast("double")), at, "iteration", ["mean", "deviation"], "rod").dropna()
    return out.select("rod", "iteration", r6("mean").alias("mean"), r6("deviation").alias("deviation"))


@query(f"WITH {_CURVE} SELECT rod, iteration, round(mean, 2) AS mean FROM (SELECT rod, iteration, round(mean, 2) AS mean, row_number() OVER (PARTITION BY rod ORDER BY round(mean, 2) DESC, iteration) AS place FROM curve) WHERE place = 1")
def best_iteration(spark, sf_dir):
    return grids.best(curves(spark, sf_dir).select("rod", "iteration", F.round("mean", 2).alias("mean")), "mean", "iteration", "rod")


@query("SELECT view, n, (sum(n) OVER (ORDER BY view) - n)::BIGINT AS begin_at FROM (SELECT view, count(*)::BIGINT AS n FROM v_event WHERE e1 > 0.1e0 GROUP BY view)")
def file_slices(spark, sf_dir):
    """Where each file's events begin among all that pass."""
    return sampling.offsets(views.events(spark, sf_dir).filter(F.col("e1") > 0.1), "view").withColumnRenamed("before", "begin_at")


@query(f"SELECT view, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM (SELECT *, count(*) OVER (PARTITION BY view) AS total, row_number() OVER (PARTITION BY view ORDER BY {random.sql_uniform('event_id', 3)}, event_id) AS place FROM v_event) WHERE place <= greatest(1, round(total * 0.37e0)) GROUP BY view")
def file_subsample(spark, sf_dir):
    out = sampling.subsample_files(views.events(spark, sf_dir), 0.37, "event_id", "view", salt=3)
    return out.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT bin_id, y * 0.5e0 AS y FROM v_cnt")
def half_counts(spark, sf_dir):
    return views.counts(spark, sf_dir).select("bin_id", sampling.halved(F.col("y")).alias("y"))


@query(f"WITH {_LIST} SELECT pixel_id, round(sum(s), 5) AS s FROM (SELECT pixel_id, sum(h) AS s FROM v_sysmat GROUP BY pixel_id UNION ALL SELECT pixel_id, sum(t) AS s FROM tl GROUP BY pixel_id) GROUP BY pixel_id")
def energy_union_sensitivity(spark, sf_dir):
    """Sensitivities of several energies' matrices and lists, summed."""
    m = views.matrix(spark, sf_dir)
    parts = [recon.image_table(m, recon.sensitivity(m.filter(F.col("bin_id") % 3 == k), P)) for k in range(3)]
    parts.append(recon.image_table(m, recon.sensitivity(raw_rows(spark, sf_dir, list_events(spark, sf_dir)), P, "t", normalised=True)))
    return recon.summed(parts).select("pixel_id", F.round("v", 5).alias("s"))


@query("SELECT energy, count(*)::BIGINT AS bins, round(sum(y * h), 4) AS yh FROM (SELECT bin_id, bin_id % 3 AS energy, y FROM v_cnt) JOIN (SELECT bin_id, sum(h) AS h FROM v_sysmat GROUP BY bin_id) USING (bin_id) GROUP BY energy")
def energy_zip(spark, sf_dir):
    """Counts and matrices of several energies met by energy and bin."""
    of = lambda df: df.withColumn("energy", F.col("bin_id") % 3)
    met = of(views.counts(spark, sf_dir)).join(of(views.matrix(spark, sf_dir)), ["energy", "bin_id"])
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    return met.groupBy("energy").agg(F.count(F.lit(1)).alias("bins"), F.round(F.sum(F.col("y") * total), 4).alias("yh"))


@query(f"""WITH {_LIST}, s AS (SELECT (view - 1) % 8 AS view, pixel_id, sum(t) AS t FROM tl JOIN v_event USING (event_id) GROUP BY 1, 2)
    SELECT src AS pixel_id, round(greatest(sum(t), 1e-12), 6) AS s FROM (SELECT view, pixel_id AS src, (base + (view * n // 8 + theta_id) % n)::INTEGER AS pixel_id FROM v_pix, range(8) t(view)) JOIN s USING (view, pixel_id) GROUP BY src""".replace("SELECT view, pixel_id AS src, (base + (view * n // 8 + theta_id) % n)::INTEGER AS pixel_id", "SELECT view, (base + (view * n // 8 + theta_id) % n)::INTEGER AS src, pixel_id"))
def list_sensitivity_by_view(spark, sf_dir):
    """Sums of event rows by view, each turned back, added up and kept over 0."""
    turns = np.zeros((views.VIEWS, P), int)
    for r in rotation.rotation_map(views.pixels(spark), views.VIEWS).collect():  # a machine's views times pixels
        turns[r["view"], r["pixel_id"]] = r["src_pixel_id"]
    rows = list_rows(spark, sf_dir, "view").withColumn("view", (F.col("view") - 1) % views.VIEWS)
    s = recon.views_sensitivity(turns, events=rows)
    return recon.image_table(rows, np.maximum(s, recon.FLOOR)).select("pixel_id", r6("v").alias("s"))


def _triangles() -> list[tuple]:
    """The triangles of the polar grid, for SQL: their making is tested by itself."""
    place = [(6.0 * (r + 1) * math.cos(2 * math.pi * t / n), 6.0 * (r + 1) * math.sin(2 * math.pi * t / n)) for r, n in enumerate(views.RINGS) for t in range(n)]
    return [(t, *c, *[v for k in c for v in place[k]]) for t, c in enumerate(tri.triangulate(np.array(place)).tolist())]


_TRI = "tri(t, p0, p1, p2, x0, y0, x1, y1, x2, y2) AS (VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in _triangles()) + ")"
_WHOLE = "((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0))"
_ONE, _TWO = f"(((x - x0) * (y2 - y0) - (y - y0) * (x2 - x0)) / {_WHOLE})", f"(((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / {_WHOLE})"
_WITHIN = f"least(1 - {_ONE} - {_TWO}, {_ONE}, {_TWO}) >= -1e-9"
_LOCATE = f"""{_TRI}, p AS (SELECT i AS point, i % 15 AS ix, i // 15 AS iy, (i % 15 - 7) * 3.0e0 + 0.01e0 AS x, (i // 15 - 7) * 3.0e0 + 0.02e0 AS y FROM range(225) t(i)),
    hit AS (SELECT point, min_by([1 - {_ONE} - {_TWO}, {_ONE}, {_TWO}], t) AS w, min_by([p0, p1, p2], t) AS c FROM p, tri WHERE {_WITHIN} GROUP BY point), w AS (SELECT point, unnest(c)::INTEGER AS pixel_id, unnest(w) AS w FROM hit)"""


def polar_triangles(spark):
    p = views.pixels(spark).select("pixel_id", "x", "y").orderBy("pixel_id").toPandas()  # a machine's pixels
    return tri.triangle_table(spark, p["pixel_id"].tolist(), p[["x", "y"]].to_numpy())


def grid_weights(spark) -> np.ndarray:
    i = F.col("id")
    points = spark.range(225).select(i.cast("int").alias("point"), ((i % 15 - 7) * 3.0 + 0.01).alias("x"), ((F.floor(i / 15) - 7) * 3.0 + 0.02).alias("y"))
    return tri.weight_matrix(tri.located(points, polar_triangles(spark), 6.0, ["point"]), "point", P, 225)


@query(f"WITH {_LOCATE}, s AS (SELECT vec_id, point, sum(w * v) AS v FROM w JOIN v_img USING (pixel_id) GROUP BY ALL) SELECT vec_id, ix::INTEGER AS ix, iy::INTEGER AS iy, round(v, 6) AS v FROM (SELECT vec_id FROM embeddings) CROSS JOIN p LEFT JOIN s USING (vec_id, point)")
def polar_image_on_grid(spark, sf_dir):
    """Every polar image on a display grid: a product of arrays with the triangles' shares, null outside the hull."""
    e = views.read(spark, sf_dir, "embeddings")
    value = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 10000) % 101 + 1).cast("double"))
    out = recon.through(e.select(F.col("vec_id").alias("bin_id"), value.alias("h")), grid_weights(spark)).select(F.col("bin_id").alias("vec_id"), F.posexplode("h").alias("point", "v"))
    return out.select("vec_id", (F.col("point") % 15).alias("ix"), F.floor(F.col("point") / 15).cast("int").alias("iy"), F.when(~F.isnan("v"), r6("v")).alias("v"))


@query(f"WITH {_LOCATE} SELECT bin_id, count(DISTINCT point)::BIGINT AS points, round(sum(w * h), 5) AS total FROM w JOIN v_sysmat USING (pixel_id) GROUP BY bin_id")
def polar_matrix_on_grid(spark, sf_dir):
    """The system matrix on the display grid, as arrays."""
    out = recon.through(views.matrix(spark, sf_dir), grid_weights(spark))
    held = F.filter("h", lambda x: ~F.isnan(x))
    return out.select("bin_id", F.size(held).cast("long").alias("points"), F.round(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


_SPREAD = f"""{_TRI}, e AS (SELECT event_id, event_id % (SELECT count(*) FROM embeddings) AS vec_id, value % 41 - 20.03e0 AS x, value * 3 % 37 - 18.02e0 AS y FROM events),
    hit AS (SELECT event_id, vec_id, min_by([1 - {_ONE} - {_TWO}, {_ONE}, {_TWO}], t) AS w, min_by([p0, p1, p2], t) AS c FROM e, tri WHERE {_WITHIN} GROUP BY ALL), w AS (SELECT event_id, vec_id, unnest(c)::INTEGER AS pixel_id, unnest(w) AS w FROM hit)"""


@query(f"WITH {_SPREAD}, s AS (SELECT event_id, sum(w * v) AS v FROM w JOIN v_img USING (vec_id, pixel_id) GROUP BY event_id) SELECT event_id, round(v, 6) AS v FROM e LEFT JOIN s USING (event_id)")
def scattered_interpolation(spark, sf_dir):
    """Each event's place in an image of its own, which is known at scattered points: triangles are found by cells, values by pixel; null outside the hull."""
    n = views.read(spark, sf_dir, "embeddings").count()
    e = views.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % n).alias("vec_id"), (F.col("value") % 41 - 20.03).alias("x"), (F.col("value") * 3 % 37 - 18.02).alias("y"))
    placed = tri.located(e, polar_triangles(spark), 6.0, ["event_id"])
    return tri.interpolated(e, placed, views.images(spark, sf_dir), ["event_id"], "vec_id").select("event_id", r6("v").alias("v"))


@query(f"SELECT view, count(*)::BIGINT AS n, round(avg(e2 / greatest(e1 + e2, 1e-15)), 6) AS second_weight, round(avg(-ln({random.sql_uniform('event_id', 2)}) / 0.34e0 * (e2 / greatest(e1 + e2, 1e-15))), 6) AS path FROM v_event GROUP BY view")
def energy_weighted_paths(spark, sf_dir):
    """Free paths weighted by the share of the energy that the second deposit has; an event a photon."""
    path = -F.log(random.uniform(F.col("event_id"), 2)) / 0.34
    out = simulate.energy_weighted(views.events(spark, sf_dir).withColumn("path", path), F.col("e1"), F.col("e2"), ["path"])
    return out.groupBy("view").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("second_weight")).alias("second_weight"), r6(F.avg("weighted_path")).alias("path"))


@query("""SELECT energy, system, count(*)::BIGINT AS n FROM (SELECT split_part(label, '_', 1) AS energy, CASE WHEN instr(label, '_') > 0 THEN substr(label, instr(label, '_')) ELSE '' END AS system FROM
    (SELECT CASE WHEN p_size % 3 = 0 THEN p_size || 'keV' ELSE p_size || 'keV_' || p_brand || '_x' END AS label FROM part WHERE p_retailprice > 0)) GROUP BY ALL""")
def label_tags(spark, sf_dir):
    """Energy and system of labels whose values are positive."""
    p = views.read(spark, sf_dir, "part").filter(F.col("p_retailprice") > 0)
    label = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size"), F.lit("keV"))).otherwise(F.concat(F.col("p_size"), F.lit("keV_"), F.col("p_brand"), F.lit("_x")))
    energy, system = grids.label_parts(label)
    return p.groupBy(energy.alias("energy"), system.alias("system")).agg(F.count(F.lit(1)).alias("n"))


def _gauss_sql() -> str:
    """Three passes of a window of 5 places with sigma 1 over the five moments, axis by axis."""
    w = f"exp(-0.5e0 * k * k) / {sum(math.exp(-0.5 * k * k) for k in range(-2, 3))!r}"
    out, source = [], "m0"
    for step, (axis, n) in enumerate((("ix", 8), ("iy", 8), ("iz", 8))):
        others = [a for a in ("ix", "iy", "iz") if a != axis]
        cols = ", ".join(f"sum(s.{v} * w) AS {v}" for v in ("x", "y", "xx", "yy", "xy"))
        out.append(f"m{step + 1} AS (SELECT s.vol, g.i AS {axis}, s.{others[0]}, s.{others[1]}, {cols} FROM (SELECT i, least(greatest(i + k, 0), {n - 1}) AS src, {w} AS w FROM range({n}) a(i), range(-2, 3) b(k)) g JOIN {source} s ON s.{axis} = g.src GROUP BY s.vol, g.i, s.{others[0]}, s.{others[1]})")
        source = f"m{step + 1}"
    return ", ".join(out)


@query(f"""WITH v2 AS (SELECT vol, ix, iy, iz, v AS x, (v * 3 + ix) % 23 AS y FROM v_vox WHERE vol < (SELECT count(*) FROM embeddings) // 8), m0 AS (SELECT *, x * x AS xx, y * y AS yy, x * y AS xy FROM v2), {_gauss_sql()}
    SELECT vol, round(avg((2 * x * y + 0.0529e0) * (2 * (xy - x * y) + 0.4761e0) / ((x * x + y * y + 0.0529e0) * (xx - x * x + yy - y * y + 0.4761e0))), 6) AS ssim FROM m3 GROUP BY vol""")
def ssim_gaussian(spark, sf_dir):
    """Similarity in Gaussian windows of every volume that has all its planes."""
    whole = views.read(spark, sf_dir, "embeddings").count() // 8
    v = views.voxels(spark, sf_dir).filter(F.col("vol") < whole)
    w = v.select("vol", "ix", "iy", "iz", ((F.col("v") * 3 + F.col("ix")) % 23).alias("v"))
    return grids.ssim(v, w, (8, 8, 8), 23.0, 1.0, 2, "vol").groupBy("vol").agg(r6(F.avg("ssim")).alias("ssim"))


@query(f"WITH {_LIST} SELECT cp1, count(DISTINCT event_id)::BIGINT AS events, round(sum(t * pixel_id), 4) AS moment FROM tl JOIN v_event USING (event_id) GROUP BY cp1")
def packed_rows(spark, sf_dir):
    """Event rows packed with their first hit, and unpacked again."""
    long = list_rows(spark, sf_dir, "cp1").select("event_id", "cp1", F.posexplode("t").alias("pixel_id", "t"))
    out = kernel.unpacked(kernel.packed(long))
    return out.groupBy("cp1").agg(F.countDistinct("event_id").alias("events"), F.round(F.sum(F.col("t") * F.col("pixel_id")), 4).alias("moment"))


@query("""SELECT method, count(*)::BIGINT AS repeats, round(avg(a), 6) AS mean, round(stddev_samp(a), 6) AS deviation FROM (SELECT method, repeat, avg(ok::INTEGER) AS a FROM (SELECT view % 5 AS repeat, unnest(['cross', 'near']) AS method, unnest([cp1 % 4 <> cp2 % 4, abs(cp1 - cp2) < 16]) AS ok FROM v_event) GROUP BY method, repeat) GROUP BY method""")
def repeat_collation(spark, sf_dir):
    """A metric of two methods over five repeats: mean and deviation."""
    e = views.events(spark, sf_dir)
    ok = F.array(F.struct(F.lit("cross").alias("method"), (F.col("cp1") % 4 != F.col("cp2") % 4).alias("ok")), F.struct(F.lit("near").alias("method"), (F.abs(F.col("cp1") - F.col("cp2")) < 16).alias("ok")))
    each = e.select((F.col("view") % 5).alias("repeat"), F.explode(ok).alias("m")).groupBy("m.method", "repeat").agg(F.avg(F.col("m.ok").cast("int")).alias("a"))
    return ev.collated(each, "a", "method")
