"""Queries on rotations, rings, neighbours, subsets and thinning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import random
from ..operators import kernel, rotation, sampling
from . import views
from .catalogue import query


def r6(c):
    return F.round(c, 6)


_ROT = "rot AS (SELECT view::INTEGER AS view, pixel_id, (base + (view * n // 8 + theta_id) % n)::INTEGER AS src_pixel_id FROM v_pix, range(8) t(view))"
_SPOT = "spot AS (SELECT event_id, ((view - 1) % 8)::INTEGER AS view, (cp1 - 1)::INTEGER AS pixel_id, (event_id % 3)::INTEGER AS z FROM v_event)"


def spots(spark, sf_dir):
    """An event as a pixel of a view and a plane."""
    e = views.events(spark, sf_dir)
    return e.select("event_id", ((F.col("view") - 1) % views.VIEWS).alias("view"), (F.col("cp1") - 1).alias("pixel_id"), (F.col("event_id") % 3).cast("int").alias("z"))


def turns(spark):
    return rotation.rotation_map(views.pixels(spark), views.VIEWS)


@query(f"WITH {_ROT}, {_SPOT} SELECT event_id, view, pixel_id, src_pixel_id FROM spot JOIN rot USING (view, pixel_id)")
def rotation_map(spark, sf_dir):
    """Where each event's pixel comes from at its view."""
    return spots(spark, sf_dir).join(F.broadcast(turns(spark)), ["view", "pixel_id"]).select("event_id", "view", "pixel_id", "src_pixel_id")


@query(f"WITH {_ROT}, {_SPOT} SELECT event_id, spot.view, spot.pixel_id, rot.pixel_id AS src_pixel_id FROM spot JOIN rot ON spot.view = rot.view AND spot.pixel_id = src_pixel_id")
def inverse_rotation(spark, sf_dir):
    return spots(spark, sf_dir).join(F.broadcast(rotation.inverse(turns(spark))), ["view", "pixel_id"]).select("event_id", "view", "pixel_id", "src_pixel_id")


@query(f"WITH {_ROT}, {_SPOT} SELECT event_id, view, (pixel_id + z * 64)::INTEGER AS pixel_id, (src_pixel_id + z * 64)::INTEGER AS src_pixel_id FROM spot JOIN rot USING (view, pixel_id)")
def rotation_all_planes(spark, sf_dir):
    planes = rotation.all_planes(turns(spark), views.PIXELS, 3)
    s = spots(spark, sf_dir).select("event_id", "view", (F.col("pixel_id") + F.col("z") * views.PIXELS).alias("pixel_id"))
    return s.join(F.broadcast(planes), ["view", "pixel_id"]).select("event_id", "view", "pixel_id", "src_pixel_id")


@query("SELECT vec_id, view::INTEGER AS view, pixel_id, v FROM v_img, range(8) t(view)")
def rotate_image_roundtrip(spark, sf_dir):
    """Every image turned to all views and back."""
    rot = F.broadcast(turns(spark))
    return rotation.rotate(rotation.rotate(views.images(spark, sf_dir), rot), F.broadcast(rotation.inverse(turns(spark))))


@query("SELECT user_id, run, count(*)::BIGINT AS n, round(min(value), 6) AS least FROM (SELECT user_id, value, (sum(CASE WHEN abs(value - before) > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id))::INTEGER AS run FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS before FROM events)) GROUP BY user_id, run")
def ring_runs(spark, sf_dir):
    """Each user's values in runs without a gap of over 20, as rings of pixels are told apart by their radii."""
    e = views.read(spark, sf_dir, "events")
    return rotation.runs(e, F.col("value"), ["value", "event_id"], 20.0, "user_id").groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), r6(F.min("value")).alias("least"))


@query("SELECT p_partkey, role, place::INTEGER AS place, det_id, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, role ORDER BY d2, det_id) AS place FROM (SELECT p_partkey, CASE WHEN layer = 4 THEN 'rear' ELSE 'front' END AS role, det_id, (x - (p_size - 25.0e0)) * (x - (p_size - 25.0e0)) + (z - p_partkey % 31) * (z - p_partkey % 31) AS d2 FROM part, v_det WHERE y > 0)) WHERE place <= 2")
def nearest_detectors(spark, sf_dir):
    """The two nearest detectors of each role to each part's place."""
    d = views.detectors(spark).filter("y > 0").withColumn("role", F.when(F.col("layer") == 4, "rear").otherwise("front"))
    p = views.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 25.0).alias("px"), (F.col("p_partkey") % 31).alias("pz"))
    d2 = lambda e: (e["x"] - F.col("px")) * (e["x"] - F.col("px")) + (e["z"] - F.col("pz")) * (e["z"] - F.col("pz"))
    return rotation.nearest(p, d, d2, 2, "det_id", "role").select("p_partkey", "role", "place", "det_id", r6("d2").alias("d2"))


@query("SELECT p_partkey, (SELECT min_by(l, abs(l - p_retailprice % 200) * 1000 + l) FROM (SELECT DISTINCT y AS l FROM v_det)) AS nearest FROM part")
def nearest_layer(spark, sf_dir):
    p = views.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") % 200).alias("value"))
    return rotation.nearest_value(p, "value", views.detectors(spark), "y").select("p_partkey", "nearest")


@query(f"SELECT bin_id, y, coalesce(kept, 0)::BIGINT AS kept FROM v_cnt LEFT JOIN (SELECT bin_id, count(*) AS kept FROM (SELECT bin_id, row_number() OVER (PARTITION BY bin_id % 10 ORDER BY {random.sql_uniform('(bin_id * 1000 + unit)', 5)}, bin_id, unit) AS place FROM (SELECT bin_id, unnest(range(1, y::INTEGER + 1)) AS unit FROM v_cnt)) WHERE place <= 40 GROUP BY bin_id) USING (bin_id) WHERE y > 0")
def thin_without_replacement(spark, sf_dir):
    """Forty units of each view, in a random order."""
    c = views.counts(spark, sf_dir).withColumn("view", F.col("bin_id") % 10)
    return sampling.thin_without_replacement(c, "y", F.lit(40), random.uniform(F.col("bin_id") * 1000 + F.col("unit"), 5), "view").select("bin_id", "y", "kept")


@query("SELECT bin_id, round(y * wanted / own, 6) AS expected FROM (SELECT bin_id, y, bin_id % 10 AS view, sum(y) OVER (PARTITION BY bin_id % 10) AS own FROM v_cnt) JOIN (SELECT view % 10 AS view, count(*)::DOUBLE AS wanted FROM v_event GROUP BY 1) USING (view)")
def thin_expected(spark, sf_dir):
    c = views.counts(spark, sf_dir).withColumn("view", F.col("bin_id") % 10)
    wanted = views.events(spark, sf_dir).groupBy((F.col("view").cast("long") % 10).alias("view")).agg(F.count(F.lit(1)).cast("double").alias("wanted"))
    return sampling.thin_expected(c, "y", wanted, "view", "wanted").select("bin_id", r6("expected").alias("expected"))


@query(f"""WITH u AS (SELECT bin_id, y, {random.sql_uniform('bin_id')} AS u, unnest(range(y::INTEGER)) AS k FROM v_cnt), c AS (SELECT bin_id, u, sum(exp(lgamma(y + 1) - lgamma(k + 1) - lgamma(y - k + 1) + k * ln(0.3e0) + (y - k) * ln(0.7e0))) OVER (PARTITION BY bin_id ORDER BY k) AS below FROM u)
    SELECT bin_id, y, coalesce(kept, 0)::BIGINT AS kept FROM v_cnt LEFT JOIN (SELECT bin_id, count(*) FILTER (u >= below) AS kept FROM c GROUP BY bin_id) USING (bin_id)""")
def thin_binomial(spark, sf_dir):
    return sampling.thin_binomial(views.counts(spark, sf_dir), "y", 0.3, F.col("bin_id"))


@query(f"SELECT view, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM (SELECT *, count(*) OVER (PARTITION BY view) AS total, row_number() OVER (PARTITION BY view ORDER BY {random.sql_uniform('event_id')}, event_id) AS place FROM v_event) WHERE place <= greatest(1, floor(total * 0.3e0)) GROUP BY view")
def event_subsample(spark, sf_dir):
    return sampling.sample_rows(views.events(spark, sf_dir), 0.3, "event_id", "view").groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"SELECT iteration::INTEGER AS iteration, subset, count(*)::BIGINT AS n FROM (SELECT iteration, CASE iteration WHEN 0 THEN least(floor({random.sql_uniform('bin_id', 0)} * 4), 3) ELSE least(floor({random.sql_uniform('bin_id', 1)} * 4), 3) END::INTEGER AS subset FROM v_cnt, range(2) t(iteration)) GROUP BY ALL")
def random_subsets(spark, sf_dir):
    c = views.counts(spark, sf_dir)
    out = [c.select(F.lit(i).alias("iteration"), sampling.random_subset(F.col("bin_id"), 4, i).alias("subset")) for i in range(2)]
    return out[0].unionByName(out[1]).groupBy("iteration", "subset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT view, balanced, ceiled, count(*)::BIGINT AS n FROM (SELECT view, (ceil((place + 1) * 7 / total) - 1)::INTEGER AS balanced, floor(place / ceil(total / 7))::INTEGER AS ceiled FROM (SELECT view, row_number() OVER (PARTITION BY view ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY view) AS total FROM v_event)) GROUP BY ALL")
def balanced_chunks(spark, sf_dir):
    w = Window.partitionBy("view")
    e = views.events(spark, sf_dir).select("view", (F.row_number().over(w.orderBy("event_id")) - 1).alias("place"), F.count(F.lit(1)).over(w).alias("total"))
    at = e.select("view", sampling.balanced_chunk(F.col("place"), F.col("total"), 7).alias("balanced"), sampling.ceil_chunk(F.col("place"), F.col("total"), 7).alias("ceiled"))
    return at.groupBy("view", "balanced", "ceiled").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT view, held, count(*)::BIGINT AS n FROM v_event JOIN (SELECT view, row_number() OVER (ORDER BY {random.sql_uniform('view')}, view) <= least(greatest(1, round(count(*) OVER () * 0.25e0)), count(*) OVER () - 1) AS held FROM (SELECT DISTINCT view FROM v_event)) USING (view) GROUP BY ALL")
def group_split(spark, sf_dir):
    return sampling.split(views.events(spark, sf_dir), "view", 0.25).groupBy("view", "held").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT cp1 FROM v_event UNION ALL SELECT cp2 FROM v_event) UNION ALL SELECT 'distinct', count(*) FROM (SELECT cp1 FROM v_event UNION SELECT cp2 FROM v_event) UNION ALL SELECT 'intersect', count(*) FROM (SELECT cp1 FROM v_event WHERE view < 5 INTERSECT SELECT cp2 FROM v_event WHERE view > 15) UNION ALL SELECT 'except', count(*) FROM (SELECT cp1 FROM v_event WHERE view < 5 EXCEPT SELECT cp2 FROM v_event WHERE view = 20)")
def union_intersect_except_bins(spark, sf_dir):
    e = views.events(spark, sf_dir)
    a, b = e.select(F.col("cp1").alias("c")), e.select(F.col("cp2").alias("c"))
    few = e.filter("view < 5").select(F.col("cp1").alias("c"))
    sets = [("union", a.unionByName(b)), ("distinct", a.unionByName(b).distinct()), ("intersect", few.intersect(e.filter("view > 15").select(F.col("cp2").alias("c")))), ("except", few.subtract(e.filter("view = 20").select(F.col("cp2").alias("c"))))]
    out = [s.agg(F.lit(n).alias("op"), F.count(F.lit(1)).alias("n")) for n, s in sets]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_EXPAND = """ex AS (SELECT pixel_id AS fine, (base // 2 + theta_id // 2)::INTEGER AS coarse, 1 - (theta_id % 2) / 2.0e0 AS w FROM v_pix UNION ALL
    SELECT pixel_id, (base // 2 + (theta_id // 2 + 1) % (n // 2))::INTEGER, (theta_id % 2) / 2.0e0 FROM v_pix WHERE theta_id % 2 = 1)"""
_COARSE = "coarse AS (SELECT vec_id, (base // 2 + theta_id // 2)::INTEGER AS pixel_id, v FROM v_pix JOIN v_img USING (pixel_id) WHERE theta_id % 2 = 0)"


@query(f"WITH {_COARSE}, {_EXPAND} SELECT vec_id, fine AS pixel_id, round(sum(w * v), 6) AS v FROM ex JOIN coarse ON ex.coarse = coarse.pixel_id GROUP BY vec_id, fine")
def coarse_reduce_expand(spark, sf_dir):
    """Every image on the coarse grid and back."""
    p = views.pixels(spark)
    coarse = kernel.weighted(views.images(spark, sf_dir), kernel.reduce_weights(p, 2), "fine", "coarse", "vec_id")
    return kernel.weighted(coarse, kernel.expand_weights(p, 2), "coarse", "fine", "vec_id").select("vec_id", "pixel_id", r6("v").alias("v"))


@query(f"WITH {_EXPAND} SELECT vec_id, coarse AS pixel_id, round(sum(w * v), 6) AS v FROM ex JOIN v_img ON ex.fine = v_img.pixel_id GROUP BY vec_id, coarse")
def expand_adjoint(spark, sf_dir):
    return kernel.weighted(views.images(spark, sf_dir), kernel.expand_weights(views.pixels(spark), 2), "fine", "coarse", "vec_id").select("vec_id", "pixel_id", r6("v").alias("v"))
