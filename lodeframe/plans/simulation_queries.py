"""Queries on cross sections, photons, responses and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import energy, geometry, random
from ..operators import metrics, response, simulate
from ..sources import macros
from . import views
from .catalogue import query

E0 = views.E0


def r6(c):
    return F.round(c, 6)


_XS = "xs AS (SELECT energy, max_by(total, line_no) AS total FROM v_xs GROUP BY energy), br AS (SELECT energy AS lo, lead(energy) OVER (ORDER BY energy) AS hi, total AS a, lead(total) OVER (ORDER BY energy) AS b, row_number() OVER (ORDER BY energy) AS n FROM xs)"


@query(f"WITH {_XS}, e AS (SELECT event_id, value % 700 / 1000 AS x FROM events) SELECT event_id, round(CASE WHEN hi IS NULL THEN a ELSE a + least(greatest((x - lo) / (hi - lo), 0), 1) * (b - a) END, 10) AS total FROM e LEFT JOIN br ON (x >= lo OR n = 1) AND (hi IS NULL OR x < hi)")
def xs_bracket_interp(spark, sf_dir):
    e = views.read(spark, sf_dir, "events").select("event_id", (F.col("value") % 700 / 1000).alias("x"))
    t = simulate.last_wins(views.cross_sections(spark), "energy", "line_no").select("energy", "total")
    return simulate.interpolated(e, "x", t, "energy", ["total"]).select("event_id", F.round("total", 10).alias("total"))


@query("""WITH s AS (SELECT DISTINCT (event_id % 97 + 3) * 0.01e0 AS energy, count(*) OVER (PARTITION BY event_id % 97)::BIGINT AS n FROM events), g AS (SELECT energy, n, i, i * (2.0e0 / 512) - 1 AS mu, 1 / (1 + energy / 0.511e0 * (1 - (i * (2.0e0 / 512) - 1))) AS k FROM s, range(513) t(i)), f AS (SELECT *, k * k * (k + 1 / k - (1 - mu * mu)) AS f FROM g)
    SELECT energy, n, round(2 * 3.141592653589793e0 * sum((f + before) / 2 * step), 6) AS norm FROM (SELECT *, lag(f) OVER w AS before, mu - lag(mu) OVER w AS step FROM f WINDOW w AS (PARTITION BY energy ORDER BY i)) GROUP BY energy, n""")
def kn_normalisation(spark, sf_dir):
    """The density's integral at each incident energy of the events, by trapezoids as end and inner weights, so no order is needed."""
    e = views.read(spark, sf_dir, "events").groupBy(((F.col("event_id") % 97 + 3) * 0.01).alias("energy")).agg(F.count(F.lit(1)).alias("n"))
    mu = F.col("i") * (2.0 / 512) - 1
    f = energy.klein_nishina_pdf(mu, F.col("energy") / energy.ELECTRON)
    weight = F.when(F.col("i").isin(0, 512), 0.5).otherwise(1.0)
    return e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(512)))).groupBy("energy", "n").agg(r6(2 * 3.141592653589793 * F.sum(f * weight) * (2.0 / 512)).alias("norm"))


_U = [random.sql_uniform("id", s) for s in range(4)]


def photons(spark, sf_dir):
    """A photon for each event."""
    return views.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"))


@query(f"""SELECT outcome, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM (SELECT CASE WHEN -ln(greatest({_U[1]}, 1e-15)) / 0.325e0 > 1.0e0 THEN 'transmitted' WHEN {_U[2]} < 0.058e0 / 0.325e0 THEN 'photoelectric' WHEN {_U[3]} < 0.56e0 THEN 'scatter_escaped' ELSE 'scatter_absorbed' END AS outcome
    FROM (SELECT event_id AS id FROM events)) GROUP BY outcome""".replace("0.325e0", "(0.058e0 + 0.267e0)"))
def slab_outcomes(spark, sf_dir):
    from pyspark.sql import Window

    n = simulate.slab(photons(spark, sf_dir), 1.0, 0.058, 0.267, 0.56).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))  # four rows


_COSINES = """g AS (SELECT i, i * (2.0e0 / 512) - 1 AS mu, 1 / (1 + (1 - (i * (2.0e0 / 512) - 1))) AS k FROM range(513) t(i)), f AS (SELECT i, mu, k * k * (k + 1 / k - (1 - mu * mu)) AS f FROM g),
    s AS (SELECT i, mu, coalesce((f + lag(f) OVER (ORDER BY i)) / 2, 0) AS step FROM f), q AS (SELECT mu, sum(step) OVER (ORDER BY i) / (SELECT sum(step) FROM s) AS q FROM s), c AS (SELECT q, mu, lead(q) OVER (ORDER BY q) AS q2, lead(mu) OVER (ORDER BY q) AS mu2 FROM q)"""


@query(f"""WITH {_XS}, {_COSINES}, p AS (SELECT event_id AS id, {_U[1].replace("id::", "event_id::")} AS u FROM events),
    m AS (SELECT id, mu + (u - q) / (q2 - q) * (mu2 - mu) AS mu FROM p ASOF JOIN c ON p.u >= c.q), e AS (SELECT id, mu, 0.511e0 / (1 + (1 - mu)) AS energy FROM m),
    t AS (SELECT id, mu, e.energy, a + (e.energy - lo) / (hi - lo) * (b - a) AS total FROM e ASOF JOIN br ON e.energy >= br.lo),
    w AS (SELECT unnest(['path', 'energy', 'mu']) AS what, unnest([-ln(greatest({_U[2]}, 1e-15)) / (total * {energy.NAI_DENSITY!r}::DOUBLE), energy, mu]) AS v FROM t)
    SELECT what, count(*)::BIGINT AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.05), 6) AS p05, round(median(v), 6) AS median, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max FROM w GROUP BY what""")
def freepath_summary(spark, sf_dir):
    """Summaries of scattered photons' free paths and energies; tests hold them against the published means."""
    p = simulate.scattered(photons(spark, sf_dir), E0, views.cross_sections(spark))
    each = p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("v")) for c in ("path", "energy", "mu")])))
    return metrics.summary(each, F.col("v"), "what").select("what", "n", *[r6(c).alias(c) for c in ("mean", "std", "min", "p05", "median", "p95", "max")])


@query(f"SELECT o_orderkey, round(greatest(round(y + sqrt(y) * {random.sql_normal('o_orderkey')}), 0), 6) AS noisy FROM (SELECT o_orderkey, o_totalprice / 1000 AS y FROM orders)")
def noisy_projection(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("y"))
    return o.select("o_orderkey", r6(simulate.noisy(F.col("y"), F.col("o_orderkey"))).alias("noisy"))


_RESPONSE = """src AS (SELECT s_suppkey AS source, (s_suppkey % 9 - 4) * 4.0e0 AS px, (s_suppkey % 7 - 3) * 4.0e0 AS pz FROM supplier),
    r AS (SELECT source, f.det_id AS front, b.det_id AS rear, bin, 9.0e0 * f.y / (4 * 3.141592653589793e0 * power((f.x - px) * (f.x - px) + f.y * f.y + (f.z - pz) * (f.z - pz), 1.5e0)) * exp(-0.0325e0 * sqrt((f.x - b.x) * (f.x - b.x) + (f.y - b.y) * (f.y - b.y) + (f.z - b.z) * (f.z - b.z)) / 10) * exp(-0.5e0 * power((0.05e0 + 0.06e0 * bin - 0.2e0) / 0.05e0, 2)) AS weight
    FROM src, v_det f, v_det b, range(5) t(bin) WHERE f.layer < 4 AND b.layer = 4)"""
_FLAT = "(((bin * 64 + rear - 1) * 64) + front - 1)"


@query(f"WITH {_RESPONSE} SELECT source, rank, flat_index, front, rear, bin::INTEGER AS bin, round(weight, 9) AS weight FROM (SELECT *, {_FLAT} AS flat_index, row_number() OVER (PARTITION BY source ORDER BY round(weight, 12) DESC, {_FLAT})::INTEGER AS rank FROM r) WHERE rank <= 5")
def top_k_response(spark, sf_dir):
    """The five largest entries of each source's response over detector pairs and energy bins, by their place with the first axis running first (a top-k report)."""
    from pyspark.sql import Window

    d = views.detectors(spark)
    name = lambda df, s: df.select(*[F.col(c).alias(f"{s}{c}") for c in ("det_id", "x", "y", "z")])
    f, b = name(d.filter("layer < 4"), "f"), name(d.filter("layer = 4"), "b")
    cells = f.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(spark.range(5).select(F.col("id").cast("int").alias("bin"))))  # a machine's detectors and bins
    source = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), ((F.col("s_suppkey") % 9 - 4) * 4.0).alias("px"), F.lit(0.0).alias("py"), ((F.col("s_suppkey") % 7 - 3) * 4.0).alias("pz"))
    place = ["px", "py", "pz"]

    def largest(places):
        met = places.crossJoin(F.broadcast(cells))
        leg, pf, pb = geometry.minus(geometry.point("f"), geometry.point("p")), geometry.point("f"), geometry.point("b")
        area = 9.0 * F.col("fy") / (4 * 3.141592653589793 * F.pow(geometry.dot(leg, leg), F.lit(1.5)))
        weight = area * F.exp(-0.0325 * geometry.norm(geometry.minus(pf, pb)) / 10) * F.exp(-0.5 * F.pow((0.05 + 0.06 * F.col("bin") - 0.2) / 0.05, F.lit(2)))
        flat = geometry.flat_index(F.col("fdet_id").cast("long") - 1, F.col("bdet_id") - 1, F.col("bin"), (64, 64, 5), "F").alias("flat_index")
        every = met.select(*place, flat, F.col("fdet_id").alias("front"), F.col("bdet_id").alias("rear"), "bin", weight.alias("weight"))
        rank = F.row_number().over(Window.partitionBy(*place).orderBy(F.desc(F.round("weight", 12)), "flat_index"))
        return every.withColumn("rank", rank).filter("rank <= 5").withColumn("weight", F.round("weight", 9))

    return response.by_place(source, place, largest).drop(*place)


_SOURCES = "SELECT p_brand || '.mac' AS file, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INTEGER AS n, p_retailprice AS weight, CASE WHEN p_size % 2 = 0 THEN 'Cylinder' ELSE 'Sphere' END AS shape, p_size * 0.5e0 AS x, -1.0e0 * p_size AS y, (p_partkey % 13)::DOUBLE AS z, p_size / 4.0e0 AS radius FROM part"


@query(f"SELECT file, n, weight, shape, x, y, z, round(radius, 6) AS radius FROM ({_SOURCES})")
def macro_parse(spark, sf_dir):
    """Parts as sources of a macro file for each brand, written as text and parsed again."""
    from pyspark.sql import Window

    p = views.read(spark, sf_dir, "part")
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    shape = F.when(F.col("p_size") % 2 == 0, "Cylinder").otherwise("Sphere")
    df = p.select(F.concat("p_brand", F.lit(".mac")).alias("file"), n.alias("n"), F.col("p_retailprice").alias("weight"), shape.alias("shape"), (F.col("p_size") * 0.5).alias("x"), (-1.0 * F.col("p_size")).alias("y"), (F.col("p_partkey") % 13).cast("double").alias("z"), (F.col("p_size") / 4.0).alias("radius"))
    return macros.parse(macros.text(df)).select("file", "n", "weight", "shape", "x", "y", "z", r6("radius").alias("radius"))


@query("""SELECT vol, view::INTEGER AS view, row_number() OVER (PARTITION BY vol, view ORDER BY iz, iy, ix)::INTEGER AS n, CASE WHEN row_number() OVER (PARTITION BY vol, view ORDER BY iz, iy, ix) = 1 THEN 1 ELSE round(v / max(v) OVER (PARTITION BY vol, view), 8) END AS weight,
    round(((ix - 3.5e0) * 4) * cos(radians(-90.0e0 * view)) - ((iy - 3.5e0) * 4) * sin(radians(-90.0e0 * view)) + 1.5e0, 3) + 0.0e0 AS x, round(((ix - 3.5e0) * 4) * sin(radians(-90.0e0 * view)) + ((iy - 3.5e0) * 4) * cos(radians(-90.0e0 * view)) - 2.5e0, 3) + 0.0e0 AS y, (iz - 3.5e0) * 5 AS z, 2.5e0 AS halfz
    FROM v_vox, range(4) t(view) WHERE v > 18""")
def turned_macros(spark, sf_dir):
    """Bright voxels of every volume as sources of four turned runs, written as macro text and parsed again."""
    v = views.voxels(spark, sf_dir).filter("v > 18")
    sources = macros.turned(macros.voxel_sources(v, (8, 8, 8), (4.0, 4.0, 5.0), "vol"), 4, (1.5, -2.5))
    back = macros.parsed(macros.run_text(sources, 511, 1000, "vol", "view"), "vol", "view")
    return back.select("vol", "view", "n", F.round("weight", 8).alias("weight"), *[(F.round(c, 3) + 0.0).alias(c) for c in "xy"], "z", "halfz")


@query("SELECT bin::INTEGER AS bin, count(*)::BIGINT AS n, round(count(*) / (sum(count(*)) OVER () * 0.0511e0), 6)::DOUBLE AS density FROM (SELECT least(floor(e1 / 0.0511e0), 9) AS bin FROM v_event WHERE e1 >= 0) GROUP BY bin")
def histogram_density(spark, sf_dir):
    from pyspark.sql import Window

    at = F.least(F.floor(F.col("e1") / 0.0511), F.lit(9)).cast("int")
    n = views.events(spark, sf_dir).filter("e1 >= 0").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("density", r6(F.col("n") / (F.sum("n").over(Window.partitionBy()) * 0.0511)))  # ten rows
