"""Queries on volumes, regions, poses and detectors. The volumes are ``views.voxels``: their number grows with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import image as im
from ..operators import metrics
from . import views
from .catalogue import query

SIZE = 25.0


def r6(c):
    return F.round(c, 6)


_RODS = ((-40.0, 0.0, 26.0, 4.0), (40.0, 0.0, 26.0, 6.0), (0.0, 40.0, 20.0, 8.0))
_X, _Y, _Z = (f"((i{c} - 3.5e0) * 25)" for c in "xyz")
_IN = lambda cx, cy, r: f"({_X} - {cx!r}) * ({_X} - {cx!r}) + ({_Y} - {cy!r}) * ({_Y} - {cy!r}) <= {r * r!r}"
_SHAPES = [("cylinder", (cx, cy, 0.0), (r, 70.0), a) for cx, cy, r, a in _RODS] + [("box", (0.0, -50.0, 0.0), (20.0, 15.0, 90.0), 3.0), ("ellipsoid", (0.0, 0.0, 0.0), (85.0, 80.0, 95.0), 1.0)]
_SHAPES_SQL = "CASE " + " ".join(f"WHEN {_IN(cx, cy, r)} AND abs({_Z}) <= 70 THEN {a!r}::DOUBLE" for cx, cy, r, a in _RODS)
_SHAPES_SQL += f" WHEN abs({_X}) <= 20 AND abs({_Y} + 50) <= 15 AND abs({_Z}) <= 90 THEN 3.0e0 WHEN {_X} / 85 * {_X} / 85 + {_Y} / 80 * {_Y} / 80 + {_Z} / 95 * {_Z} / 95 <= 1 THEN 1.0e0 ELSE 0.0e0 END"


def xyz():
    return tuple(geometry.voxel_centre(F.col(c), views.SIDE, SIZE) for c in ("ix", "iy", "iz"))


@query(f"SELECT vol, ix, iy, iz, ({_SHAPES_SQL})::DOUBLE AS truth, v - ({_SHAPES_SQL})::DOUBLE AS error FROM v_vox")
def phantom_raster(spark, sf_dir):
    """Every voxel against a phantom of cylinders, a box and an ellipsoid."""
    grid = views.voxels(spark, sf_dir).withColumnRenamed("v", "seen")
    return im.raster(grid, xyz(), _SHAPES).select("vol", "ix", "iy", "iz", F.col("v").alias("truth"), (F.col("seen") - F.col("v")).alias("error"))


_ROI, _BACK = _IN(40.0, 0.0, 26.0), f"({_IN(0.0, 0.0, 80.0)}) AND NOT ({_IN(-40.0, 0.0, 30.0)}) AND NOT ({_IN(40.0, 0.0, 30.0)}) AND NOT ({_IN(0.0, 40.0, 24.0)})"
_CRC = f"""SELECT vol, iz, count(*) FILTER ({_ROI})::BIGINT AS n_roi, count(*) FILTER ({_BACK})::BIGINT AS n_background, avg(v) FILTER ({_ROI}) AS roi_mean, avg(v) FILTER ({_BACK}) AS background_mean, stddev_pop(v) FILTER ({_BACK}) AS background_std FROM v_vox GROUP BY vol, iz"""


def masks():
    x, y, _ = xyz()
    background = geometry.in_disk(x, y, 0.0, 0.0, 80.0)
    for cx, cy, r, _ in _RODS:
        background = background & ~geometry.in_disk(x, y, cx, cy, r + 4.0)
    return geometry.in_disk(x, y, 40.0, 0.0, 26.0), background


@query(f"SELECT vol, iz, n_roi, n_background, round((roi_mean / background_mean - 1) / 5, 6) AS crc, round((roi_mean - background_mean) / background_std, 6) AS cnr FROM ({_CRC})")
def roi_crc_cnr(spark, sf_dir):
    out = metrics.contrast(views.voxels(spark, sf_dir), F.col("v"), *masks(), 6.0, "vol", "iz")
    return out.select("vol", "iz", "n_roi", "n_background", r6("crc").alias("crc"), r6("cnr").alias("cnr"))


@query(f"SELECT iz, count(*)::BIGINT AS runs, round(avg(crc), 6) AS mean_crc, round(stddev_samp(crc), 6) AS std_crc, round(avg(cnr), 6) AS mean_cnr, round(stddev_samp(cnr), 6) AS std_cnr FROM (SELECT iz, (roi_mean / background_mean - 1) / 5 AS crc, (roi_mean - background_mean) / background_std AS cnr FROM ({_CRC})) GROUP BY iz")
def run_average_crc(spark, sf_dir):
    """The volumes stand for runs, and a plane for a layer of the phantom."""
    out = metrics.contrast(views.voxels(spark, sf_dir), F.col("v"), *masks(), 6.0, "vol", "iz")
    return out.groupBy("iz").agg(F.count(F.lit(1)).alias("runs"), *[r6(f(c)).alias(f"{n}_{c}") for c in ("crc", "cnr") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


@query("SELECT vol, ix, iy, max(v) AS mip, round(avg(v) FILTER (iz BETWEEN 1 AND 2), 6) AS slab FROM v_vox GROUP BY vol, ix, iy")
def mip_and_slab_mean(spark, sf_dir):
    v = views.voxels(spark, sf_dir)
    return im.maximum_projection(v, "vol", "ix", "iy").withColumnRenamed("v", "mip").join(im.slab_mean(v, 1, 2, "vol").select("vol", "ix", "iy", r6("v").alias("slab")), ["vol", "ix", "iy"], "left")


@query("SELECT vol, (ix // 2)::INTEGER AS ix, (iy // 2)::INTEGER AS iy, (iz // 2)::INTEGER AS iz, round(avg(v), 6) AS v FROM v_vox GROUP BY vol, ix // 2, iy // 2, iz // 2")
def block_downsample(spark, sf_dir):
    return im.block_average(views.voxels(spark, sf_dir), 2, "vol").withColumn("v", r6("v"))


_PLACE = "SELECT event_id AS id, event_id % 62 AS vol, (event_id % 8)::INTEGER AS plane, value % 11 - 1 AS u, (value * 7) % 9 AS t, (value * 3) % 10 - 1 AS s FROM events"


def placed(spark, sf_dir):
    e = views.read(spark, sf_dir, "events")
    value = F.col("value")
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") % 62).alias("vol"), (F.col("event_id") % 8).cast("int").alias("iz"), (value % 11 - 1).alias("u"), (value * 7 % 9).alias("t"), (value * 3 % 10 - 1).alias("s"))


@query(f"""SELECT id, round(sum(w * coalesce(v, 0)), 6) AS v FROM (SELECT id, vol, plane AS iz, (floor(u) + dx)::INTEGER AS ix, (floor(t) + dy)::INTEGER AS iy, (1 - abs(u - floor(u) - dx)) * (1 - abs(t - floor(t) - dy)) AS w
    FROM ({_PLACE}), (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)) LEFT JOIN v_vox USING (vol, ix, iy, iz) GROUP BY id""")
def bilinear_sample(spark, sf_dir):
    return im.bilinear(placed(spark, sf_dir), views.voxels(spark, sf_dir), F.col("u"), F.col("t"), ["id"], "vol", "iz").select("id", r6("v").alias("v"))


@query(f"""SELECT id, round(sum(w * coalesce(v, 0)), 6) AS v FROM (SELECT id, vol, (floor(u) + dx)::INTEGER AS ix, (floor(t) + dy)::INTEGER AS iy, (floor(s) + dz)::INTEGER AS iz, (1 - abs(u - floor(u) - dx)) * (1 - abs(t - floor(t) - dy)) * (1 - abs(s - floor(s) - dz)) AS w
    FROM ({_PLACE}), (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz)) LEFT JOIN v_vox USING (vol, ix, iy, iz) GROUP BY id""")
def trilinear_sample(spark, sf_dir):
    """An event's volume at its place on three axes, some of them outside."""
    return im.trilinear(placed(spark, sf_dir).drop("iz"), views.voxels(spark, sf_dir), F.col("u"), F.col("t"), F.col("s"), ["id"], "vol").select("id", r6("v").alias("v"))


_POINTS = ((1, 1.0, 2.0), (2, -3.0, 1.5), (3, 0.5, -2.8), (4, 2.2, 0.8))


def points(spark):
    return spark.createDataFrame(_POINTS, "id int, x double, y double")


@query(f"""WITH placed AS (SELECT flip, turn, floor(px * cos(radians(turn * 5.0e0)) - py * sin(radians(turn * 5.0e0)) + 4.0e0 + 1e-9)::INTEGER AS ix, floor(px * sin(radians(turn * 5.0e0)) + py * cos(radians(turn * 5.0e0)) + 4.0e0 + 1e-9)::INTEGER AS iy
    FROM (SELECT flip, turn, CASE WHEN flip = 1 THEN -x ELSE x END AS px, y AS py FROM (VALUES {', '.join(f'({x!r}::DOUBLE, {y!r}::DOUBLE)' for _, x, y in _POINTS)}) p(x, y), (SELECT unnest([0, 1])::INTEGER AS flip), (SELECT unnest(range(72))::INTEGER AS turn)))
    SELECT vol, iz, flip, turn, score FROM (SELECT *, row_number() OVER (PARTITION BY vol, iz ORDER BY score DESC, flip, turn) AS rank FROM (SELECT vol, iz, flip, turn, sum(coalesce(v, 0))::DOUBLE AS score FROM (SELECT DISTINCT vol, iz FROM v_vox) CROSS JOIN placed LEFT JOIN v_vox USING (vol, iz, ix, iy) GROUP BY ALL)) WHERE rank = 1""")
def pose_alignment(spark, sf_dir):
    """The best pose of a marker on every plane."""
    return im.best_pose(points(spark), views.voxels(spark, sf_dir), views.SIDE, 72, ["id"], "vol", "iz").filter("rank = 1").drop("rank")


_GRID = [(i, float(i % 4) * 10, float(i // 4) * 10) for i in range(12)]


@query(f"""WITH rod AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)' for i, x, y in _GRID)}) t(id, x, y)),
    mid AS (SELECT (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y FROM rod a, rod b WHERE a.id < b.id AND abs(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) - 10) <= 1e-6)
    SELECT vol, iz, round(peak, 6) AS peak, round(valley, 6) AS valley, round(peak / greatest(valley, 1e-12), 6) AS pvr FROM (SELECT vol, iz, avg(v) AS peak FROM rod JOIN v_vox ON ix = x::INTEGER // 5 AND iy = y::INTEGER // 5 GROUP BY ALL) JOIN (SELECT vol, iz, avg(v) AS valley FROM mid JOIN v_vox ON ix = x::INTEGER // 5 AND iy = y::INTEGER // 5 GROUP BY ALL) USING (vol, iz)""")
def pvr_midpoints(spark, sf_dir):
    """Peaks at a phantom's rods over the valleys between neighbours, on every plane."""
    rods = spark.createDataFrame(_GRID, "id int, x double, y double")
    v = views.voxels(spark, sf_dir)
    at = lambda df: v.join(F.broadcast(df.select(F.floor(F.round(F.col("x")) / 5).cast("int").alias("ix"), F.floor(F.round(F.col("y")) / 5).cast("int").alias("iy"))), ["ix", "iy"]).groupBy("vol", "iz").agg(F.avg("v").alias("m"))
    both = at(rods).withColumnRenamed("m", "peak").join(at(im.midpoints(rods, 10.0, 1e-6)).withColumnRenamed("m", "valley"), ["vol", "iz"])
    return both.select("vol", "iz", r6("peak").alias("peak"), r6("valley").alias("valley"), r6(F.col("peak") / F.greatest("valley", F.lit(1e-12))).alias("pvr"))


@query("""SELECT a.vol, a.ix, a.iy, a.iz, sum(a.v - b.v) AS v FROM v_vox a JOIN (SELECT vol, ix + dx AS ix, iy + dy AS iy, iz + dz AS iz, v FROM v_vox, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(dx, dy, dz)) b ON a.vol = b.vol AND a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz GROUP BY ALL""")
def laplacian_matvec(spark, sf_dir):
    return im.laplacian(views.voxels(spark, sf_dir), "vol")


@query("""SELECT vol, 'ix' AS axis, count(d)::BIGINT AS pairs, round(avg(d), 6) AS roughness FROM (SELECT vol, abs(v - lag(v) OVER (PARTITION BY vol, iy, iz ORDER BY ix)) AS d FROM v_vox) GROUP BY vol
    UNION ALL SELECT vol, 'iy', count(d), round(avg(d), 6) FROM (SELECT vol, abs(v - lag(v) OVER (PARTITION BY vol, ix, iz ORDER BY iy)) AS d FROM v_vox) GROUP BY vol""")
def roughness_by_axis(spark, sf_dir):
    return im.roughness(views.voxels(spark, sf_dir), "vol").withColumn("roughness", r6("roughness"))


@query("""SELECT vol AS iteration, round(avg((2 * ma * mb + 0.0529e0) * (2 * c + 0.4761e0) / ((ma * ma + mb * mb + 0.0529e0) * (va + vb + 0.4761e0))), 6) AS ssim FROM (SELECT vol, avg(v) AS ma, avg(w) AS mb, var_pop(v) AS va, var_pop(w) AS vb, covar_pop(v, w) AS c
    FROM (SELECT a.vol, a.ix, a.iy, a.iz, a.v, b.v AS w FROM v_vox a JOIN (SELECT ix, iy, iz, v FROM v_vox WHERE vol = 0) b USING (ix, iy, iz)) GROUP BY vol, ix // 4, iy // 4, iz // 4) GROUP BY vol""")
def ssim_blocks(spark, sf_dir):
    """Similarity by iteration: every volume, an iteration's image, against the first."""
    v = views.voxels(spark, sf_dir)
    truth = v.select("vol").distinct().join(F.broadcast(v.filter("vol = 0").drop("vol")))  # one volume's voxels for each iteration
    return im.ssim(v, truth, 4, 23.0, "vol").groupBy(F.col("vol").alias("iteration")).agg(r6(F.avg("ssim")).alias("ssim"))


_MIX = """mix AS (SELECT a.det_id AS a, b.det_id AS b, exp(-0.5e0 * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / 225.0e0) AS k FROM v_det a, v_det b),
    w AS (SELECT a, b, k / sum(k) OVER (PARTITION BY a) AS w FROM mix)"""


@query(f"WITH {_MIX}, m AS (SELECT a AS bin_id, pixel_id, sum(w * h) AS h FROM w JOIN v_sysmat ON bin_id = b GROUP BY ALL), t AS (SELECT (SELECT sum(h) FROM v_sysmat WHERE bin_id BETWEEN 1 AND 64) AS sa, (SELECT sum(h) FROM m) AS sb) SELECT bin_id::BIGINT AS bin_id, round(sum(s.h + 0.3e0 * sa / sb * m.h), 5) AS total FROM m JOIN v_sysmat s USING (bin_id, pixel_id), t GROUP BY bin_id")
def detector_gauss_mixing(spark, sf_dir):
    """A matrix plus its blurred self, scaled to 0.3 of its mass."""
    m = views.matrix(spark, sf_dir).filter(F.col("bin_id").between(1, 64)).select("bin_id", F.posexplode("h").alias("pixel_id", "h"))
    w = im.detector_mixing(views.detectors(spark), 15.0)
    blurred = m.join(F.broadcast(w.withColumnRenamed("b", "bin_id")), "bin_id").groupBy(F.col("a").cast("long").alias("bin_id"), "pixel_id").agg(F.sum(F.col("w") * F.col("h")).alias("g"))
    mass = m.agg(F.sum("h").alias("sa")).crossJoin(blurred.agg(F.sum("g").alias("sb")))  # one row
    return m.join(blurred, ["bin_id", "pixel_id"]).crossJoin(F.broadcast(mass)).groupBy("bin_id").agg(F.round(F.sum(F.col("h") + 0.3 * F.col("sa") / F.col("sb") * F.col("g")), 5).alias("total"))


@query("SELECT vol, iz, max(v) FILTER (ix BETWEEN 2 AND 5 AND iy BETWEEN 2 AND 5) AS cut_max, count(*) FILTER (v > 20)::BIGINT AS bright FROM v_vox GROUP BY vol, iz")
def display_maximum(spark, sf_dir):
    cut = F.col("ix").between(2, 5) & F.col("iy").between(2, 5)
    return views.voxels(spark, sf_dir).groupBy("vol", "iz").agg(F.max(F.when(cut, F.col("v"))).alias("cut_max"), F.sum((F.col("v") > 20).cast("long")).alias("bright"))
