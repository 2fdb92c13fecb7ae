"""Queries on responses, the older kernel, matrix and volume tools."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import energy, geometry
from ..operators import cells
from ..operators import response as rs
from . import event_queries as eq
from . import recon_queries, views
from .catalogue import query


def r6(c):
    return F.round(c, 6)


def _erf(x: str) -> str:
    t = f"(1 / (1 + {rs.ERF_P!r}::DOUBLE * abs({x})))"
    poly = "0.0e0"
    for c in reversed(rs.ERF):
        poly = f"(({poly} + {c!r}::DOUBLE) * {t})"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


_S = 0.03 * math.sqrt(2)


@query(f"SELECT view, bin::INTEGER AS bin, round(sum(({_erf(f'(0.05e0 * (bin + 1) - e1) / {_S!r}::DOUBLE')} - {_erf(f'(0.05e0 * bin - e1) / {_S!r}::DOUBLE')}) / 2), 5) AS mass FROM v_event, range(8) t(bin) GROUP BY ALL")
def energy_bin_mass(spark, sf_dir):
    bins = F.broadcast(spark.range(8).select(F.col("id").cast("int").alias("bin")))  # eight rows
    mass = rs.bin_mass(F.col("e1"), 0.03, 0.05 * F.col("bin"), 0.05 * (F.col("bin") + 1))
    return views.events(spark, sf_dir).crossJoin(bins).groupBy("view", "bin").agg(F.round(F.sum(mass), 5).alias("mass"))


_C = eq._cos("e1")
_ER = f"(e1 * {eq.RES!r}::DOUBLE / 2.355e0 * sqrt(0.511e0 / e1))"


@query(f"""WITH {eq._LOC}, g AS (SELECT *, {_C} AS c, acos({_C}) AS theta, {_ER} AS er, sqrt(x1 * x1 + y1 * y1 + z1 * z1) AS da, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)) AS db,
    x1 * (x2 - x1) + y1 * (y2 - y1) + z1 * (z2 - z1) AS ab FROM loc WHERE {eq._WINDOW.format('>')} AND {_C} > -1 + 1e-6 AND {_C} < 1 - 1e-6 AND abs(y1 - y2) > 0.1e0),
    b AS (SELECT *, acos(greatest(least(ab / greatest(da * db, 1e-7), 1 - 1e-7), -1 + 1e-7)) AS beta, sqrt(1 - c * c) AS s, 0.511e0 - e1 AS rest FROM g),
    k AS (SELECT *, abs(0.511e0 / (s * rest * rest) * er + CASE WHEN beta >= theta THEN 0.5e0 ELSE -0.5e0 END * 0.511e0 / (s * rest * rest * rest) * (2 - c / (s * s) * 0.511e0 / rest) * er * er) AS se,
    atan(1.5e0 / da) * sqrt(1 + da / db * da / db * (1 + 2.25e0) + 2 * da / db * c) AS sp FROM b)
    SELECT event_id, round(exp(-(beta - theta) * (beta - theta) / (2 * (se * se + sp * sp))) * (0.511e0 / rest + rest / 0.511e0 - sin(beta) * sin(beta)), 6) AS weight FROM k""")
def older_kernel_at_centre(spark, sf_dir):
    e = eq.located(spark, sf_dir).filter(energy.is_kinematic(F.col("e1"), views.E0)).filter(F.abs(F.col("y1") - F.col("y2")) > 0.1)
    a, b = tuple(F.col(f"{c}1") for c in "xyz"), tuple(F.col(f"{c}2") for c in "xyz")
    leg = geometry.minus(b, a)
    weight = rs.older_kernel(F.col("e1"), views.E0, eq.RES, geometry.norm(a), geometry.norm(leg), geometry.angle(a, leg), 1.5, 1.0)
    return e.select("event_id", r6(weight).alias("weight"))


_SEGMENT = "seg AS (SELECT event_id, cp1 AS a, cp2 AS b, f.x + event_id % 7 - 3 AS sx, f.y AS sy, f.z + event_id % 5 - 2 AS sz, r.x AS ex, r.y AS ey, r.z + event_id % 3 - 1 AS ez FROM v_event JOIN v_det f ON f.det_id = cp1 JOIN v_det r ON r.det_id = cp2)"


def segments(spark, sf_dir):
    """From each event's first hit to its second, places within the crystals told apart by the event."""
    d, id = views.detectors(spark), F.col("event_id")
    e = views.events(spark, sf_dir).select("event_id", F.col("cp1").alias("a"), F.col("cp2").alias("b"))
    s = d.select(F.col("det_id").alias("a"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    t = d.select(F.col("det_id").alias("b"), *[F.col(c).alias(f"e{c}") for c in "xyz"])
    e = e.join(F.broadcast(s), "a").join(F.broadcast(t), "b")
    return e.withColumns({"sx": F.col("sx") + id % 7 - 3, "sz": F.col("sz") + id % 5 - 2, "ez": F.col("ez") + id % 3 - 1})


@query(f"""WITH {_SEGMENT}, m AS (SELECT event_id, x, y, z, sx, sy, sz, ex - sx AS wx, ey - sy AS wy, ez - sz AS wz, ((ex - sx) * (x - sx) + (ey - sy) * (y - sy) + (ez - sz) * (z - sz)) / greatest((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz), 1e-12) AS t FROM seg, v_det WHERE det_id <> a AND det_id <> b)
    SELECT event_id, count(*)::BIGINT AS n FROM m WHERE t > 0 AND t < 1 AND sqrt(power(x - sx - t * wx, 2) + power(y - sy - t * wy, 2) + power(z - sz - t * wz, 2)) <= 5 GROUP BY event_id""")
def blocker_candidates(spark, sf_dir):
    """How many other crystals stand in each event's way; segments and crystals meet by cells of space."""
    return cells.blockers(segments(spark, sf_dir), views.detectors(spark), 5.0).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


def crystals(spark):
    """The detectors with their crystals' sizes: thin in front, thick behind."""
    deep = F.when(F.col("layer") < 4, 6.0).otherwise(10.0)
    return views.detectors(spark).select("det_id", "layer", "x", "y", "z", F.lit(10.0).alias("sx"), deep.alias("sy"), F.lit(10.0).alias("sz"))


def sections(spark):
    from ..operators import simulate

    t = simulate.last_wins(views.cross_sections(spark), "energy", "line_no")
    return t.select("energy", *[(F.col(c) * energy.NAI_DENSITY).alias(c) for c in ("total", "incoherent")])


_TOTAL0, _PART0 = (f"{[r[k] for r in views.CROSS_SECTIONS if r[0] == views.E0][-1] * energy.NAI_DENSITY!r}::DOUBLE" for k in (3, 1))
_LEAVES = {c: f"least(1, CASE WHEN abs(e{c} - s{c}) < 1e-12 THEN 1 ELSE greatest((x{c} - h{c} - s{c}) / (e{c} - s{c}), (x{c} + h{c} - s{c}) / (e{c} - s{c})) END)" for c in "xyz"}
_ENTERS = {c: f"greatest(0, CASE WHEN abs(e{c} - s{c}) < 1e-12 THEN 0 ELSE least((x{c} - h{c} - s{c}) / (e{c} - s{c}), (x{c} + h{c} - s{c}) / (e{c} - s{c})) END)" for c in "xyz"}
_MISSES = " OR ".join(f"(abs(e{c} - s{c}) < 1e-12 AND abs(s{c} - x{c}) > h{c})" for c in "xyz")
_IN_BOX = f"CASE WHEN {_MISSES} THEN 0 ELSE greatest(least({', '.join(_LEAVES.values())}) - greatest({', '.join(_ENTERS.values())}), 0) * sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz)) END"
_OUT = ", ".join(f"CASE WHEN abs(o{c}) >= 1e-12 THEN (x{c} + sign(o{c}) * h{c} - s{c}) / o{c} END" for c in "xyz")
_BLUR = f"greatest(d * {eq.RES / energy.FWHM!r}::DOUBLE * sqrt(0.511e0 / greatest(d, 1e-6)), 1e-6)"
_TENSOR = f"""WITH c AS (SELECT det_id, layer, x, y, z, 10.0e0 AS wide, CASE WHEN layer < 4 THEN 6.0e0 ELSE 10.0e0 END AS deep FROM v_det),
    box AS (SELECT det_id AS box, x AS xx, y AS xy, z AS xz, 5.0e0 AS hx, deep / 2 AS hy, 5.0e0 AS hz FROM c),
    cell AS (SELECT det_id, layer, j, x, y + ((j + 0.5e0) / 2 - 0.5e0) * deep AS y, z, j * deep / 2 AS depth, deep / 2 AS thick, deep FROM c, range(2) t(j)),
    src AS (SELECT s_suppkey AS voxel, (s_suppkey % 9 - 4) * 4.0e0 AS x, (s_suppkey % 11 - 5) * 2.0e0 AS y, (s_suppkey % 7 - 3) * 4.0e0 AS z FROM supplier),
    leg AS (SELECT voxel, p.x AS sx, p.y AS sy, p.z AS sz, det_id, j, c.x AS ex, c.y AS ey, c.z AS ez, depth, thick FROM src p, cell c),
    shut1 AS (SELECT voxel, det_id, j, sum({_IN_BOX}) AS blocked FROM leg JOIN box ON box <> det_id GROUP BY ALL),
    way1 AS (SELECT *, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz)) AS n1 FROM leg JOIN shut1 USING (voxel, det_id, j)),
    hit1 AS (SELECT voxel, det_id, j, (ex - sx) / n1 AS ux, (ey - sy) / n1 AS uy, (ez - sz) / n1 AS uz, 100 * c1 / (4 * 3.141592653589793e0 * n1 * n1) * exp(-{_TOTAL0} * depth / c1 / 10) * (1 - exp(-{_TOTAL0} * thick / c1 / 10)) * {_PART0} / {_TOTAL0} * exp(-{_TOTAL0} * blocked / 10) AS scatter
        FROM (SELECT *, (ey - sy) / n1 AS c1 FROM way1) WHERE c1 > 0),
    pair AS (SELECT a.det_id, a.j, b.det_id AS other, b.j AS k, a.layer < 4 AS ahead, a.x AS sx, a.y AS sy, a.z AS sz, b.x AS ex, b.y AS ey, b.z AS ez, b.depth, b.thick, b.deep FROM cell a, cell b WHERE (a.layer < 4) <> (b.layer < 4)),
    shut2 AS (SELECT det_id, j, other, k, sum({_IN_BOX}) AS blocked FROM pair JOIN box ON box <> det_id AND box <> other GROUP BY ALL),
    way2 AS (SELECT *, (ex - sx) / n2 AS ox, (ey - sy) / n2 AS oy, (ez - sz) / n2 AS oz FROM (SELECT *, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy) + (ez - sz) * (ez - sz)) AS n2 FROM pair JOIN shut2 USING (det_id, j, other, k))),
    hit2 AS (SELECT det_id, j, other, ahead, ox, oy, oz, 100 * abs(oy) / (n2 * n2) AS seen, (greatest(least({_OUT}), 0) + blocked + CASE WHEN oy >= 0 THEN depth ELSE deep - depth - thick END / abs(oy)) / 10 AS way_cm, thick / abs(oy) / 10 AS stop_cm FROM way2 JOIN box ON box = det_id),
    both_hits AS (SELECT *, greatest(least(ux * ox + uy * oy + uz * oz, 1), -1) AS mu FROM hit1 JOIN hit2 USING (det_id, j)),
    spent AS (SELECT *, 1 / (1 + (1 - mu)) AS ratio, 0.511e0 / (1 + (1 - mu)) AS rest, 0.511e0 - 0.511e0 / (1 + (1 - mu)) AS d FROM both_hits),
    xs AS (SELECT energy, max_by(total, line_no) * {energy.NAI_DENSITY!r}::DOUBLE AS total FROM v_xs GROUP BY energy), br AS (SELECT energy AS lo, lead(energy) OVER (ORDER BY energy) AS hi, total AS m, lead(total) OVER (ORDER BY energy) AS m2 FROM xs),
    total AS (SELECT *, m + (rest - lo) / (hi - lo) * (m2 - m) AS att FROM spent ASOF JOIN br ON spent.rest >= br.lo),
    base AS (SELECT ahead, voxel, det_id, d, scatter * ratio * ratio * (ratio + 1 / ratio - (1 - mu * mu)) / {rs.density_norm(views.E0)!r}::DOUBLE * seen * exp(-att * way_cm) * (1 - exp(-att * stop_cm)) AS w, {_BLUR} AS blur FROM total)
    SELECT ahead AS front_first, voxel, det_id AS first, bin::INTEGER AS e1_bin, round(1e9 * sum(w * exp(-0.5e0 * power((0.05e0 * bin + 0.075e0 - d) / blur, 2)) * {0.05 / math.sqrt(2 * math.pi)!r}::DOUBLE / blur), 5) AS w FROM base, range(6) t(bin) GROUP BY ALL"""


@query(f"""WITH {_SEGMENT}, box AS (SELECT det_id AS box, x AS xx, y AS xy, z AS xz, 5.0e0 AS hx, CASE WHEN layer < 4 THEN 3.0e0 ELSE 5.0e0 END AS hy, 5.0e0 AS hz FROM v_det)
    SELECT event_id, round(coalesce(sum({_IN_BOX}), 0), 6) AS blocked FROM seg LEFT JOIN box ON box <> a AND box <> b GROUP BY event_id""")
def segment_box_length(spark, sf_dir):
    """What of each event's way lies in other crystals."""
    return cells.blocked_length(segments(spark, sf_dir), crystals(spark), ["event_id"], ["a", "b"]).select("event_id", r6("blocked").alias("blocked"))


@query(_TENSOR)
def response_tensor(spark, sf_dir):
    """Responses of all suppliers' places to all pairs of a front and a rear crystal, in both orders, in two cells each, summed over the second crystal."""
    key = F.col("s_suppkey")
    c, voxel = crystals(spark), views.read(spark, sf_dir, "supplier").select(key.alias("voxel"), ((key % 9 - 4) * 4.0).alias("x"), ((key % 11 - 5) * 2.0).alias("y"), ((key % 7 - 3) * 4.0).alias("z"))
    front, rear = (rs.integration_cells(c.filter(f), 1, 2, 1) for f in ("layer < 4", "layer = 4"))

    def sums(places):
        out, voxel = None, places.select(F.struct("x", "y", "z").alias("voxel"), "x", "y", "z")
        for ahead, one, two in ((True, front, rear), (False, rear, front)):
            w = rs.response(voxel, one, two, c, sections(spark), views.E0, [0.05 * i for i in range(1, 8)], eq.RES)
            w = w.groupBy("voxel", "first", "e1_bin").agg(F.round(1e9 * F.sum("w"), 5).alias("w")).withColumn("front_first", F.lit(ahead))
            out = w if out is None else out.unionByName(w)
        return out.select("voxel.*", "first", "e1_bin", "w", "front_first")

    return rs.by_place(voxel, ["x", "y", "z"], sums).drop("x", "y", "z")


@query("SELECT count(h)::BIGINT AS finite, count(*) FILTER (h = 0)::BIGINT AS zeros, round(min(h), 6) AS min, round(max(h), 6) AS max, round(avg(h), 6) AS mean, round(sum(h), 4) AS sum FROM v_sysmat")
def tensor_statistics(spark, sf_dir):
    out = rs.tensor_stats(recon_queries.long_matrix(spark, sf_dir), "h")
    return out.select("finite", "zeros", *[r6(c).alias(c) for c in ("min", "max", "mean")], F.round("sum", 4).alias("sum"))


@query("WITH t AS (SELECT *, CASE WHEN v > 10 THEN v * 3 ELSE 0 END AS t FROM v_vox), m AS (SELECT vol, avg(t) FILTER (t > 0) AS b, avg(v) FILTER (t > 0) AS a FROM t GROUP BY vol) SELECT vol, ix, iy, iz, round(v * b / a, 6) AS v FROM t JOIN m USING (vol)")
def mean_matching(spark, sf_dir):
    v, keys = views.voxels(spark, sf_dir), ["vol", "ix", "iy", "iz"]
    truth = v.select(*keys, F.when(F.col("v") > 10, F.col("v") * 3).otherwise(0.0).alias("v"))
    return rs.mean_matched(v, truth, keys, "vol").withColumn("v", r6("v"))


@query("SELECT pixel_id, round(a / b, 6) AS v FROM (SELECT pixel_id, sum(h) FILTER (bin_id % 2 = 0) AS a, sum(h) FILTER (bin_id % 2 = 1) AS b FROM v_sysmat GROUP BY pixel_id)")
def sensitivity_ratio(spark, sf_dir):
    m = recon_queries.long_matrix(spark, sf_dir)
    half = lambda k: m.filter(F.col("bin_id") % 2 == k).groupBy("pixel_id").agg(F.sum("h").alias("v"))
    return rs.ratio_map(half(0), half(1), "pixel_id").withColumn("v", r6("v"))


@query("SELECT pixel_id, round(sum(h * e1), 6) AS w FROM v_event JOIN v_sysmat ON cp1 = bin_id GROUP BY pixel_id")
def grouped_back_projection(spark, sf_dir):
    e = views.events(spark, sf_dir).select(F.col("cp1").cast("long").alias("bin_id"), F.col("e1").alias("r"))
    return rs.grouped_back(e, recon_queries.long_matrix(spark, sf_dir)).select("pixel_id", r6("w").alias("w"))


@query("WITH f AS (SELECT vol, ix, 7 - iy AS iy, iz, v FROM v_vox) SELECT vol, 'ix' AS axis, iy AS i, iz AS j, v FROM f WHERE ix = 3 UNION ALL SELECT vol, 'iy', ix, iz, v FROM f WHERE iy = 5 UNION ALL SELECT vol, 'iz', ix, iy, v FROM f WHERE iz = 2")
def three_slices(spark, sf_dir):
    """Slices of volumes whose second axis runs the other way."""
    return rs.slices(views.voxels(spark, sf_dir), (3, 5, 2), "vol", flipped={"iy": views.SIDE})


_G = math.exp(-0.5)


@query(f"SELECT vol, ix, iy, iz, round((v + {_G!r}::DOUBLE * (coalesce(lag(v) OVER w, 0) + coalesce(lead(v) OVER w, 0))) / (1 + {_G!r}::DOUBLE * ((lag(v) OVER w IS NOT NULL)::INTEGER + (lead(v) OVER w IS NOT NULL)::INTEGER)), 6) AS v FROM v_vox WINDOW w AS (PARTITION BY vol, ix, iy ORDER BY iz)")
def smoothing_along_z(spark, sf_dir):
    return rs.smoothed(views.voxels(spark, sf_dir), 1.0, 1, "vol", "ix", "iy").select("vol", "ix", "iy", "iz", r6("v").alias("v"))


@query("SELECT count(*)::BIGINT AS bins, round(sum(h), 4) AS mass FROM v_sysmat WHERE bin_id IN (SELECT vec_id FROM embeddings WHERE label % 3 = 1)")
def crystal_selection(spark, sf_dir):
    """Only rows of bins whose crystal's value is 1 stay."""
    one = views.read(spark, sf_dir, "embeddings").filter("label % 3 = 1").select(F.col("vec_id").alias("bin_id"))
    kept = recon_queries.long_matrix(spark, sf_dir).join(one, "bin_id", "left_semi")
    return kept.agg(F.count(F.lit(1)).alias("bins"), F.round(F.sum("h"), 4).alias("mass"))
