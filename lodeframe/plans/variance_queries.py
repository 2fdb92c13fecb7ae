"""Queries on the Fisher matrix, contrast recovery and variance of all pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids
from ..operators import variance as vr
from . import views
from .catalogue import query

SHAPE, BETAS = (4, 4, 4), (1.0, 10.0, 100.0)
_FISHER = """p AS (SELECT bin_id, sum(h) AS p FROM v_sysmat GROUP BY bin_id), f AS (SELECT a.pixel_id AS i, b.pixel_id AS j, sum(a.h * b.h / p) AS v FROM v_sysmat a JOIN v_sysmat b USING (bin_id) JOIN p USING (bin_id) GROUP BY ALL)"""
_R = """xyz AS (SELECT i::INTEGER AS i, i % 4 AS x, i // 4 % 4 AS y, i // 16 AS z FROM range(64) t(i)), near AS (SELECT a.i, b.i AS j FROM xyz a JOIN xyz b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
    r AS (SELECT i, j, -1.0e0 AS w FROM near UNION ALL SELECT i, i, count(*)::DOUBLE FROM near GROUP BY i)"""
_STUDY = f"""WITH RECURSIVE {{views}}{_FISHER}, {_R}, beta AS (SELECT unnest({list(BETAS)!r})::DOUBLE AS beta),
    a AS (SELECT beta, f.i, f.j, v + beta * coalesce(w, 0) AS v FROM f CROSS JOIN beta LEFT JOIN r ON f.i = r.i AND f.j = r.j),
    line AS (SELECT beta, i, list_concat(list(v ORDER BY j), list_transform(range(64), lambda c: CASE WHEN c = i THEN 1.0e0 ELSE 0.0e0 END)) AS line FROM a GROUP BY beta, i),
    g AS (SELECT beta, 0 AS k, list(line ORDER BY i) AS m FROM line GROUP BY beta UNION ALL
        SELECT beta, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(row, lambda x, j: x - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM g WHERE k < 64),
    rows AS (SELECT beta, unnest(range(64))::INTEGER AS i, unnest(m) AS line FROM g WHERE k = 64),
    x AS (SELECT beta, i, unnest(range(64))::INTEGER AS j, unnest(line[65:]) AS x FROM rows),
    fx AS (SELECT beta, f.i, x.j, sum(f.v * x.x) AS fx FROM f JOIN x ON f.j = x.i GROUP BY ALL),
    s AS (SELECT beta, j AS pixel_id, sum(fx) FILTER (i = j) AS contrast, sum(x * fx) AS variance FROM x JOIN fx USING (beta, i, j) GROUP BY beta, j)"""


@query(f"WITH {_FISHER} SELECT i, j, round(v, 6) AS v FROM f")
def fisher_matrix(spark, sf_dir):
    """All numbers of F, from tiles of 24 pixels."""
    return vr.entries(vr.fisher_tiles(views.matrix(spark, sf_dir), 64, 24), 64, 24).withColumn("v", F.round("v", 6))


def _with_views(body: str) -> str:
    return _STUDY.replace("{views}", f"v_sysmat AS ({views.SQL['v_sysmat']}), ") + body


@query(_with_views(" SELECT beta, pixel_id, round(contrast, 6) AS contrast, round(variance, 6) AS variance FROM s"), whole=True)
def contrast_variance_study(spark, sf_dir):
    """All pixels and betas in one block of conjugate gradients, with a penalty in three dimensions."""
    out = vr.contrast_variance(views.matrix(spark, sf_dir), SHAPE, list(BETAS), tolerance=1e-11)
    return out.select("beta", "pixel_id", *[F.round(c, 6).alias(c) for c in ("contrast", "variance")])


@query(_with_views(" SELECT beta, round(avg(contrast), 6) AS contrast, round(avg(variance), 6) AS variance FROM s WHERE pixel_id IN (SELECT i FROM xyz WHERE x IN (1, 2) AND y IN (1, 2) AND z IN (1, 2)) GROUP BY beta"), whole=True)
def contrast_variance_direct(spark, sf_dir):
    """The curve over the sample points around the centre, by the factored matrix in tiles of 24 pixels."""
    weights = grids.sample_weights(spark, SHAPE, (1.0, 1.0, 1.0), (2, 2, 2), 1.0).select(F.col("index").cast("int").alias("pixel_id"), "weight")
    chosen = sorted(r["pixel_id"] for r in weights.collect())  # eight sample pixels
    out = vr.curve(vr.direct_contrast_variance(views.matrix(spark, sf_dir), SHAPE, list(BETAS), 24, chosen), weights)
    return out.select("beta", *[F.round(c, 6).alias(c) for c in ("contrast", "variance")])
