"""Tables of the domain, derived from the driver's tables by plain arithmetic, for Spark and (as SQL) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

E0 = 0.511
RINGS = (8, 16, 40)
RADII = (6.0, 12.0, 18.0)
VIEWS = 8
PIXELS = sum(RINGS)
DETECTORS = 64
# Cross sections of NaI by energy in MeV (incoherent, photoelectric, total, cm^2/g); the K edge occurs twice.
CROSS_SECTIONS = (
    (0.01, 0.06731, 137.5, 137.6),
    (0.015, 0.0841, 45.7, 45.78),
    (0.02, 0.09463, 20.62, 20.71),
    (0.03, 0.1067, 6.607, 6.714),
    (0.03317, 0.109, 4.972, 5.081),
    (0.03317, 0.109, 29.76, 29.87),
    (0.04, 0.1127, 18.24, 18.35),
    (0.05, 0.1157, 10.06, 10.18),
    (0.06, 0.1169, 6.111, 6.228),
    (0.08, 0.1165, 2.746, 2.863),
    (0.1, 0.1144, 1.462, 1.576),
    (0.15, 0.1071, 0.4592, 0.5663),
    (0.2, 0.1, 0.2019, 0.302),
    (0.3, 0.0886, 0.06481, 0.1534),
    (0.4, 0.08009, 0.02987, 0.11),
    (0.5, 0.07351, 0.01684, 0.09035),
    (0.511, 0.07287, 0.01595, 0.08883),
    (0.6, 0.06822, 0.01079, 0.07901),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List-mode events: event_id, view, cp1, e1, cp2, e2."""
    id, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    e1 = F.lit(0.0036) * (k + 1)
    return read(spark, sf_dir, "events").select(
        "event_id",
        (id % 20 + 1).cast("int").alias("view"),
        (user % 64 + 1).cast("int").alias("cp1"),
        e1.alias("e1"),
        ((user * 7 + id) % 64 + 1).cast("int").alias("cp2"),
        (F.lit(E0) - e1 + F.lit(0.005) * (id % 41 - 20)).alias("e2"),
    )


def detectors(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """64 detectors in 4 layers: det_id, layer, x, y, z. A dimension of fixed size."""
    i = F.col("id")
    return spark.range(64).select(
        (i + 1).cast("int").alias("det_id"),
        (i % 4 + 1).cast("int").alias("layer"),
        ((F.floor(i / 4) % 4 - 1.5) * 12).alias("x"),
        (100 + 20.0 * (i % 4 + 1)).alias("y"),
        ((F.floor(i / 16) - 1.5) * 12).alias("z"),
    )


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System matrix, a row a bin: bin_id and h, an array over the 64 pixels."""
    h = F.transform("embedding", lambda v: F.abs(v.cast("double")) + 1e-3)
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("bin_id"), h.alias("h"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection counts: bin_id and y."""
    v = read(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("bin_id"), (F.col("label") * 7 + F.col("vec_id") % 13 + 1).cast("double").alias("y"))


def pixels(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    """Polar grid: pixel_id (from 0), ring_id, theta_id, n (pixels of the ring), base, x, y, z."""
    rows, base = [], 0
    for ring, (n, _) in enumerate(zip(RINGS, RADII, strict=True)):
        rows += [(base + t, ring, t, n, base) for t in range(n)]
        base += n
    p = spark.createDataFrame(rows, "pixel_id int, ring_id int, theta_id int, n int, base int")
    turn = 2 * 3.141592653589793 * F.col("theta_id") / F.col("n")
    radius = 6.0 * (F.col("ring_id") + 1)
    return p.select("*", (radius * F.cos(turn)).alias("x"), (radius * F.sin(turn)).alias("y"), F.lit(0.0).alias("z"))


def cross_sections(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(CROSS_SECTIONS)]
    return spark.createDataFrame(rows, "line_no int, energy double, incoherent double, photo double, total double")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth (0/1), p: a score in (0, 1) made of the text's length."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    p = (F.col("n_chars") % 1000 + 0.5) / 1000.0
    return l.join(d.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("truth"), p.alias("p"))


SIDE = 8


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of 8 planes of 8 by 8 voxels, a plane an embedding: vol, ix, iy, iz (from 0) and v, a whole number from 1 to 23."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    v = F.floor(F.abs(F.col("e").cast("double")) * 1000) % 23 + 1
    at = lambda c, name: c.cast("int").alias(name)
    return e.select(F.floor(F.col("vec_id") / SIDE).alias("vol"), at(F.col("i") % SIDE, "ix"), at(F.floor(F.col("i") / SIDE), "iy"), at(F.col("vec_id") % SIDE, "iz"), v.cast("double").alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images on the polar grid, one an embedding: vec_id, pixel_id and v, a whole number from 1 to 101."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pixel_id", "e"))
    return e.select("vec_id", "pixel_id", (F.floor(F.abs(F.col("e").cast("double")) * 10000) % 101 + 1).cast("double").alias("v"))


_XS = ", ".join(f"({i}, {', '.join(f'{x!r}::DOUBLE' for x in r)})" for i, r in enumerate(CROSS_SECTIONS))
_RINGS = " UNION ALL ".join(f"SELECT {sum(RINGS[:i])} AS base, {i} AS ring_id, {n} AS n, unnest(range({n}))::INTEGER AS theta_id" for i, n in enumerate(RINGS))
#: The same tables as DuckDB SQL.
SQL = {
    "v_event": """SELECT event_id, (event_id % 20 + 1)::INTEGER AS view, (user_id % 64 + 1)::INTEGER AS cp1, 0.0036e0 * (k + 1) AS e1,
        ((user_id * 7 + event_id) % 64 + 1)::INTEGER AS cp2, 0.511e0 - 0.0036e0 * (k + 1) + 0.005e0 * (event_id % 41 - 20) AS e2
        FROM (SELECT *, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::INTEGER AS k FROM events)""",
    "v_det": """SELECT (i + 1)::INTEGER AS det_id, (i % 4 + 1)::INTEGER AS layer, (i // 4 % 4 - 1.5e0) * 12 AS x, 100 + 20.0e0 * (i % 4 + 1) AS y, (i // 16 - 1.5e0) * 12 AS z
        FROM range(64) t(i)""",
    "v_sysmat": """SELECT vec_id AS bin_id, (unnest(range(64)))::INTEGER AS pixel_id, abs((unnest(embedding))::DOUBLE) + 1e-3 AS h FROM embeddings""",
    "v_cnt": """SELECT vec_id AS bin_id, (label * 7 + vec_id % 13 + 1)::DOUBLE AS y FROM embeddings""",
    "v_pix": f"""SELECT (base + theta_id)::INTEGER AS pixel_id, ring_id, theta_id, n, base, 6.0e0 * (ring_id + 1) * cos(2 * 3.141592653589793e0 * theta_id / n) AS x,
        6.0e0 * (ring_id + 1) * sin(2 * 3.141592653589793e0 * theta_id / n) AS y, 0.0e0 AS z FROM ({_RINGS})""",
    "v_xs": f"SELECT * FROM (VALUES {_XS}) t(line_no, energy, incoherent, photo, total)",
    "v_pred": "SELECT l.doc_id, quality AS truth, (n_chars % 1000 + 0.5e0) / 1000.0e0 AS p FROM labels l JOIN documents d USING (doc_id)",
    "v_vox": """SELECT vec_id // 8 AS vol, (i % 8)::INTEGER AS ix, (i // 8)::INTEGER AS iy, (vec_id % 8)::INTEGER AS iz, (floor(abs(e::DOUBLE) * 1000) % 23 + 1)::DOUBLE AS v
        FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS e FROM embeddings)""",
    "v_img": """SELECT vec_id, i::INTEGER AS pixel_id, (floor(abs(e::DOUBLE) * 10000) % 101 + 1)::DOUBLE AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS e FROM embeddings)""",
}


def with_views(sql: str) -> str:
    """``sql`` after the views that it names; views that it defines itself go after them."""
    import re

    used = [f"{name} AS ({body})" for name, body in SQL.items() if re.search(rf"\b{name}\b", sql)]
    if sql.lstrip().upper().startswith("WITH "):
        own = sql.lstrip()[5:]
        return "WITH " + ", ".join([*used, own]) if used else sql
    return ("WITH " + ", ".join(used) + " " if used else "") + sql


