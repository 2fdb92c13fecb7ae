"""Source macros: text of one command a line, in which ``source/add`` starts a source, and a file a view of a turned phantom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry

PREFIX = "/gps/"
#: Sizes that a shape's text names.
SIZES = {"Cylinder": ("radius", "halfz"), "Sphere": ("radius",), "Box": ("halfx", "halfy", "halfz")}
ALL_SIZES = ("radius", "halfx", "halfy", "halfz")


def text(sources: DataFrame) -> DataFrame:
    """file, line_no, line of sources (file, n, weight, shape, x, y, z, radius); the last line of a file runs it."""
    num = lambda c: F.col(c).cast("string")
    lines = F.array(
        F.concat(F.lit("/gps/source/add "), num("weight")),
        F.concat(F.lit("/gps/pos/shape "), F.col("shape")),
        F.concat(F.lit("/gps/pos/centre "), num("x"), F.lit(" "), num("y"), F.lit(" "), num("z"), F.lit(" mm")),
        F.concat(F.lit("/gps/pos/radius "), num("radius"), F.lit(" mm")),
    )
    return sources.select("file", F.posexplode(lines).alias("k", "line"), "n").select("file", (F.col("n") * 10 + F.col("k")).alias("line_no"), "line")


def turned(sources: DataFrame, views: int, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``sources`` once for each view (from 0), turned back by it around the origin and then moved to a centre."""
    view = F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view")
    x, y = geometry.rotate(F.col("x"), F.col("y"), F.col("view") * (-360.0 / views))
    out = sources.select("*", view)
    return out.withColumns({"x": x + centre[0], "y": y + centre[1]})


def run_text(sources: DataFrame, energy_kev: int, events: int, *run: str) -> DataFrame:
    """``run``, line_no and line of whole runs: particle, energy, volume, shape with its own sizes, directions and weight of each source (n from 1, weight, shape, x, y, z and sizes, null where the shape has none), and the command that starts the run. The first source has no weight of its own."""
    fixed = lambda c, d: F.format_string(f"%.{d}f", F.col(c).cast("double"))
    said = lambda name, *parts: F.concat(F.lit(f"/gps/{name} "), *parts)
    size = lambda c: F.when(F.col(c).isNotNull() & _has(c), said(f"pos/{c}", fixed(c, 4), F.lit(" mm")))
    lines = F.array(
        F.when(F.col("n") > 1, said("source/add", fixed("weight", 8))),
        F.lit("/gps/particle gamma"),
        F.lit(f"/gps/energy {energy_kev} keV"),
        F.lit("/gps/pos/type Volume"),
        said("pos/shape", F.col("shape")),
        *[size(c) for c in ALL_SIZES],
        said("pos/centre", fixed("x", 4), F.lit(" "), fixed("y", 4), F.lit(" "), fixed("z", 4), F.lit(" mm")),
        F.lit("/gps/ang/type iso"),
        F.lit("/gps/ang/mintheta 0.0000 deg"),
        F.lit("/gps/ang/maxtheta 180.0000 deg"),
        F.lit("#"),
    )
    own = sources.select(*run, "n", F.posexplode(lines).alias("k", "line")).filter(F.col("line").isNotNull()).select(*run, (F.col("n") * 20 + F.col("k")).cast("long").alias("line_no"), "line")
    last = sources.groupBy(*run).agg((F.max("n") * 20 + 20).cast("long").alias("line_no")).select(*run, "line_no", F.lit(f"/run/beamOn {events}").alias("line"))
    return own.unionByName(last)


def _has(size: str) -> Column:
    return F.col("shape").isin([s for s, sizes in SIZES.items() if size in sizes])


def write(lines: DataFrame, path: str, *run: str) -> None:
    """A text file for each run, its lines in order; a run's lines are a phantom's, and files spread over tasks."""
    lines.repartition(*run).sortWithinPartitions(*run, "line_no").select(*run, F.col("line").alias("value")).write.mode("overwrite").partitionBy(*run).text(path)


def parse(lines: DataFrame) -> DataFrame:
    """file, n (from 1 in each file), weight, shape, x, y, z and radius of each source."""
    return parsed(lines, "file").select("file", "n", "weight", "shape", "x", "y", "z", "radius")


def parsed(lines: DataFrame, *run: str) -> DataFrame:
    """``run``, n, weight (1 for a first source without one), shape, x, y, z and all sizes of each source of a run's lines."""
    w = Window.partitionBy(*run).orderBy("line_no")
    command = F.regexp_extract("line", r"^/gps/([a-z/A-Z]+)\s+(.*)$", 1)
    value = F.regexp_extract("line", r"^/gps/([a-z/A-Z]+)\s+(.*)$", 2)
    rows = lines.filter(F.col("line").startswith(PREFIX)).select(*run, "line_no", command.alias("c"), value.alias("v"))
    adds = F.sum((F.col("c") == "source/add").cast("int")).over(w)
    own = Window.partitionBy(*run)
    begun = lambda c: F.coalesce(F.min(F.when(c, F.col("line_no"))).over(own), F.lit(1 << 60))
    bare = begun(F.col("c") == "pos/shape") < begun(F.col("c") == "source/add")  # a run's first source may have no weight
    rows = rows.withColumn("n", (adds + bare.cast("int")).cast("int")).filter("n > 0")
    get = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    got = rows.groupBy(*run, "n").agg(get("source/add").alias("weight"), get("pos/shape").alias("shape"), F.split(get("pos/centre"), r"\s+").alias("p"), *[get(f"pos/{c}").alias(c) for c in ALL_SIZES])
    number = lambda c: c.try_cast("double")
    first = lambda c: number(F.get(F.split(c, r"\s+"), F.lit(0))).alias(c)
    weight = F.when(F.col("weight").isNull(), 1.0).otherwise(number(F.col("weight")))
    return got.select(*run, "n", weight.alias("weight"), "shape", *[number(F.get("p", F.lit(i))).alias(c) for i, c in enumerate("xyz")], *[first(c) for c in ALL_SIZES])


def contrast_rods(spark, diameters: list[float], body: float, height: float, ratio: float) -> DataFrame:
    """Sources of a cylinder with rods of these diameters around its middle, each so much more active by volume: the body first."""
    import math

    rows = [(1, 1.0, "Cylinder", 0.0, 0.0, 0.0, body / 2, height / 2)]
    for i, d in enumerate(diameters):
        turn = 2 * math.pi * i / len(diameters)
        rows.append((i + 2, (ratio - 1) * d * d / (body * body), "Cylinder", body / 4 * math.cos(turn), body / 4 * math.sin(turn), 0.0, d / 2, height / 2))
    return spark.createDataFrame(rows, "n int, weight double, shape string, x double, y double, z double, radius double, halfz double").withColumns({c: F.lit(None).cast("double") for c in ("halfx", "halfy")})


def point_array(spark, counts: tuple[int, int, int], spacing: tuple[float, float, float], radius: float) -> DataFrame:
    """Sources of equal spheres on a lattice around the origin."""
    i, total = F.col("id"), counts[0] * counts[1] * counts[2]
    place = [i % counts[0], F.floor(i / counts[0]) % counts[1], F.floor(i / (counts[0] * counts[1]))]
    at = [((p - (n - 1) / 2) * s).alias(a) for p, n, s, a in zip(place, counts, spacing, "xyz", strict=True)]
    return spark.range(total).select((i + 1).cast("int").alias("n"), F.lit(1.0).alias("weight"), F.lit("Sphere").alias("shape"), *at, F.lit(float(radius)).alias("radius"), *[F.lit(None).cast("double").alias(c) for c in ("halfx", "halfy", "halfz")])


def voxel_sources(volume: DataFrame, shape: tuple[int, int, int], size: tuple[float, float, float], *groups: str) -> DataFrame:
    """Sources of a volume's voxels (ix, iy, iz, v) with activity: boxes whose weights are v over the volume's largest, numbered by place."""
    w = Window.partitionBy(*groups)
    some = volume.filter("v > 0")
    at = [((F.col(f"i{a}") - (n - 1) / 2) * s).alias(a) for a, n, s in zip("xyz", shape, size, strict=True)]
    n = F.row_number().over(w.orderBy("iz", "iy", "ix"))
    return some.select(*groups, n.alias("n"), (F.col("v") / F.max("v").over(w)).alias("weight"), F.lit("Box").alias("shape"), *at, F.lit(None).cast("double").alias("radius"), *[F.lit(s / 2).alias(f"half{a}") for a, s in zip("xyz", size, strict=True)])
