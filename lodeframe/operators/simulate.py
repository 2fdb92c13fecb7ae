"""Monte-Carlo photons from row ids, cross sections and their interpolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import energy, random


def last_wins(table: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order."""
    columns = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])


def interpolated(df: DataFrame, x: str, table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Values of a small sorted table at x by linear interpolation, held beyond its ends; null x gives null.

    The table, a dimension of a few hundred rows, goes along as sorted arrays, in
    which each batch of rows is looked up by binary search.
    """
    held = [tuple(r) for r in table.select(key, *values).orderBy(key).collect()]  # the table's rows
    at = np.array([r[0] for r in held], float)
    fields = ", ".join(f"`{v}` double" for v in values)

    @F.pandas_udf(f"struct<{fields.replace(' double', ': double')}>")
    def looked_up(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({v: np.interp(x.to_numpy(float), at, [r[k + 1] for r in held]) for k, v in enumerate(values)})

    met = df.withColumn("__at", looked_up(F.col(x).cast("double")))
    return met.select(*df.columns, *[F.when(F.col(x).isNotNull(), F.col(f"__at.{v}")).alias(v) for v in values])


def cosine_table(spark: SparkSession, e0: float, points: int = 513) -> DataFrame:
    """The inverse distribution of mu = cos(theta): q and mu at equal steps of mu, by trapezoids of the Klein-Nishina density."""
    mu = F.col("id") * (2.0 / (points - 1)) - 1
    pdf = energy.klein_nishina_pdf(mu, e0 / energy.ELECTRON)
    w = Window.orderBy("mu")
    t = spark.range(points).select(mu.alias("mu"), pdf.alias("f"))
    t = t.withColumn("area", F.coalesce((F.col("f") + F.lag("f").over(w)) / 2 * (F.col("mu") - F.lag("mu").over(w)), F.lit(0.0)))
    t = t.withColumn("c", F.sum("area").over(w))
    return t.withColumn("q", F.col("c") / F.max("c").over(Window.partitionBy())).select("q", "mu")


def scattered(photons: DataFrame, e0: float, table: DataFrame) -> DataFrame:
    """A scattered photon for each ``id`` of a table: id, mu (cosine), energy, attenuation (1/cm) and free path (cm) with its parts along and across the way in."""
    photons = photons.select("id").withColumn("u", random.uniform(F.col("id"), 1))
    photons = interpolated(photons, "u", cosine_table(photons.sparkSession, e0), "q", ["mu"])
    photons = photons.withColumn("energy", energy.scattered_energy(F.col("mu"), e0))
    photons = interpolated(photons, "energy", last_wins(table, "energy", "line_no").select(F.col("energy").alias("e"), "total"), "e", ["total"])
    path = energy.free_path(random.uniform(F.col("id"), 2), F.col("total") * energy.NAI_DENSITY)
    photons = photons.withColumn("attenuation", F.col("total") * energy.NAI_DENSITY).withColumn("path", path)
    return photons.withColumn("along", F.col("path") * F.col("mu")).withColumn("across", F.col("path") * F.sqrt(1 - F.col("mu") * F.col("mu"))).drop("u", "total")


def slab(photons: DataFrame, thickness: float, photo: float, incoherent: float, escape: float) -> DataFrame:
    """Outcomes of a table's photons, one for each ``id``, in a slab: transmitted, photoelectric, or scattered and then absorbed or escaped; coefficients in 1/cm."""
    mu = photo + incoherent
    u = [random.uniform(F.col("id"), s) for s in (1, 2, 3)]
    outcome = F.when(energy.free_path(u[0], F.lit(mu)) > thickness, "transmitted").when(u[1] < photo / mu, "photoelectric").when(u[2] < escape, "scatter_escaped").otherwise("scatter_absorbed")
    return photons.select("id", outcome.alias("outcome"))


#: Means from which a Poisson number is drawn as a rounded normal one.
LARGE_MEAN = 64


def poisson(mean: Column, id: Column, salt: int = 0) -> Column:
    """A Poisson number of a row's id, in some mean + 12 (deviation + 1) steps: the count of the distribution's steps below a uniform number; from ``LARGE_MEAN`` on a rounded normal number, at least 0. 0 for means of 0 or less."""
    low = F.least(mean, F.lit(float(LARGE_MEAN)))
    u = random.uniform(id, salt)
    start = F.struct(F.lit(0).alias("n"), F.exp(-low).alias("p"), F.exp(-low).alias("below"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * low / k
        return F.struct((s["n"] + (u >= s["below"]).cast("int")).alias("n"), p.alias("p"), (s["below"] + p).alias("below"))

    few = F.aggregate(F.sequence(F.lit(1), F.ceil(F.greatest(low, F.lit(0.0)) + 12 * F.sqrt(F.greatest(low, F.lit(0.0))) + 12).cast("int")), start, step, lambda s: s["n"]).cast("double")
    many = F.greatest(F.round(mean + F.sqrt(mean) * random.normal(id, salt + 1)), F.lit(0.0))
    return F.when(mean <= 0, 0.0).when(mean < LARGE_MEAN, few).otherwise(many)


def noisy(y: Column, id: Column, kind: str = "gaussian") -> Column:
    """Counts with Gaussian noise of their square root, at least 0 and rounded, or Poisson numbers of that mean, or as they are."""
    if kind == "none":
        return y
    if kind == "poisson":
        return poisson(y, id)
    return F.greatest(F.round(y + F.sqrt(F.greatest(y, F.lit(0.0))) * random.normal(id)), F.lit(0.0))


def weighted_position(e1: Column, e2: Column, a: Column, b: Column) -> Column:
    """Position of two deposits weighted by their energies."""
    return F.when(e1 + e2 > 0, (e1 * a + e2 * b) / (e1 + e2))


def energy_weighted(photons: DataFrame, e1: Column, e2: Column, lengths: list[str]) -> DataFrame:
    """``first_weight`` and ``second_weight``, the deposits' shares of the energy, and each length times the second share."""
    total = F.greatest(e1 + e2, F.lit(1e-15))
    out = photons.withColumn("first_weight", e1 / total).withColumn("second_weight", e2 / total)
    return out.select("*", *[(F.col(c) * F.col("second_weight")).alias(f"weighted_{c}") for c in lengths])
