"""Operators on two-hit event lists: geometry lookup, filters, categories, order inference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import energy, geometry

SCORE_EPS = 1e-12


def layered(detectors: DataFrame, *machine: str) -> DataFrame:
    """Detectors with ``layer_rank`` (by distinct |y| to 6 decimals, from 1), ``is_front`` and ``is_rear``; a machine's last layer is its rear. A dimension table: the window runs over a machine's few rows."""
    y = F.round(F.abs("y"), 6)
    rank = F.dense_rank().over(Window.partitionBy(*machine).orderBy(y))
    out = detectors.withColumn("layer_rank", rank)
    last = F.max("layer_rank").over(Window.partitionBy(*machine))
    return out.withColumn("is_rear", F.col("layer_rank") == last).withColumn("is_front", F.col("layer_rank") < last)


def checked(layers: DataFrame, events: DataFrame | None = None, *machine: str) -> DataFrame:
    """``layers`` (see ``layered``) if each machine has two layers or more, its ids are whole numbers from 1 on without gaps, and the events' ids are among them; else an error that says what is wrong."""
    per = layers.groupBy(*machine).agg(F.countDistinct("layer_rank").alias("layers"), F.count(F.lit(1)).alias("n"), F.countDistinct("det_id").alias("ids"), F.min("det_id").alias("least"), F.max("det_id").alias("most"))
    wrong = per.filter((F.col("layers") < 2) | (F.col("ids") < F.col("n")) | (F.col("least") != 1) | (F.col("most") != F.col("ids"))).first()
    if wrong:
        raise ValueError("fewer than two layers" if wrong["layers"] < 2 else "detector ids are missing, repeated or don't begin at 1")
    if events is not None:
        ids = events.select(*machine, F.explode(F.array("cp1", "cp2")).alias("det_id")).distinct()
        lost = ids.join(F.broadcast(layers.select(*machine, "det_id")), [*machine, "det_id"], "left_anti").first()
        if lost:
            raise ValueError(f"events name detector {lost['det_id']}, which has no layer")
    return layers


def located(events: DataFrame, detectors: DataFrame) -> DataFrame:
    """Events with both hits' positions and layers (x1, y1, z1, layer1, x2, ...). Ids without a detector go. The detector table is a dimension of the machine's size, not of the data's."""
    for i in (1, 2):
        d = detectors.select(F.col("det_id").alias(f"cp{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("x", "y", "z")], F.col("layer_rank").alias(f"layer{i}"), F.col("is_rear").alias(f"rear{i}"))
        events = events.join(F.broadcast(d), f"cp{i}")
    return events


def finite_ids(events: DataFrame, n_detectors: int) -> DataFrame:
    """Events with ids in range, different detectors and finite energies."""
    ok = F.lit(True)
    for c in ("cp1", "cp2"):
        ok = ok & F.col(c).between(1, n_detectors)
    for c in ("e1", "e2"):
        ok = ok & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return events.filter(ok & (F.col("cp1") != F.col("cp2")))


def cross_layer(located_events: DataFrame, gap: float = 0.1) -> DataFrame:
    return located_events.filter(F.abs(F.col("y1") - F.col("y2")) > gap)


def front_rear(located_events: DataFrame) -> DataFrame:
    """Events with one hit in the rear layer and the other before it; ``front_first`` says which comes first."""
    return located_events.filter(F.col("rear1") != F.col("rear2")).withColumn("front_first", ~F.col("rear1"))


def category(layer1: Column, layer2: Column, last: int = 4) -> Column:
    """same_layer, front_front, front_rear or rear_front."""
    return F.when(layer1 == layer2, "same_layer").when((layer1 < last) & (layer2 < last), "front_front").when(layer1 < last, "front_rear").otherwise("rear_front")


def moments(events: DataFrame, *keys: str) -> DataFrame:
    """Counts, means, population deviations and the correlation of the energies."""
    e1, e2 = F.col("e1"), F.col("e2")
    total = e1 + e2
    share = F.when(total != 0, e1 / total)
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(f(c), 6).alias(f"{name}_{what}") for what, c in (("e1", e1), ("e2", e2), ("sum", total), ("share", share), ("diff", e1 - e2)) for name, f in (("mean", F.avg), ("std", F.stddev_pop))],
        F.round(F.avg((e1 > e2).cast("double")), 6).alias("e1_greater"),
        F.round(F.avg((e2 > e1).cast("double")), 6).alias("e2_greater"),
        F.round(F.corr(e1, e2), 6).alias("corr"),
    )


def transitions(located_events: DataFrame, layers: int = 4) -> DataFrame:
    """The full matrix of layer pairs: layer1, layer2, n and its share of all."""
    spark = located_events.sparkSession
    grid = spark.range(layers * layers).select((F.floor(F.col("id") / layers) + 1).cast("int").alias("layer1"), (F.col("id") % layers + 1).cast("int").alias("layer2"))
    n = located_events.groupBy("layer1", "layer2").agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(n, ["layer1", "layer2"], "left").select("layer1", "layer2", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over layers squared rows
    return full.withColumn("share", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), 6))


def canonical(front_rear_events: DataFrame) -> DataFrame:
    """Front and rear hits named as such, whichever came first: ef, er, xf .. zf, xr .. zr."""
    first = F.col("front_first")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    out = front_rear_events
    for c in ("e", "x", "y", "z"):
        out = out.withColumn(f"{c}f", pick(f"{c}1", f"{c}2")).withColumn(f"{c}r", pick(f"{c}2", f"{c}1"))
    return out


def centre_weight(first: geometry.Point, second: geometry.Point, theta: Column, sigma_deg: float) -> Column:
    """How well a first hit fits a source at the centre: a Gaussian of the angle at the first hit less the scatter angle; 0 without a scatter angle."""
    leg = geometry.minus(second, first)
    both = geometry.norm(first) * geometry.norm(leg)
    beta = F.acos(geometry.clamp(geometry.dot(first, leg) / F.when(both > 0, both), -1 + 1e-9, 1 - 1e-9))
    d = (beta - theta) / math.radians(sigma_deg)
    return F.coalesce(F.exp(-0.5 * d * d), F.lit(0.0))


def order_scores(canonical_events: DataFrame, e0: float, prior: float = 1.2, sigma_deg: float = 20.0, power: float = 1.0) -> DataFrame:
    """Scores of the hypotheses that the front or the rear hit came first, the decision and its confidence."""
    front, rear = tuple(F.col(f"{c}f") for c in "xyz"), tuple(F.col(f"{c}r") for c in "xyz")
    out = canonical_events
    for name, e, a, b, weight in (("front", "ef", front, rear, prior), ("rear", "er", rear, front, 1.0)):
        theta = energy.scatter_angle_or_null(F.col(e), e0)
        out = out.withColumn(f"{name}_kn", weight * energy.klein_nishina(F.col(e), e0)).withColumn(f"{name}_centre", centre_weight(a, b, theta, sigma_deg))
        out = out.withColumn(f"{name}_score", F.col(f"{name}_kn") * F.pow(F.col(f"{name}_centre"), F.lit(power)))
    out = out.withColumn("pred_front_first", F.col("front_score") >= F.col("rear_score"))
    out = out.withColumn("log_ratio", F.log(F.col("front_score") + SCORE_EPS) - F.log(F.col("rear_score") + SCORE_EPS))
    return out.withColumn("confidence", F.abs("log_ratio")).withColumn("correct", F.col("pred_front_first") == F.col("front_first"))


def order_features(scored: DataFrame, e0: float) -> list[tuple[str, Column]]:
    """The 28 named features of an event for order classifiers."""
    ef, er, eps = F.col("ef"), F.col("er"), 1e-12
    total, diff = ef + er, ef - er
    tf, tr = (energy.scatter_angle_or_null(c, e0) for c in (ef, er))
    leg = geometry.minus(tuple(F.col(f"{c}r") for c in "xyz"), tuple(F.col(f"{c}f") for c in "xyz"))
    ratio = lambda what: F.log(F.col(f"front_{what}") + eps) - F.log(F.col(f"rear_{what}") + eps)
    radius = lambda s: F.sqrt(F.col(f"x{s}") * F.col(f"x{s}") + F.col(f"z{s}") * F.col(f"z{s}"))
    return [
        ("front_energy", ef),
        ("rear_energy", er),
        ("energy_sum", total),
        ("energy_diff", diff),
        ("energy_absdiff", F.abs(diff)),
        ("front_frac", ef / F.greatest(total, F.lit(eps))),
        ("rear_frac", er / F.greatest(total, F.lit(eps))),
        ("front_theta", F.coalesce(tf, F.lit(0.0))),
        ("rear_theta", F.coalesce(tr, F.lit(0.0))),
        ("front_theta_valid", tf.isNotNull().cast("double")),
        ("rear_theta_valid", tr.isNotNull().cast("double")),
        *[(f"{s}_{w}", F.col(f"{s}_{w}")) for w in ("kn", "centre") for s in ("front", "rear")],
        *[(f"log_{w}", ratio(w)) for w in ("kn", "centre", "score")],
        ("front_x", F.col("xf")),
        ("front_z", F.col("zf")),
        ("rear_x", F.col("xr")),
        ("rear_z", F.col("zr")),
        ("delta_x", leg[0]),
        ("delta_y", leg[1]),
        ("delta_z", leg[2]),
        ("line_length", geometry.norm(leg)),
        ("front_radius", radius("f")),
        ("rear_radius", radius("r")),
    ]


def standardised(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (deviations under 1e-6 count as 1). One row of statistics is joined back."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"__{c}") for c in names])
    out = df.crossJoin(F.broadcast(stats))  # exactly one row
    for c in names:
        s = F.col(f"__{c}.s")
        out = out.withColumn(c, (F.col(c) - F.col(f"__{c}.m")) / F.when(s < 1e-6, F.lit(1.0)).otherwise(s))
    return out.drop(*[f"__{c}" for c in names])


def collated(each: DataFrame, value: str, *keys: str) -> DataFrame:
    """Repeats, mean and sample deviation of a metric by method."""
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeats"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("deviation"))


def count_maps(events: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys and counts, a map of each value to its number of rows; values are few (categories). Rows without a value count as "none"."""
    n = events.groupBy(*keys, F.coalesce(F.col(value).cast("string"), F.lit("none")).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__k", "__n")))).alias("counts"))


def added_maps(maps: DataFrame, name: str, *keys: str) -> DataFrame:
    """Maps of numbers added up key by key, within ``keys``; what a map doesn't have counts as 0. Entries are added before maps are made, so no group holds more than its values."""
    n = maps.select(*keys, F.explode(name).alias("__k", "__n")).groupBy(*keys, "__k").agg(F.sum("__n").alias("__n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__k", "__n")))).alias(name))


def map_difference(a: str, b: str) -> Column:
    """Map a less map b, key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))


def map_shares(name: str) -> Column:
    """A map of counts as shares of their sum."""
    total = F.aggregate(F.map_values(name), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform_values(name, lambda _, x: x / total)
