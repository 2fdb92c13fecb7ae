"""Classification metrics, rejection sweeps, calibration, regions of interest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def rejection_sweep(scored: DataFrame, id_col: str, fractions: list[float], buckets: int | None = None) -> DataFrame:
    """For each fraction f: the floor(f n) rows of lowest confidence go; counts and accuracy of the rest, and the last rejected confidence.

    Ranks are global without a single task: rows are range partitioned by
    (confidence, id), into ``buckets`` or the session's number of partitions, counted by partition, and numbered within each partition.
    """
    rows = scored.select("confidence", F.col(id_col).alias("id"), F.col("correct").cast("int").alias("correct"))
    # Written once: range bounds come from a sample, so two runs may part the rows differently.
    placed = written(rows.repartitionByRange(*[buckets] * (buckets is not None), "confidence", "id").withColumn("part", F.spark_partition_id()), "placed")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    ranked = placed.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("confidence", "id"))).join(F.broadcast(before.select("part", "before")), "part")
    rank, total = F.col("before") + F.col("place"), placed.count()
    cuts = [(float(f), math.floor(f * total)) for f in fractions]
    sums = [F.coalesce(F.sum(F.when(rank > cut, F.col("correct"))), F.lit(0)).cast("long").alias(f"c{i}") for i, (_, cut) in enumerate(cuts)]
    last = [F.coalesce(F.max(F.when(rank == cut, F.col("confidence"))), F.lit(0.0)).alias(f"t{i}") for i, (_, cut) in enumerate(cuts)]
    each = [F.struct(F.lit(f).alias("reject_fraction_target"), F.lit(cut).cast("long").alias("reject_count"), F.lit(total - cut).cast("long").alias("retained_count"), F.col(f"c{i}").alias("retained_correct_count"), F.col(f"t{i}").alias("confidence_threshold"), F.lit(total).cast("long").alias("total")) for i, (f, cut) in enumerate(cuts)]
    out = ranked.agg(*sums, *last).select(F.inline(F.array(*each)))
    return out.select(
        "reject_fraction_target",
        (F.col("reject_count") / F.col("total")).alias("reject_fraction_actual"),
        "reject_count",
        "retained_count",
        (F.col("retained_count") / F.col("total")).alias("retained_fraction"),
        "retained_correct_count",
        ratio(F.col("retained_correct_count"), F.col("retained_count")).alias("retained_accuracy"),
        "confidence_threshold",
    )


def confusion(df: DataFrame, truth: Column, pred: Column, *keys: str) -> DataFrame:
    """TP, FN, FP, TN, class accuracies, accuracy and balanced accuracy."""
    n = lambda c: F.sum(c.cast("long"))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), n(truth & pred).alias("tp"), n(truth & ~pred).alias("fn"), n(~truth & pred).alias("fp"), n(~truth & ~pred).alias("tn"))
    tpr, tnr = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return out.select("*", tpr.alias("positive_accuracy"), tnr.alias("negative_accuracy"), ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), ((tpr + tnr) / 2).alias("balanced_accuracy"))


def soft(df: DataFrame, truth: Column, p: Column, *keys: str) -> DataFrame:
    """Brier score, log loss (clipped at 1e-7) and mean probability of the true class."""
    y = truth.cast("double")
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
        F.avg(F.when(truth, p).otherwise(1 - p)).alias("true_class_probability"),
    )


def calibration(df: DataFrame, truth: Column, p: Column, bins: int = 10) -> DataFrame:
    """Equal bins of the probability, the last closed; empty bins have null means."""
    at = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    got = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(truth.cast("double")).alias("positive_share"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(got, "bin", "left").select("bin", (F.col("bin") / bins).alias("bin_left"), ((F.col("bin") + 1) / bins).alias("bin_right"), F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "positive_share")


#: Half the width, in shares of the rows, of the ranges in which percentiles are looked up; five times the error of the approximate ones.
NEAR = 5e-4
#: Rows of a key up to which all of its distinct values are ranked: for few rows such ranges would be narrower than a rank.
FEW = 20_000


def summary(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """n, mean, population std, min, p05, median, p95 and max by key, the percentiles exact and linear between ranks. Null values are left out; a key without any gives n = 0 and nulls.

    No task holds a key's values. Approximate percentiles give two values about
    each wanted one; rows below the first are counted, and only the distinct
    values between them are ranked, by a window that sorts on disk.
    """
    shares = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    rows = written(df.select(*keys, value.cast("double").alias("__v")), "values")  # read twice
    v, n = F.col("__v"), F.col("n")
    plain = rows.groupBy(*keys).agg(F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"), F.min("__v").alias("min"), F.max("__v").alias("max"), *[F.percentile_approx("__v", [max(q - NEAR, 0.0), min(q + NEAR, 1.0)], 10_000).alias(f"__{c}") for c, q in shares.items()])
    plain = written(plain, "summaries")  # a row a key
    tags = [f"k{i}" for i in range(len(keys))]  # keys may be null and share names with other columns
    low = plain.select(*[F.col(f"`{k}`").alias(t) for k, t in zip(keys, tags, strict=True)], "n", *[f"__{c}" for c in shares])
    same = F.lit(True)
    for k, t in zip(keys, tags, strict=True):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(t))
    met = rows.filter(v.isNotNull()).join(low, same)
    low_end = lambda c: F.when(n <= FEW, float("-inf")).otherwise(F.element_at(f"__{c}", 1))
    high_end = lambda c: F.when(n <= FEW, float("inf")).otherwise(F.element_at(f"__{c}", 2))
    parts = F.array(*[F.struct(F.lit(c).alias("what"), low_end(c).alias("from"), high_end(c).alias("to"), ((n - 1) * q).alias("place")) for c, q in shares.items()])
    each = met.select(*tags, "__v", F.explode(parts).alias("p")).select(*tags, "__v", "p.*").filter(v <= F.col("to"))
    # Values below the range count as one value, which comes first and is never asked for unless it is the least.
    counted = each.groupBy(*tags, "what", "place", F.when(v >= F.col("from"), v).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*tags, "what").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("c").over(w))
    lower, upper = F.floor("place"), F.ceil("place")
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    found = ranked.groupBy(*tags, "what").agg(at(lower).alias("a"), at(upper).alias("b"), F.first(F.col("place") - lower).alias("t"))
    found = found.groupBy(*tags).agg(*[F.max(F.when(F.col("what") == c, F.col("a") + F.col("t") * (F.col("b") - F.col("a")))).alias(c) for c in shares])
    found = found.select(*tags, *[F.col(c).alias(f"__x{c}") for c in shares])
    out = plain.join(found if keys else F.broadcast(found), same, "left")  # without keys both have one row at most
    return out.select(*keys, "n", "mean", "std", "min", *[F.col(f"__x{c}").alias(c) for c in shares], "max")


def contrast(df: DataFrame, value: Column, roi: Column, background: Column, true_ratio: float, *keys: str) -> DataFrame:
    """ROI and background means and deviations, contrast recovery and contrast-to-noise ratio."""
    out = df.groupBy(*keys).agg(
        F.sum(roi.cast("long")).alias("n_roi"),
        F.sum(background.cast("long")).alias("n_background"),
        F.avg(F.when(roi, value)).alias("roi_mean"),
        F.avg(F.when(background, value)).alias("background_mean"),
        F.stddev_pop(F.when(background, value)).alias("background_std"),
    )
    gain = ratio(F.col("roi_mean"), F.col("background_mean")) - 1
    return out.select("*", (gain / (true_ratio - 1)).alias("crc"), ratio(F.col("roi_mean") - F.col("background_mean"), F.col("background_std")).alias("cnr"))


#: Bits of a sketch's index, and the standard error of its count.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def cubed(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Values by all subsets of the keys, with ``level``: a bit for each key, the first key's the highest, that is 1 where the key is left out."""
    return df.cube(*keys).agg(*[c.alias(n) for n, c in values.items()], F.grouping_id(*keys).alias("level"))


def grouped_sets(df: DataFrame, sets: list[list[str]], keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Values by the given sets of keys in one pass, with ``level`` as in ``cubed``."""
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*[c.alias(n) for n, c in values.items()], F.grouping_id(*keys).alias("level"))


def sketched(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """A sketch of each column's distinct values by keys: a few KB however many rows there are, and mergeable, so that new files only add theirs."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(c, SKETCH_BITS).alias(c) for c in columns])


def merged_sketches(sketches: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Counts of distinct values from sketches, merged by fewer keys."""
    return sketches.groupBy(*keys).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
