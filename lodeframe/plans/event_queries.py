"""Queries on event lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import energy, random
from ..operators import events as ev
from ..operators import metrics, sampling
from . import views
from .catalogue import query

E0 = views.E0
MOST = energy.first_deposit_limit(E0)
RES = energy.resolution_at(E0, 0.13)


def r6(c):
    return F.round(c, 6)


def _cos(e: str) -> str:
    return f"(1 - 0.511e0 * {e} / (CASE WHEN 0.511e0 - {e} <> 0 THEN (0.511e0 - {e}) * 0.511e0 END))"


def _theta(e: str) -> str:
    """SQL of the scatter angle of a possible deposit."""
    return f"(CASE WHEN {e} > 0 AND {e} < 0.511e0 AND {_cos(e)} > -1 AND {_cos(e)} < 1 THEN acos(greatest(least({_cos(e)}, 1 - 1e-9), -1 + 1e-9)) END)"


def _kn(e: str) -> str:
    return f"coalesce(CASE WHEN {_theta(e)} IS NOT NULL THEN 0.511e0 / (0.511e0 - {e}) + (0.511e0 - {e}) / 0.511e0 - sin({_theta(e)}) * sin({_theta(e)}) END, 0.0e0)"


_WINDOW = f"e1 < {MOST!r}::DOUBLE AND e1 > 0.05e0 AND e2 > 0.05e0 AND e1 + e2 {{}} 0.46e0"
_LOC = """loc AS (SELECT e.*, a.x AS x1, a.y AS y1, a.z AS z1, a.layer AS layer1, a.layer = 4 AS rear1, b.x AS x2, b.y AS y2, b.z AS z2, b.layer AS layer2, b.layer = 4 AS rear2
    FROM v_event e JOIN v_det a ON e.cp1 = a.det_id JOIN v_det b ON e.cp2 = b.det_id)"""
_CAT = "CASE WHEN layer1 = layer2 THEN 'same_layer' WHEN layer1 < 4 AND layer2 < 4 THEN 'front_front' WHEN layer1 < 4 THEN 'front_rear' ELSE 'rear_front' END"
_MOMENTS = ", ".join(["count(*)::BIGINT AS n", *[f"round({f}({c}), 6) AS {n}_{w}" for w, c in (("e1", "e1"), ("e2", "e2"), ("sum", "e1 + e2"), ("share", "CASE WHEN e1 + e2 <> 0 THEN e1 / (e1 + e2) END"), ("diff", "e1 - e2")) for n, f in (("mean", "avg"), ("std", "stddev_pop"))], "round(avg((e1 > e2)::INTEGER), 6) AS e1_greater", "round(avg((e2 > e1)::INTEGER), 6) AS e2_greater", "round(corr(e1, e2), 6) AS corr"])


def located(spark: SparkSession, sf_dir: str, windowed: bool = True) -> DataFrame:
    e = views.events(spark, sf_dir)
    if windowed:
        e = e.filter(energy.window(F.col("e1"), F.col("e2"), MOST))
    return ev.located(e, ev.layered(views.detectors(spark)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.order_scores(ev.canonical(ev.front_rear(located(spark, sf_dir))), E0)


def _scored_sql(select: str) -> str:
    """SQL of ``scored``: the front and rear hits' names, weights and scores."""
    centre = lambda a, b, e: f"coalesce(exp(-0.5e0 * power((acos(greatest(least((x{a} * (x{b} - x{a}) + y{a} * (y{b} - y{a}) + z{a} * (z{b} - z{a})) / (sqrt(x{a} * x{a} + y{a} * y{a} + z{a} * z{a}) * sqrt((x{b} - x{a}) * (x{b} - x{a}) + (y{b} - y{a}) * (y{b} - y{a}) + (z{b} - z{a}) * (z{b} - z{a}))), 1 - 1e-9), -1 + 1e-9)) - {_theta(e)}) / radians(20.0e0), 2)), 0.0e0)"
    pick = ", ".join(f"CASE WHEN NOT rear1 THEN {c}1 ELSE {c}2 END AS {c}f, CASE WHEN NOT rear1 THEN {c}2 ELSE {c}1 END AS {c}r" for c in ("e", "x", "y", "z"))
    return f"""WITH {_LOC}, can AS (SELECT *, NOT rear1 AS front_first, {pick} FROM loc WHERE rear1 <> rear2 AND {_WINDOW.format(">")}),
        w AS (SELECT *, 1.2e0 * {_kn("ef")} AS front_kn, {_kn("er")} AS rear_kn, {centre("f", "r", "ef")} AS front_centre, {centre("r", "f", "er")} AS rear_centre FROM can),
        s AS (SELECT *, front_kn * front_centre AS front_score, rear_kn * rear_centre AS rear_score FROM w),
        scored AS (SELECT *, front_score >= rear_score AS pred_front_first, ln(front_score + 1e-12) - ln(rear_score + 1e-12) AS log_ratio, abs(ln(front_score + 1e-12) - ln(rear_score + 1e-12)) AS confidence, (front_score >= rear_score) = front_first AS correct FROM s)
        {select}"""


@query(f"SELECT view, count(*) FILTER ({_WINDOW.format('>')})::BIGINT AS n_open, count(*) FILTER ({_WINDOW.format('>=')})::BIGINT AS n_closed FROM v_event GROUP BY view")
def energy_window(spark, sf_dir):
    e1, e2 = F.col("e1"), F.col("e2")
    n = lambda c: F.sum(c.cast("long"))
    return views.events(spark, sf_dir).groupBy("view").agg(n(energy.window(e1, e2, MOST)).alias("n_open"), n(energy.window(e1, e2, MOST, closed=True)).alias("n_closed"))


@query(f"SELECT event_id, round(acos(greatest(least({_cos('e1')}, 1 - 1e-7), -1 + 1e-7)), 6) AS theta FROM v_event WHERE {_cos('e1')} > -1 + 1e-6 AND {_cos('e1')} < 1 - 1e-6")
def kinematic_filter(spark, sf_dir):
    return views.events(spark, sf_dir).filter(energy.is_kinematic(F.col("e1"), E0)).select("event_id", r6(energy.scatter_angle(F.col("e1"), E0)).alias("theta"))


_MACHINES = "SELECT p_size AS machine, p_partkey AS det_id, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END * (100 + 20.0e0 * (floor(p_retailprice * 10)::BIGINT % 7)) AS y FROM part"


@query(f"SELECT machine, det_id, layer_rank, layer_rank = max(layer_rank) OVER (PARTITION BY machine) AS is_rear, layer_rank < max(layer_rank) OVER (PARTITION BY machine) AS is_front FROM (SELECT *, dense_rank() OVER (PARTITION BY machine ORDER BY round(abs(y), 6))::INTEGER AS layer_rank FROM ({_MACHINES}))")
def detector_layers(spark, sf_dir):
    """Parts as detectors, of a machine for each size."""
    p = views.read(spark, sf_dir, "part")
    y = F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1) * (100 + 20.0 * (F.floor(F.col("p_retailprice") * 10) % 7))
    d = p.select(F.col("p_size").alias("machine"), F.col("p_partkey").alias("det_id"), y.alias("y"))
    return ev.layered(d, "machine").select("machine", "det_id", "layer_rank", "is_rear", "is_front")


@query(f"WITH {_LOC} SELECT event_id, round(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2)), 6) AS distance FROM loc WHERE abs(y1 - y2) > 0.1e0")
def role_playing_detector_join(spark, sf_dir):
    d = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    return ev.cross_layer(located(spark, sf_dir, False)).select("event_id", r6(F.sqrt(d)).alias("distance"))


@query(f"WITH {_LOC} SELECT view, count(*)::BIGINT AS n, count(*) FILTER (NOT rear1)::BIGINT AS front_first FROM loc WHERE cp1 <> cp2 AND rear1 <> rear2 GROUP BY view")
def cross_layer_events(spark, sf_dir):
    e = ev.finite_ids(views.events(spark, sf_dir), 64)
    e = ev.front_rear(ev.located(e, ev.layered(views.detectors(spark))))
    return e.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("front_first").cast("long")).alias("front_first"))


@query(f"""WITH {_LOC} SELECT layer1, layer2, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (sum(n) OVER ()), 6)::DOUBLE AS share
    FROM (SELECT (i // 4 + 1)::INTEGER AS layer1, (i % 4 + 1)::INTEGER AS layer2 FROM range(16) t(i)) LEFT JOIN (SELECT layer1, layer2, count(*) AS n FROM loc GROUP BY ALL) USING (layer1, layer2)""")
def layer_transition_matrix(spark, sf_dir):
    return ev.transitions(located(spark, sf_dir, False))


@query(f"WITH {_LOC} SELECT {_CAT} AS category, {_MOMENTS} FROM loc WHERE {_WINDOW.format('>=')} GROUP BY 1")
def scatter_category_summary(spark, sf_dir):
    e = located(spark, sf_dir, False).filter(energy.window(F.col("e1"), F.col("e2"), MOST, closed=True))
    return ev.moments(e.withColumn("category", ev.category(F.col("layer1"), F.col("layer2"))), "category")


@query(f"WITH {_LOC}, c AS (SELECT view, {_CAT} AS category FROM loc) SELECT view, category, count(*)::BIGINT AS n FROM c GROUP BY ROLLUP (view, category)")
def per_file_category_rollup(spark, sf_dir):
    e = located(spark, sf_dir, False).withColumn("category", ev.category(F.col("layer1"), F.col("layer2")))
    return e.rollup("view", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, round({_theta('e1')}, 6) AS theta, round({_kn('e1')}, 6) AS weight FROM v_event")
def klein_nishina_weights(spark, sf_dir):
    e1 = F.col("e1")
    return views.events(spark, sf_dir).select("event_id", r6(energy.scatter_angle_or_null(e1, E0)).alias("theta"), r6(energy.klein_nishina(e1, E0)).alias("weight"))


@query(_scored_sql("SELECT event_id, round(front_score, 6) AS front_score, round(rear_score, 6) AS rear_score, pred_front_first, round(confidence, 4) AS confidence FROM scored"))
def order_inference_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", r6("front_score").alias("front_score"), r6("rear_score").alias("rear_score"), "pred_front_first", F.round("confidence", 4).alias("confidence"))


@query(_scored_sql("SELECT view, count(*)::BIGINT AS n, count(*) FILTER (front_first)::BIGINT AS truth_front_first, count(*) FILTER (pred_front_first)::BIGINT AS pred_front, count(*) FILTER (correct)::BIGINT AS correct, round(avg(correct::INTEGER), 6) AS accuracy FROM scored GROUP BY view"))
def order_inference_per_file(spark, sf_dir):
    n = lambda c: F.sum(F.col(c).cast("long"))
    return scored(spark, sf_dir).groupBy("view").agg(F.count(F.lit(1)).alias("n"), n("front_first").alias("truth_front_first"), n("pred_front_first").alias("pred_front"), n("correct").alias("correct"), r6(F.avg(F.col("correct").cast("double"))).alias("accuracy"))


_FRACTIONS = [0.0, 0.05, 0.1, 0.2, 0.3, 0.4]


@query(_scored_sql(f""", ranked AS (SELECT round(confidence, 4) AS confidence, correct::INTEGER AS correct, row_number() OVER (ORDER BY round(confidence, 4), event_id) AS rank, count(*) OVER () AS total FROM scored),
    f AS (SELECT unnest({_FRACTIONS})::DOUBLE AS reject_fraction_target)
    SELECT reject_fraction_target, round(max(floor(reject_fraction_target * total)) / max(total), 6) AS reject_fraction_actual, max(floor(reject_fraction_target * total))::BIGINT AS reject_count,
    count(*) FILTER (rank > floor(reject_fraction_target * total))::BIGINT AS retained_count, sum(correct) FILTER (rank > floor(reject_fraction_target * total))::BIGINT AS retained_correct_count,
    round(avg(correct) FILTER (rank > floor(reject_fraction_target * total)), 6) AS retained_accuracy, coalesce(max(confidence) FILTER (rank = floor(reject_fraction_target * total)), 0.0e0) AS confidence_threshold
    FROM ranked, f GROUP BY reject_fraction_target"""))
def rejection_sweep(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("confidence", F.round("confidence", 4))
    out = metrics.rejection_sweep(s, "event_id", _FRACTIONS)
    return out.select("reject_fraction_target", r6("reject_fraction_actual").alias("reject_fraction_actual"), "reject_count", "retained_count", "retained_correct_count", r6("retained_accuracy").alias("retained_accuracy"), "confidence_threshold")


@query(_scored_sql("""SELECT count(*)::BIGINT AS n, count(*) FILTER (front_first AND pred_front_first)::BIGINT AS tp, count(*) FILTER (front_first AND NOT pred_front_first)::BIGINT AS fn, count(*) FILTER (NOT front_first AND pred_front_first)::BIGINT AS fp, count(*) FILTER (NOT front_first AND NOT pred_front_first)::BIGINT AS tn,
    round(avg(pred_front_first::INTEGER) FILTER (front_first), 6) AS positive_accuracy, round(avg((NOT pred_front_first)::INTEGER) FILTER (NOT front_first), 6) AS negative_accuracy, round(avg(correct::INTEGER), 6) AS accuracy,
    round((avg(pred_front_first::INTEGER) FILTER (front_first) + avg((NOT pred_front_first)::INTEGER) FILTER (NOT front_first)) / 2, 6) AS balanced_accuracy FROM scored"""))
def confusion_metrics(spark, sf_dir):
    out = metrics.confusion(scored(spark, sf_dir), F.col("front_first"), F.col("pred_front_first"))
    return out.select("n", "tp", "fn", "fp", "tn", *[r6(c).alias(c) for c in ("positive_accuracy", "negative_accuracy", "accuracy", "balanced_accuracy")])


@query("""SELECT bin, bin / 10.0e0 AS bin_left, (bin + 1) / 10.0e0 AS bin_right, coalesce(n, 0)::BIGINT AS n, mean_p, positive_share FROM (SELECT i::INTEGER AS bin FROM range(10) t(i))
    LEFT JOIN (SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(truth), 6) AS positive_share FROM v_pred GROUP BY 1) USING (bin)""")
def calibration_bins(spark, sf_dir):
    out = metrics.calibration(views.predictions(spark, sf_dir), F.col("truth") == 1, F.col("p"))
    return out.select("bin", "bin_left", "bin_right", "n", r6("mean_p").alias("mean_p"), r6("positive_share").alias("positive_share"))


@query("""SELECT count(*)::BIGINT AS n, round(avg((p - truth) * (p - truth)), 6) AS brier, round(avg(-(truth * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - truth) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))), 6) AS log_loss,
    round(avg(CASE WHEN truth = 1 THEN p ELSE 1 - p END), 6) AS true_class_probability FROM v_pred""")
def soft_metrics(spark, sf_dir):
    out = metrics.soft(views.predictions(spark, sf_dir), F.col("truth") == 1, F.col("p"))
    return out.select("n", *[r6(c).alias(c) for c in ("brier", "log_loss", "true_class_probability")])


_SEEDS = 3


@query(f"""WITH seeds AS (SELECT seed, event_id, e1, e2, CASE seed {' '.join(f"WHEN {s} THEN {random.sql_normal('event_id', s)}" for s in range(_SEEDS))} END AS z FROM v_event, (SELECT unnest(range({_SEEDS})) AS seed)),
    smeared AS (SELECT seed, e1 + e1 * {RES!r}::DOUBLE / 2.355e0 * sqrt(0.511e0 / e1) * z AS e1, e2 FROM seeds),
    per AS (SELECT seed, avg(({_WINDOW.format('>')})::INTEGER) AS passed FROM smeared GROUP BY seed)
    SELECT count(*)::BIGINT AS seeds, round(avg(passed), 6) AS mean, round(stddev_pop(passed), 6) AS std, round(min(passed), 6) AS min, round(max(passed), 6) AS max FROM per""")
def multi_seed_aggregate(spark, sf_dir):
    e = views.events(spark, sf_dir).crossJoin(F.broadcast(spark.range(_SEEDS).withColumnRenamed("id", "seed")))
    z = F.coalesce(*[F.when(F.col("seed") == s, random.normal(F.col("event_id"), s)) for s in range(_SEEDS)])
    passed = energy.window(energy.smear(F.col("e1"), E0, RES, z), F.col("e2"), MOST)
    per = e.groupBy("seed").agg(F.avg(passed.cast("double")).alias("passed"))
    return per.agg(F.count(F.lit(1)).alias("seeds"), *[r6(f("passed")).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


_FEATURES = ("front_energy", "energy_diff", "front_frac", "front_theta", "rear_theta_valid", "front_kn", "rear_centre", "delta_y", "line_length", "front_radius")
_FEATURE_SQL = {"front_energy": "ef", "energy_diff": "ef - er", "front_frac": "ef / greatest(ef + er, 1e-12)", "front_theta": f"coalesce({_theta('ef')}, 0.0e0)", "rear_theta_valid": f"({_theta('er')} IS NOT NULL)::INTEGER", "front_kn": "front_kn", "rear_centre": "rear_centre", "delta_y": "yr - yf", "line_length": "sqrt((xr - xf) * (xr - xf) + (yr - yf) * (yr - yf) + (zr - zf) * (zr - zf))", "front_radius": "sqrt(xf * xf + zf * zf)"}


@query(_scored_sql(f", f AS (SELECT event_id, {', '.join(f'({s})::DOUBLE AS {n}' for n, s in _FEATURE_SQL.items())} FROM scored) SELECT event_id, {', '.join(f'round(({n} - avg({n}) OVER ()) / (CASE WHEN stddev_pop({n}) OVER () < 1e-6 THEN 1 ELSE stddev_pop({n}) OVER () END), 5) AS {n}' for n in _FEATURE_SQL)} FROM f"))
def feature_matrix_28(spark, sf_dir):
    """All 28 features are built and standardised; ten are shown."""
    s = scored(spark, sf_dir)
    named = ev.order_features(s, E0)
    out = ev.standardised(s.select("event_id", *[c.alias(n) for n, c in named]), [n for n, _ in named])
    return out.select("event_id", *[F.round(n, 5).alias(n) for n in _FEATURES])


@query(f"""SELECT view, event_id FROM v_event QUALIFY row_number() OVER (PARTITION BY view ORDER BY {random.sql_uniform('event_id')}, event_id) <= 5""")
def capped_sample(spark, sf_dir):
    return sampling.capped(views.events(spark, sf_dir), 5, "event_id", "view").select("view", "event_id")


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def hourly_counts(spark, sf_dir):
    """The batch form of the stream in streaming/events.py."""
    e = views.read(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def streaming_counts(spark, sf_dir):
    """The same counts by a stream over the table's files."""
    from ..streaming.events import hourly_counts as stream

    return stream(spark, f"{sf_dir}/events.parquet")


@query()
def order_classifier(spark, sf_dir):
    """Accuracy of a logistic model of the 28 features on held-out views."""
    from ..operators.classifier import order_accuracy

    return order_accuracy(scored(spark, sf_dir), E0)


@query()
def order_network(spark, sf_dir):
    """Held-out accuracy of a network by its training rounds, and which model is kept."""
    from ..operators import classifier

    data, names = classifier.order_data(scored(spark, sf_dir), E0)
    _, tried = classifier.train_network(data, names, (12,), (5, 15))
    best = max(a for _, a in tried)
    kept = next(n for n, a in tried if a == best)
    return spark.createDataFrame([(n, round(a, 6), n == kept) for n, a in tried], "rounds int, accuracy double, kept boolean")
