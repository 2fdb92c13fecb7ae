"""Queries on shards of event rows, the trained order network, shapes of masks, cubes, sketches and maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import energy, random
from ..operators import classifier, metrics, morphology, network, recon, rotation, simulate
from ..operators import events as ev
from ..session import shared_dir
from ..sources import shards
from . import event_queries as eq
from . import recon_queries, views
from .catalogue import query


def r6(c):
    return F.round(c, 6)


@query(f"WITH {recon_queries._LIST}, s AS (SELECT event_id % 3 AS energy, view, event_id % 4 AS subset, event_id, sum(t * pixel_id) AS m FROM tl JOIN v_event USING (event_id) GROUP BY ALL) SELECT energy, view, subset, count(*)::BIGINT AS rows, round(sum(m), 4) AS moment, 0::BIGINT AS damaged FROM s GROUP BY ALL")
def event_row_shards(spark, sf_dir):
    """Event rows written as shards, read back by a plan of subsets, with the number of damaged ones."""
    e = recon_queries.list_events(spark, sf_dir).select("*", (F.col("event_id") % 3).alias("energy"), (F.col("event_id") % 4).alias("subset"))
    made = lambda placed: recon_queries.made_rows(spark, sf_dir, placed, *shards.SHARD)
    path = shared_dir(spark, "shards")
    told = shards.kept_or_built(spark, path, lambda: e, chunk_rows=1000, made=made)
    plan = told.select("energy", "view", "subset").distinct()
    moment = F.aggregate(F.transform("t", lambda t, i: t * i), F.lit(0.0), lambda a, x: a + x)
    back = shards.read(spark, path, plan).groupBy("energy", "view", "subset").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(moment), 4).alias("moment"))
    bad = shards.damaged(spark, path).groupBy("energy", "view", "subset").agg(F.count(F.lit(1)).alias("damaged"))
    key = [F.col(k).cast("long").alias(k) if k != "view" else F.col(k) for k in ("energy", "view", "subset")]
    return back.join(bad, ["energy", "view", "subset"], "left").select(*key, "rows", "moment", F.coalesce("damaged", F.lit(0)).alias("damaged"))


@query()
def order_network_minibatch(spark, sf_dir):
    """The network of 128 and 64 with dropout, AdamW and its best state, trained on minibatches; held-out accuracy, Brier score, log loss and mean probability of the true order next to the hand-made scores'."""
    scored = eq.scored(spark, sf_dir)
    data, names = classifier.order_data(scored, views.E0, keep=["event_id"])
    kept = data.filter(~F.col("held")).withColumn("inner", F.pmod(F.xxhash64("view", F.lit(5)), F.lit(5)) == 0)
    model = network.train(kept.filter(~F.col("inner")), kept.filter("inner"), names, batch=512, slices=16)
    held = data.filter("held")
    out = network.scored(held, model, names).join(held.select(F.col("event_id").alias("id"), "by_score"), "id")
    hard = metrics.confusion(out, F.col("y") > 0.5, F.col("p") >= 0.5)
    soft = metrics.soft(out, F.col("y") > 0.5, F.col("p")).drop("n")
    best = max(model.history, key=lambda h: h["accuracy"])
    return hard.crossJoin(soft).crossJoin(out.agg(F.avg("by_score").alias("score_accuracy"))).withColumn("kept_epoch", F.lit(best["epoch"]))  # one row each


_NEAR = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dx, dy, dz)"
_PARTS = f"""WITH RECURSIVE v_vox AS ({views.SQL['v_vox']}), m AS (SELECT vol, (ix * 64 + iy * 8 + iz)::INTEGER AS c, v > 14 AS on_ FROM v_vox),
    e AS (SELECT a.vol, a.c AS a, b.c AS b, a.on_ FROM (SELECT vol, ix * 64 + iy * 8 + iz AS c, (ix + dx) * 64 + (iy + dy) * 8 + iz + dz AS d, v > 14 AS on_ FROM v_vox, {_NEAR} WHERE ix + dx BETWEEN 0 AND 7 AND iy + dy BETWEEN 0 AND 7 AND iz + dz BETWEEN 0 AND 7) a JOIN m b ON a.vol = b.vol AND a.d = b.c AND a.on_ = b.on_),
    r AS (SELECT vol, c AS node, c AS root, on_ FROM m UNION SELECT r.vol, b, root, r.on_ FROM r JOIN e ON e.vol = r.vol AND e.a = r.node),
    p AS (SELECT vol, node, on_, min(root) AS part FROM r GROUP BY ALL), s AS (SELECT vol, part, on_, count(*) AS n, bool_or(node // 64 IN (0, 7) OR node // 8 % 8 IN (0, 7) OR node % 8 IN (0, 7)) AS rim FROM p GROUP BY ALL)"""


@query(_PARTS + """ SELECT vol, count(*) FILTER (on_)::BIGINT AS parts, max(n) FILTER (on_)::BIGINT AS largest, arg_min(part, (-n, part)) FILTER (on_)::INTEGER AS first_cell, (coalesce(sum(n) FILTER (on_), 0) + coalesce(sum(n) FILTER (NOT on_ AND NOT rim), 0))::BIGINT AS filled
    FROM s WHERE vol < (SELECT count(*) FROM embeddings) // 8 GROUP BY vol""", whole=True)
def mask_parts(spark, sf_dir):
    """Connected parts, the largest one and filled holes of every whole volume's bright voxels, in blocks of four cells."""
    shape, whole = (8, 8, 8), views.read(spark, sf_dir, "embeddings").count() // 8
    mask = views.voxels(spark, sf_dir).filter((F.col("v") > 14) & (F.col("vol") < whole)).select("vol", "ix", "iy", "iz")
    parts = morphology.labelled(mask, "vol", size=4)
    cell = F.col("ix") * 64 + F.col("iy") * 8 + F.col("iz")
    best = morphology.largest(parts, "vol").groupBy("vol").agg(F.count(F.lit(1)).alias("largest"), F.min(cell).alias("first_cell"))
    full = morphology.filled(mask, shape, "vol", size=4).groupBy("vol").agg(F.count(F.lit(1)).alias("filled"))
    return parts.groupBy("vol").agg(F.countDistinct("part").alias("parts")).join(best.hint("merge"), "vol").join(full.hint("merge"), "vol")  # a row a volume


_DISK = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)"


@query(f"""WITH m AS (SELECT vol, ix, iy, iz FROM v_vox WHERE v > 16), g AS (SELECT DISTINCT vol, x::INTEGER AS ix, y::INTEGER AS iy, z::INTEGER AS iz FROM m, range(8) a(x), range(8) b(y), range(8) c(z)),
    d AS (SELECT DISTINCT vol, ix + dx AS ix, iy + dy AS iy, iz FROM m, {_DISK} WHERE ix + dx BETWEEN 0 AND 7 AND iy + dy BETWEEN 0 AND 7),
    e AS (SELECT g.vol, g.ix, g.iy, g.iz FROM g CROSS JOIN {_DISK} LEFT JOIN d ON d.vol = g.vol AND d.ix = g.ix + dx AND d.iy = g.iy + dy AND d.iz = g.iz GROUP BY ALL HAVING bool_and(d.vol IS NOT NULL OR g.ix + dx NOT BETWEEN 0 AND 7 OR g.iy + dy NOT BETWEEN 0 AND 7))
    SELECT vol, iz, count(*)::BIGINT AS closed FROM e GROUP BY ALL""")
def mask_closing(spark, sf_dir):
    """Cells of every plane's bright voxels after closing with a small disk."""
    mask = views.voxels(spark, sf_dir).filter("v > 16").select("vol", "ix", "iy", "iz")
    return morphology.closed(mask, (8, 8, 8), morphology.ball(1, flat=True), "vol", size=4).groupBy("vol", "iz").agg(F.count(F.lit(1)).alias("closed"))


@query(f"WITH {eq._LOC}, c AS (SELECT view, {eq._CAT} AS category, layer1, e1 FROM loc) SELECT view, category, layer1, count(*)::BIGINT AS n, round(sum(e1), 6) AS e1, GROUPING(view, category, layer1)::BIGINT AS level FROM c GROUP BY CUBE (view, category, layer1)")
def category_cube(spark, sf_dir):
    """Events and energies by file, category and first layer, and by each subset of these."""
    e = eq.located(spark, sf_dir, False).withColumn("category", ev.category(F.col("layer1"), F.col("layer2")))
    return metrics.cubed(e, ["view", "category", "layer1"], {"n": F.count(F.lit(1)), "e1": r6(F.sum("e1"))})


@query(f"WITH {eq._LOC}, c AS (SELECT view, {eq._CAT} AS category, e1 FROM loc) SELECT view, category, count(*)::BIGINT AS n, round(max(e1), 6) AS most FROM c GROUP BY GROUPING SETS ((view, category), (category), ())")
def category_grouping_sets(spark, sf_dir):
    e = eq.located(spark, sf_dir, False).withColumn("category", ev.category(F.col("layer1"), F.col("layer2")))
    return metrics.grouped_sets(e, [["view", "category"], ["category"], []], ["view", "category"], {"n": F.count(F.lit(1)), "most": r6(F.max("e1"))}).drop("level")


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS exact, true AS within, count(DISTINCT event_id % 5000)::BIGINT AS exact_slots, true AS within_slots FROM events GROUP BY GROUPING SETS ((event_type), ())")
def distinct_sketches(spark, sf_dir):
    """Distinct users and slots from sketches kept by file and merged by type and over all, beside exact counts; a sketch is within five standard errors."""
    e = views.read(spark, sf_dir, "events").withColumn("file", F.col("event_id") % 20).withColumn("slot", F.col("event_id") % 5000)
    kept = metrics.sketched(e, ["user_id", "slot"], "file", "event_type")
    merged = metrics.merged_sketches(kept, ["user_id", "slot"], "event_type").unionByName(metrics.merged_sketches(kept, ["user_id", "slot"]).withColumn("event_type", F.lit(None).cast("string")))
    exact = metrics.grouped_sets(e, [["event_type"], []], ["event_type"], {"exact": F.count_distinct("user_id"), "exact_slots": F.count_distinct("slot")}).drop("level")
    met = exact.join(merged.withColumnRenamed("event_type", "kind"), F.col("event_type").eqNullSafe(F.col("kind")))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), 5 * metrics.SKETCH_ERROR * F.col(a))
    return met.select("event_type", "exact", near("exact", "user_id").alias("within"), "exact_slots", near("exact_slots", "slot").alias("within_slots"))


@query(f"""WITH {eq._LOC}, c AS (SELECT view % 4 AS part, view, {eq._CAT} AS category FROM loc), n AS (SELECT part, category, count(*) AS n, count(DISTINCT view) AS files FROM c GROUP BY ALL)
    SELECT part, coalesce(max(n) FILTER (category = 'same_layer'), 0)::BIGINT AS same_layer, coalesce(max(n) FILTER (category = 'front_rear'), 0)::BIGINT AS front_rear, round(coalesce(max(n) FILTER (category = 'front_rear'), 0) / sum(n), 6) AS share, count(*)::BIGINT AS categories,
    string_agg(category || '=' || n, ',' ORDER BY category) AS all_ FROM n GROUP BY part""")
def category_maps(spark, sf_dir):
    """Counts by category as a map of each file, maps of files added up by part, and looked up."""
    e = eq.located(spark, sf_dir, False).withColumn("category", ev.category(F.col("layer1"), F.col("layer2")))
    parts = ev.added_maps(ev.count_maps(e, "category", "view").withColumn("part", F.col("view") % 4), "counts", "part")
    share = ev.map_shares("counts")
    look = lambda m, k, zero: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(zero))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return parts.select("part", look(F.col("counts"), "same_layer", 0).alias("same_layer"), look(F.col("counts"), "front_rear", 0).alias("front_rear"), r6(look(share, "front_rear", 0.0)).alias("share"), F.size("counts").cast("long").alias("categories"), text.alias("all_"))


@query(eq._scored_sql("SELECT event_id, round(1 / (1 + exp(-least(greatest(log_ratio, -60), 60))), 6) AS p FROM scored"))
def order_score_probability(spark, sf_dir):
    """The probability that the front hit came first, by the scores' log ratio."""
    return eq.scored(spark, sf_dir).select("event_id", r6(energy.sigmoid(F.col("log_ratio"))).alias("p"))


@query(f"WITH {eq._LOC} SELECT event_id, {', '.join(f'round(CASE WHEN e1 + e2 > 0 THEN (e1 * {c}1 + e2 * {c}2) / (e1 + e2) END, 6) AS {c}' for c in 'xyz')} FROM loc")
def energy_weighted_positions(spark, sf_dir):
    """Where each event's energy lies between its hits."""
    e = eq.located(spark, sf_dir, False)
    return e.select("event_id", *[r6(simulate.weighted_position(F.col("e1"), F.col("e2"), F.col(f"{c}1"), F.col(f"{c}2"))).alias(c) for c in "xyz"])


@query(f"""WITH img AS (SELECT pixel_id, avg(v) AS v FROM v_img GROUP BY pixel_id), rot AS (SELECT view::INTEGER AS view, pixel_id, (base + (view * n // 8 + theta_id) % n)::INTEGER AS src FROM v_pix, range(8) t(view)),
    seen AS (SELECT view, rot.pixel_id, v FROM rot JOIN img ON src = img.pixel_id), f AS (SELECT bin_id, view, sum(h * v) AS y FROM v_sysmat JOIN seen USING (pixel_id) GROUP BY ALL)
    SELECT bin_id, view, round(greatest(round(y + sqrt(y) * {random.sql_normal('(bin_id * 8 + view)')}), 0), 6) AS counts FROM f""")
def noisy_view_projections(spark, sf_dir):
    """The mean image turned to all views, projected and made noisy: the counts of a simulated run."""
    mean = views.images(spark, sf_dir).groupBy("pixel_id").agg(F.avg("v").alias("v"))
    turned = rotation.rotate(mean, rotation.rotation_map(views.pixels(spark), views.VIEWS))
    images = np.zeros((views.PIXELS, views.VIEWS))
    for r in turned.collect():  # a machine's views times pixels
        images[r["pixel_id"], r["view"]] = r["v"]
    y = recon.through(views.matrix(spark, sf_dir), images).select("bin_id", F.posexplode("h").alias("view", "y"))
    return y.select("bin_id", "view", r6(simulate.noisy(F.col("y"), F.col("bin_id") * 8 + F.col("view"))).alias("counts"))
