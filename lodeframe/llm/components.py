"""Connected components of a table of links, by contraction, without gathering links of all documents anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import written

#: Links that one task works out at the end; more are contracted before, so its memory is bounded.
TOGETHER = 1 << 20


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of a bounded number of links (a, b)."""
    rows = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not rows:
        return
    a, b = (np.concatenate(x) for x in zip(*rows, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    yield pa.RecordBatch.from_pydict({"node": nodes, "component": nodes[[top(i) for i in range(len(up))]]})


def components(links: DataFrame, together: int = TOGETHER) -> DataFrame:
    """node and component (the smallest node it is tied to) for every node of links (a, b).

    Each round orders the nodes anew, by a hash of the node and the round. Every
    node goes to the first of its neighbours and itself, twice more follows that
    one, and the links' ends are replaced. In a random order a chain of steps is
    short, whatever the ids, so a round leaves a fixed share of the nodes and the
    number of rounds is logarithmic. When at most ``together`` links are left, one
    task works them out. Tables between rounds are written.
    """
    links = written(links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).filter("a <> b").distinct(), "links")
    found, turn = None, 0
    while links.count() > together:
        turn += 1
        place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min(place("b")), F.first(place("a"))).alias("to"))
        step = written(low.select(F.col("a").alias("node"), F.col("to.node").alias("to")), "low")
        for _ in range(2):
            again = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            step = written(step.join(again, "to").select("node", F.col("far").alias("to")), "step")
        found = step.select("node", F.col("to").alias("component")) if found is None else _followed(found, step)
        found = written(found, "found")
        ends = links
        for end in ("a", "b"):
            ends = ends.join(step.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        ends = ends.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).filter("a <> b").distinct()
        links = written(ends, "links")
    last = written(links.coalesce(1).mapInArrow(solve, "node long, component long"), "found")
    if found is None:
        return last
    found = _followed(found, last.withColumnRenamed("component", "to"))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return written(found.join(least, "component").select("node", F.col("least").alias("component")), "found")


def _followed(found: DataFrame, step: DataFrame) -> DataFrame:
    """``found`` (node, component) with the components that ``step`` (node, to) moves replaced."""
    return found.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` (node, component) with further links (a, b): only classes that these tie are worked on."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
    ties = components(ends.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")))
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    old = known.select("node", "component").unionByName(nodes.join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
    step = ties.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return written(old.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "found")
