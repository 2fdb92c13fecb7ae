"""Ranked lexical search by a pipeline of term owners.

The index deals terms to ``OWNERS`` owners by their hash, and documents to blocks
of one Arrow batch (some 4 MB of texts). For each block an owner has the postings
of its own terms. Items go in bundles of ``BUNDLE``. A bundle visits the owners
one after another, carrying for each block the sparse sums that its items'
documents have so far; at each owner a cogroup by block brings the bundles and
the owner's postings together, and the owner adds its terms' integer
contributions. The last owner hands on each item's best of the block, and a
window with a limit by rank takes the best of all.

Every group is one block: bounded by the batch and the items of a pass, whatever
term, document or source is frequent. All terms of all documents count towards a
document's length; only those that can be an item's (by a filter of 2^20 slots,
so of a fixed size) become postings. Terms are compared by their bytes. Items go
in passes of at most ``ITEMS`` items and ``ITEM_BYTES`` of terms, which are what
is broadcast; the index is built once for all passes.

Cases: a null or empty text has no term, isn't counted and isn't found; an item
without a term, or none of whose terms occurs, gives no row; rows that repeat an
item_id are ranked together with their terms, rows that repeat a doc_id each by
itself; null ids are kept, and come last among ties; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .job import documents, shared_dir, tune
from .textops import arrow_bytes, distinct_spans, plain_words, span_hashes

#: Owners of terms: stages of the pipeline.
OWNERS = 4
#: Items that share a row of sums.
BUNDLE = 64
#: Items of a pass at most, and bytes of their terms unless one item has more.
ITEMS, ITEM_BYTES = 1024, 8 << 20
#: Slots of the filter of terms.
SLOTS = 20

_INDEX = "block long, owner int, doc_ids array<long>, sizes array<long>, terms array<binary>, places array<int>, docs array<int>, counts array<int>"
_BUNDLES = "block long, bundle int, sums binary"
_FOUND = "item_id long, doc_id long, score long, block long, place int"


def slots(items: DataFrame) -> np.ndarray:
    """Which slots the items' terms have; at most 2^20 numbers come to the driver."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lower, starts, ends, _ = plain_words(*arrow_bytes(b.column("text")))
            yield pa.RecordBatch.from_pydict({"slot": np.unique(span_hashes(lower, starts, ends) >> np.uint64(64 - SLOTS)).astype(np.int32)})

    out = np.zeros(1 << SLOTS, bool)
    out[[r["slot"] for r in items.mapInArrow(emit, "slot int").distinct().collect()]] = True
    return out


def _lists(parts: list[pa.Array | None], kind: pa.DataType) -> pa.ListArray:
    """A list column whose rows are arrays."""
    edge = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.concat_arrays([pa.array([], kind), *[x for x in parts if x is not None]]))


def index(docs: DataFrame, kept: np.ndarray) -> DataFrame:
    """The postings of each (block, owner), written by owner. Owner -1 has the block's totals: documents with a term, and terms."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.packbits(kept))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = TaskContext.get().partitionId(), np.unpackbits(sent.value).astype(bool)
        for seq, b in enumerate(batches):
            lower, starts, ends, first = plain_words(*arrow_bytes(b.column("text")))
            size, ids = np.diff(first), b.column("doc_id").cast(pa.int64()).to_pylist()
            h = span_hashes(lower, starts, ends)
            use = np.flatnonzero(kept[(h >> np.uint64(64 - SLOTS)).astype(np.int64)])
            doc, a, z, n = np.repeat(np.arange(len(size)), size)[use], starts[use], ends[use], max(1, len(size))
            one, which = distinct_spans(lower, a, z)
            owner = (h[use[one]] % np.uint64(OWNERS)).astype(np.int64)
            byte = lower.tobytes()
            terms = np.array([byte[x:y] for x, y in zip(a[one].tolist(), z[one].tolist(), strict=True)] + [b""], object)[:-1]
            key, tf = np.unique(which * n + doc, return_counts=True)
            term, place = key // n, key % n
            held = np.bincount(term, minlength=len(one))
            rows = [(-1, None, pa.array([int((size > 0).sum()), int(size.sum())], pa.int64()), None, None, None, None)]
            for o in range(OWNERS):
                of = owner[term] == o
                mine = np.flatnonzero(owner == o)
                rows.append((o, pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(terms[mine].tolist(), pa.binary()), *[pa.array(x, pa.int32()) for x in (np.cumsum(held[mine]), place[of], tf[of])]))
            columns = [_lists([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([part << 24 | seq] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), *columns], ["block", "owner", "doc_ids", "sizes", "terms", "places", "docs", "counts"])

    path = f"{shared_dir(spark)}/index"
    docs.mapInArrow(post, _INDEX).write.partitionBy("owner").option("compression", "zstd").parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def passes(items: DataFrame) -> Iterator[DataFrame]:
    """The items (item_id, terms), in tables of at most ``ITEMS`` rows and ``ITEM_BYTES`` of terms."""
    grouped = items.mapInArrow(_terms, "item_id long, term binary").distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    sized = grouped.withColumn("bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    spark = items.sparkSession
    path = f"{shared_dir(spark)}/items"
    sized.write.option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    total = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-total["n"] // (ITEMS * 3 // 4)), -(-total["bytes"] // (ITEM_BYTES * 3 // 4)))  # by hash, so with room for chance
    dealt = table.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("long"))
    for r in dealt.groupBy("pass").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).orderBy("pass").collect():
        own = dealt.where(F.col("pass") == r["pass"])
        again = max(-(-r["n"] // ITEMS), -(-r["bytes"] // ITEM_BYTES))
        for k in range(again):
            yield own.where(F.pmod(F.xxhash64("item_id", F.lit(7)), F.lit(again)) == k).select("item_id", "terms")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lower, starts, ends, first = plain_words(*arrow_bytes(b.column("text")))
        item = np.repeat(np.arange(len(b)), np.diff(first))
        yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id").cast(pa.int64()).take(pa.array(item, pa.int64())), "term": pa.array([lower[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary())})


def frequencies(postings: DataFrame) -> DataFrame:
    """term and df, the documents that hold it; each task adds up its blocks first."""
    lists = postings.select(F.posexplode("terms").alias("i", "term"), "places")
    return lists.groupBy("term").agg(F.sum(F.try_element_at("places", F.col("i") + 1) - F.coalesce(F.when(F.col("i") > 0, F.try_element_at("places", F.when(F.col("i") > 0, F.col("i")))), F.lit(0))).alias("df"))


def pack(sums: np.ndarray) -> bytes:
    """The places and values of the sums of a bundle that aren't 0, in as few bytes as the largest needs."""
    at = np.flatnonzero(sums.ravel())
    value = sums.ravel()[at]
    step = np.diff(at, prepend=0)
    wide = ["<u1", "<u2", "<u4", "<u8"]
    kinds = [next(w for w in wide if int(x.max(initial=0)) < 1 << 8 * int(w[2])) for x in (step, value)]
    return bytes([int(kinds[0][2]), int(kinds[1][2])]) + len(at).to_bytes(6, "little") + step.astype(kinds[0]).tobytes() + value.astype(kinds[1]).tobytes()


def unpack(data: bytes | None, shape: tuple[int, int]) -> np.ndarray:
    sums = np.zeros(shape, np.int64)
    if data:
        a, v, n = data[0], data[1], int.from_bytes(data[2:8], "little")
        at = np.cumsum(np.frombuffer(data, f"<u{a}", n, 8).astype(np.int64))
        sums.ravel()[at] = np.frombuffer(data, f"<u{v}", n, 8 + a * n)
    return sums


def best(score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores above 0, equal ones by id."""
    some = np.flatnonzero(score > 0)
    if len(some) > top:
        least = np.partition(score[some], len(some) - top)[len(some) - top]
        some = some[score[some] >= least]
    return some[np.lexsort((ids[some], -score[some]))][:top]


def search(docs: DataFrame, items: DataFrame, top: int = 50, length_share: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of each item.

    ``length_share`` of 100 is how far a document's length counts.
    """
    spark = docs.sparkSession
    tune(spark)
    own = documents(docs, id_col, text_col)
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    posted = index(own, slots(asked))
    total = posted.where("owner = -1").agg(F.sum(F.col("sizes")[0]).alias("n"), F.sum(F.col("sizes")[1]).alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    df = frequencies(posted.where("owner >= 0")).withColumn("df", F.col("df").cast("long"))
    found = None
    for part in passes(asked):
        got = _pass(posted, part, df, n_docs, n_terms, top, length_share)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _pass(posted: DataFrame, part: DataFrame, df: DataFrame, n_docs: int, n_terms: int, top: int, share: int) -> DataFrame:
    """The best documents of each block for the items of one pass."""
    spark = posted.sparkSession
    terms = part.select("item_id", F.explode("terms").alias("term"))
    known = {r["term"]: r["df"] for r in df.join(F.broadcast(terms.select("term").distinct()), "term").collect()}  # the pass's terms
    rows = part.orderBy("item_id").collect()
    weight: dict[bytes, tuple[int, list[int]]] = {}
    for i, r in enumerate(rows):
        for term in r["terms"]:
            if term in known:
                w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * known[term] + 1)))
                weight.setdefault(bytes(term), (w, []))[1].append(i)
    names, bundles = [r["item_id"] for r in rows], -(-len(rows) // BUNDLE)
    sent = spark.sparkContext.broadcast({t: (w, np.array(i)) for t, (w, i) in weight.items()})

    def visit(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, dict[str, pa.Array]]]:
        """(bundle, sums) of the bundles at one block after this owner's contributions."""
        posting = {k: right.column(k)[0].values for k in ("doc_ids", "sizes", "terms", "places", "docs", "counts")}
        size, place, tf = (posting[k].to_numpy().astype(np.int64) for k in ("sizes", "docs", "counts"))
        m = 100 - share + (share * size * n_docs) // max(1, n_terms)
        gain = 1_000_000_000 * tf // (1000 * tf + 20 * m[place])
        hits, a = [], 0
        for term, z in zip(posting["terms"].to_pylist(), posting["places"].to_pylist(), strict=True):
            if term in sent.value:
                hits.append((*sent.value[term], a, z))
            a = z
        for bundle, data in zip(left.column("bundle").to_pylist(), left.column("sums").to_pylist(), strict=True):
            first = bundle * BUNDLE
            sums = unpack(data, (min(BUNDLE, len(names) - first), len(size)))
            for w, who, a, z in hits:
                lo, hi = np.searchsorted(who, (first, first + BUNDLE))
                if hi > lo and w:
                    sums[(who[lo:hi] - first)[:, None], place[a:z]] += w * gain[a:z]
            yield bundle, sums, posting

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        block = right.column("block")[0].as_py()
        out = [(block, bundle, pack(sums)) for bundle, sums, _ in visit(left, right)]
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "bundle": pa.array([x[1] for x in out], pa.int32()), "sums": pa.array([x[2] for x in out], pa.binary())})

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        block, out = right.column("block")[0].as_py(), []
        for bundle, sums, posting in visit(left, right):
            named = posting["doc_ids"].to_pylist()
            ids = np.array([2**63 - 1 if x is None else x for x in named], np.int64)
            for i in range(len(sums)):
                for j in best(sums[i], ids, top).tolist():
                    out.append((names[bundle * BUNDLE + i], named[j], int(sums[i, j]), block, j))
        kinds = [pa.int64()] * 4 + [pa.int32()]
        return pa.table({k: pa.array([x[i] for x in out], kinds[i]) for i, k in enumerate(("item_id", "doc_id", "score", "block", "place"))})

    owner = [posted.where(F.col("owner") == o).groupBy("block") for o in range(OWNERS)]
    carried = posted.where("owner = -1").select("block", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), F.lit(None).cast("binary").alias("sums"))
    for o in range(OWNERS - 1):
        carried = carried.groupBy("block").cogroup(owner[o]).applyInArrow(add, _BUNDLES)
    return carried.groupBy("block").cogroup(owner[-1]).applyInArrow(choose, _FOUND)
