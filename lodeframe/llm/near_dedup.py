"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is the weighted set of its runs of five words (``[^\\x20\\x09-\\x0D]+``),
a run's weight being how often it occurs; a text of fewer words is one run. The
similarity is the probability Jaccard index of two such sets.

ProbMinHash: each run starts a Poisson process whose rate is its weight; each
arrival belongs to one of ``K`` components at random. A component's signature is
the run that arrives there first. Arrivals are drawn only up to a time by which
all components are very likely served, and further where they are not, so long
documents draw little more than short ones. ``BANDS`` bands of ``ROWS``
components bring documents together: at a similarity of 0.8, all but 1 in 10,000
such pairs share a band.

Equal texts are one node, and the smallest doc_id stands for them. Each band
bucket compares its members with a leader (the first by one of ``ORDERS`` orders),
by their exact similarity, on the texts. While a bucket still has members of
different classes, further rounds compare those outside its largest class with
``LEADERS`` other members of that class, drawn anew each round and for each band,
until a round has nothing new to compare or has linked under one in a thousand
pairs. These rounds only make classes large at little cost; what they leave is
compared in whole: of every bucket, all pairs of members that are still in
different classes (``rest``). Small buckets' pairs are listed. A larger bucket is
dealt into blocks, and a task takes two of them, its largest class being never
compared with itself. There an upper bound from sums over shared runs, which are
matrix products, leaves the pairs whose exact similarity is computed. That work
grows with a bucket's size times the number of members outside its largest class.

Cases: texts without words are equal to each other only if the texts are, null
being the empty text; repeated rows fall in one class; null ids are kept, with a
null class; an empty table gives no rows. Rows that share a doc_id but not the
text are tied by their doc_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, merged
from .job import documents, shared_dir, tune, written
from .textops import U, arrow_bytes, grams, mix, span_hashes, word_spans

WORDS, BANDS, ROWS, SIMILARITY = 5, 24, 5, 0.8
K = BANDS * ROWS
#: Bytes of texts that are sketched at once.
SLICE = 1 << 20
#: Orders in which a bucket's first leader is chosen, by its band: so members of a large group meet several leaders.
ORDERS = 3
#: Leaders of a bucket in each further round.
LEADERS = 4
#: Rounds end after one that has linked a smaller share of the pairs it compared; the pairs they leave are compared by blocks.
LEAST_YIELD = 0.001
#: Members of a bucket whose pairs are listed; those of larger ones are compared by blocks of so many members and bytes.
SMALL, BLOCK, BLOCK_BYTES = 8, 1024, 8 << 20
#: Documents that one copy of a leader's text is compared with; leaders of more are copied.
SALT = 256


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, weight) of the distinct runs of all documents, in order of (doc, hash)."""
    starts, ends, first = word_spans(buf, off)
    words = span_hashes(buf, starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    room = np.repeat(first[1:], count) - np.arange(len(words))
    whole = np.flatnonzero(room >= WORDS)
    h = grams(words, WORDS)
    parts, docs = [h[whole]] if len(whole) else [], [doc[whole]] if len(whole) else []
    for n in range(1, WORDS):  # whole texts of fewer words
        at = first[:-1][count == n]
        if len(at):
            parts.append(grams(words, n)[at] + U(n))
            docs.append(doc[at])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(parts), np.concatenate(docs)
    bits = max(1, int(len(count)).bit_length())
    key = np.sort((d.astype(np.uint64) << U(64 - bits)) | (h >> U(bits)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    i = np.flatnonzero(new)
    d = (key[i] >> U(64 - bits)).astype(np.int64)
    # The document took the place of some last bits, up to 16, so a run is named by its leading 48, in every batch alike.
    return d, (key[i] << U(bits)) >> U(16), np.diff(np.append(i, len(key)))


def _uniform(h: np.ndarray, step: int, salt: int) -> np.ndarray:
    return mix(h + U((2 * step + salt) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 2**64 - 1))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """((n, K) signatures, which documents have one)."""
    total = np.bincount(doc, weights=weight, minlength=n)
    has = total > 0
    time = np.full((n, K), np.inf)
    who = np.zeros((n, K), np.uint64)
    limit = np.where(has, K * (np.log(K) + 3) / np.maximum(total, 1), 0.0)
    own, t, step = np.arange(len(doc)), np.zeros(len(doc)), 0
    at_step = np.zeros(len(doc), np.int64)
    ready = np.zeros(len(doc), bool)  # whose next arrival is drawn and waits for a later limit
    while len(own):
        d = doc[own]
        draw = own[~ready[own]]
        if len(draw):
            k = at_step[draw]
            u = np.empty(len(draw))
            for s in np.unique(k):
                m = k == s
                u[m] = ((_uniform(h[draw[m]], int(s), 0) >> U(11)).astype(float) + 1) * 2.0**-53
            t[draw] += -np.log(u) / weight[draw]
            ready[draw] = True
        arrived = own[t[own] <= limit[d]]
        if len(arrived):
            k, comp = at_step[arrived], np.empty(len(arrived), np.int64)
            for s in np.unique(k):
                m = k == s
                comp[m] = (_uniform(h[arrived[m]], int(s), 1) >> U(33)).astype(np.int64) % K
            cell = doc[arrived] * K + comp
            order = np.lexsort((h[arrived], -t[arrived]))  # the first arrival is written last
            cell, src = cell[order], arrived[order]
            flat_t, flat_w = time.reshape(-1), who.reshape(-1)
            better = t[src] < flat_t[cell]
            cell, src = cell[better], src[better]
            flat_t[cell], flat_w[cell] = t[src], h[src]
            at_step[arrived] += 1
            ready[arrived] = False
            own = arrived
            continue
        short = has & np.isinf(time).any(axis=1)  # very rarely a component isn't served yet
        limit[short] *= 2
        own = np.flatnonzero(short[doc])
    return who, has


def bands(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, BANDS) band keys, which documents have them)."""
    n = len(off) - 1
    who, has = signatures(*shingles(buf, off), n)
    keys = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(n, U(b + 1))
        for r in range(ROWS):
            x = mix(x * U(0xFF51AFD7ED558CCD) + who[:, b * ROWS + r])
        keys[:, b] = x
    return keys, has


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact probability Jaccard index of the i-th texts of two batches (buf, off)."""
    n = len(a[1]) - 1
    (da, ha, wa), (db, hb, wb) = shingles(*a), shingles(*b)
    doc = np.concatenate([da, db])
    h = np.concatenate([ha, hb])
    order = np.lexsort((h, doc))
    x = np.concatenate([wa, np.zeros(len(wb), np.int64)])[order]
    y = np.concatenate([np.zeros(len(wa), np.int64), wb])[order]
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    i = np.flatnonzero(new)
    if not len(i):
        return np.zeros(n)
    x, y, doc = np.add.reduceat(x, i).astype(float), np.add.reduceat(y, i).astype(float), doc[i]
    # For run i: sum over j of max(x_j/x_i, y_j/y_i); in order of x/y, those from i on count by x and those before by y.
    order = np.lexsort((x / np.maximum(y, 1e-12), doc))
    x, y, doc = x[order], y[order], doc[order]
    first = np.searchsorted(doc, np.arange(n + 1))
    cx, cy = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    place = np.arange(len(x))
    from_here, before = cx[first[doc + 1]] - cx[place], cy[place] - cy[first[doc]]
    both = (x > 0) & (y > 0)
    part = np.zeros(len(x))
    part[both] = 1 / (from_here[both] / x[both] + before[both] / y[both])
    return np.bincount(doc, weights=part, minlength=n)


def bounds(runs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) upper bounds of the similarities between the documents a and b of ``runs`` (doc, hash, weight).

    With the weights X and Y of two documents, of which x and y are on runs that
    both have, the index is at most 1 / (X/x + Y/y - 1), and equal to it where
    these runs' weights are in proportion, as when no run repeats. For, run i adds
    1 / sum of max(x_j/x_i, y_j/y_i), which is at most 1 / (X/x_i + (Y-y)/y_i); that
    is concave and homogeneous in (x_i, y_i), so the sum is at most its value at (x, y).
    """
    doc, h, w = runs
    weight = np.bincount(doc, weights=w, minlength=n)
    _, col = np.unique(h, return_inverse=True)
    sides = []
    for side in (a, b):
        place = np.full(n, -1)
        place[side] = np.arange(len(side))
        at = np.flatnonzero(place[doc] >= 0)
        sides.append((place[doc[at]], col[at], w[at].astype(np.float32)))
    size = int(col.max(initial=-1)) + 1
    many = [np.bincount(c, minlength=size) for _, c, _ in sides]
    x, y = np.zeros((2, len(a), len(b)), np.float32)
    dense = many[0] * many[1] * 256 >= len(a) * len(b)
    dense &= (many[0] > 0) & (many[1] > 0)
    number, wide = np.cumsum(dense) - 1, int(dense.sum())
    for lo in range(0, wide, 1024):  # runs that many documents have: products of matrices
        m = []
        for (r, c, v), k in zip(sides, (len(a), len(b)), strict=True):
            at = np.flatnonzero(dense[c] & (number[c] >= lo) & (number[c] < lo + 1024))
            m.append(np.zeros((k, min(1024, wide - lo)), np.float32))
            m[-1][r[at], number[c[at]] - lo] = v[at]
        x += m[0] @ (m[1] > 0).astype(np.float32).T
        y += (m[0] > 0).astype(np.float32) @ m[1].T
    rare = (many[0] > 0) & (many[1] > 0) & ~dense
    (ra, ca, va), (rb, cb, vb) = [tuple(z[at][np.argsort(c[at], kind="stable")] for z in (r, c, v)) for r, c, v in sides for at in [np.flatnonzero(rare[c])]]
    first = np.searchsorted(cb, ca)
    count = np.searchsorted(cb, ca, side="right") - first
    total = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(ca):  # others: their pairs, some millions at a time
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 22), side="right")) - 1)
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = first[i] + np.arange(total[lo], total[hi]) - total[i]
        cell = ra[i] * len(b) + rb[j]
        x += np.bincount(cell, weights=va[i], minlength=x.size).reshape(x.shape)
        y += np.bincount(cell, weights=vb[j], minlength=y.size).reshape(y.shape)
        lo = hi
    out = np.zeros(x.shape)
    i, j = np.nonzero(x)
    out[i, j] = 1 / (weight[a[i]] / x[i, j] + weight[b[j]] / y[i, j] - 1)
    return out


def block_links(table: pa.Table) -> pa.Table:
    """Links between the members of two blocks (side 0 and 1), or of one, that tie all classes which a similar pair ties."""
    side, doc, component = (table.column(c).to_numpy() for c in ("side", "doc", "component"))
    text = table.column("text").combine_chunks()
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if side.any() else a
    names, own = np.unique(component, return_inverse=True)
    out = []
    if len(a) and len(names) > 1:
        bound = bounds(shingles(*arrow_bytes(text)), len(doc), a, b)
        i, j = np.nonzero((bound >= SIMILARITY - 1e-6) & (own[a][:, None] != own[b][None]))
        order = np.argsort(-bound[i, j], kind="stable")
        i, j = a[i[order]], b[j[order]]
        while len(i):  # of each two classes the likeliest pair, until no pair is left between different ones
            two = np.minimum(own[i], own[j]) * len(names) + np.maximum(own[i], own[j])
            pick = np.unique(two, return_index=True)[1]
            for k in range(0, len(pick), 256):
                p = pick[k : k + 256]
                s = similarity(arrow_bytes(text.take(pa.array(i[p]))), arrow_bytes(text.take(pa.array(j[p]))))
                for q, v in zip(p, s, strict=True):
                    if v >= SIMILARITY - 1e-9 and own[i[q]] != own[j[q]]:
                        out.append((doc[i[q]], doc[j[q]], v))
                        own[own == own[j[q]]] = own[i[q]]
            left = np.ones(len(i), bool)
            left[pick] = False
            left &= own[i] != own[j]
            i, j = i[left], j[left]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "similarity": pa.array([x[2] for x in out], pa.float64())})


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the text's length in bytes and two 64-bit hashes of it, and the band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = arrow_bytes(b.column("text"))
            cut = np.unique(np.concatenate([[0, len(b)], np.searchsorted(off, np.arange(SLICE, len(buf), SLICE))]))  # a worker's memory follows the slice
            parts = [bands(buf[off[a] : off[z]], off[a : z + 1] - off[a]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
            if not parts:
                continue
            keys, has = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            flat = pa.array(keys[has].astype(np.int64).ravel())
            at = np.concatenate([[0], np.cumsum(has * BANDS)])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "text": b.column("text"), "bands": pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)})

    out = docs.mapInArrow(sketch, "doc_id long, text string, bands array<long>")
    text = F.coalesce("text", F.lit(""))
    return written(out.select("doc_id", F.octet_length(text).alias("size"), F.xxhash64(text, F.lit(1)).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"), "bands"), "sketches")


class Verifier:
    """Texts of the documents that share a bucket with another, bucketed by their ids, for exact similarities."""

    def __init__(self, docs: DataFrame, ids: DataFrame):
        spark = docs.sparkSession
        n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"texts_{uuid.uuid4().hex}"
        one = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        one.repartition(n, "doc_id").write.format("parquet").bucketBy(n, "doc_id").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
        self.texts = spark.table(name)
        spark.sql(f"DROP TABLE {name}")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough; a is the leader, whose text goes to its partners in copies of at most SALT each."""
        copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("copies"))
        leaders = self.texts.join(copies, self.texts["doc_id"] == copies["a"]).select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        salted = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"))
        met = salted.join(leaders, ["a", "salt"]).select("a", "b", "text_a")
        rows = met.join(self.texts.withColumnRenamed("doc_id", "b"), "b").select("a", "b", "text_a", "text")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = similarity(arrow_bytes(b.column("text_a")), arrow_bytes(b.column("text")))
                ok = pa.array(s >= SIMILARITY - 1e-9)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(s).filter(ok)], ["a", "b", "similarity"])

        return written(rows.mapInArrow(verify, "a long, b long, similarity double"), "links")

    def block_links(self, members: DataFrame) -> DataFrame:
        """The links within the units of ``members`` (key, unit, side, doc, component)."""
        rows = members.join(self.texts.withColumnRenamed("doc_id", "doc"), "doc")
        return written(rows.groupBy("key", "unit").applyInArrow(block_links, "a long, b long, similarity double"), "links")


def rest(buckets: DataFrame, known: DataFrame, tested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs of a bucket's members in different classes that may be untested: as pairs (a, b), and as units of one or two blocks (key, unit, side, doc, component).

    Every member has been compared with the bucket's leader, which is left out.
    """
    named = buckets.filter("doc <> lead").join(known.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "size", F.coalesce("component", "doc").alias("component"))
    each = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    main = each.groupBy("key").agg(F.max(F.struct("n", "component", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES, F.lit(1))).cast("long")
    main = main.select("key", "n", F.col("main.component").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("p"), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("q"))
    named = written(named.join(main, "key"), "rest")
    few = named.filter(F.col("n") <= SMALL).select("key", "doc", "component")
    pairs = few.select("key", F.col("doc").alias("a"), "component").join(few.select("key", F.col("doc").alias("b"), F.col("component").alias("other")), "key").filter("a < b and component <> other").select("a", "b").distinct()
    pairs = pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    # p blocks of the largest class and q of the others: units (other, main), then (other, other).
    dealt = named.filter(F.col("n") > SMALL).withColumn("i", F.pmod(F.xxhash64("doc"), F.when(F.col("component") == F.col("main"), F.col("p")).otherwise(F.col("q"))))
    units = F.expr(
        "if(component = main, transform(sequence(0l, q - 1), o -> struct(o * p + i as unit, 1 as side)), "
        "concat(transform(sequence(0l, p - 1), m -> struct(i * p + m as unit, 0 as side)), "
        "transform(sequence(0l, q - 1), o -> struct(q * p + least(i, o) * q + greatest(i, o) as unit, if(i <= o, 0, 1) as side))))"
    )
    return pairs, dealt.select("key", "doc", "component", F.explode(units).alias("u")).select("key", "u.unit", "u.side", "doc", "component")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and representative (the smallest doc_id with the same text)."""
    tune(docs.sparkSession)
    docs = documents(docs, id_col, text_col)
    sketches = _sketches(docs)
    texts = sketches.groupBy("t1", "t2").agg(F.min("doc_id").alias("representative"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    texts = written(texts, "texts")
    member = sketches.select("doc_id", "t1", "t2").join(texts.select("t1", "t2", "representative"), ["t1", "t2"]).select("doc_id", "representative")
    rows = texts.filter("representative is not null").select(F.col("representative").alias("doc"), "size", F.posexplode("bands").alias("band", "key"))
    place = F.struct(F.xxhash64("doc", F.col("band") % ORDERS).alias("h"), "doc")
    shared = rows.groupBy("key").agg(F.min(place).alias("lead"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi").select("key", F.col("lead.doc").alias("lead"))
    buckets = written(rows.join(shared, "key").select("key", "doc", "size", "lead"), "buckets")
    pairs = written(buckets.filter("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return member.withColumn("class_id", F.col("representative")).select("doc_id", "class_id", "representative")
    verifier = Verifier(docs, buckets.select(F.col("doc").alias("doc_id")).distinct())
    tested, turn = pairs, 0
    known = components(verifier.links(pairs))
    while True:
        turn += 1
        named = buckets.select("key", "doc").join(known.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
        # Of each bucket's classes the largest gives other leaders, for the members of the others.
        first = [F.min(F.struct(F.xxhash64("doc", "key", F.lit(turn * LEADERS + i)).alias("h"), "doc")).alias(f"f{i}") for i in range(LEADERS)]
        each = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), *first)
        drawn = F.array_distinct(F.array(*[F.col(f"f{i}.doc") for i in range(LEADERS)]))
        lead = each.groupBy("key").agg(F.max(F.struct("n", "component", drawn.alias("docs"))).alias("lead"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
        new = named.join(lead.select("key", F.col("lead.component").alias("main"), F.col("lead.docs").alias("leads")), "key").filter("component <> main")
        new = new.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_set("leads"))).alias("leads")).select(F.explode("leads").alias("a"), F.col("doc").alias("b"))
        new = written(new.join(tested, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            break
        more = verifier.links(new)
        linked = more.count()
        if linked:
            known = merged(known, more)
        tested = tested.unionByName(new)
        if linked < new.count() * LEAST_YIELD:
            break
    listed, units = rest(buckets, known, tested)
    more = written(verifier.links(listed).unionByName(verifier.block_links(units)), "links")
    if not more.isEmpty():
        known = merged(known, more)
    named = member.join(known.select(F.col("node").alias("representative"), "component"), "representative", "left")
    return named.select("doc_id", F.coalesce("component", "representative").alias("class_id"), "representative")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class left, the one with the smallest id (one of the rows that repeat it); rows with null ids stay."""
    found = classes(docs, id_col, text_col)
    gone = found.filter("doc_id <> class_id").select(F.col("doc_id").alias("__id")).distinct()
    left = docs.join(gone, F.col(f"`{id_col}`") == F.col("__id"), "left_anti")
    nulls = F.when(F.col(f"`{id_col}`").isNull(), F.monotonically_increasing_id())
    return left.withColumn("__null", nulls).dropDuplicates([id_col, "__null"]).drop("__null")
