"""Importance resampling towards a target text: hashed word runs, gains of their buckets, a draw without replacement.

Segment deduplication: line feeds cut texts into lines. Lines are brought to
their words, small letters with one space between, and equal lines are one row
with their number. So the features of a line that a million documents repeat are
counted once and multiplied; runs of words that cross a line's end are counted
apart, from the documents. What a document scores uses the same cut: a batch's
distinct lines are scored once.

What moves: distinct lines once (added up before the shuffle, so a hot line is a
row a task), one vector of ``buckets`` numbers a task, and the drawn rows. The
ranks of the drawn come from a range-partitioned table and the sizes of its
parts, never from one sorted task. The driver gets the gains (``buckets``
numbers), the histogram of scores (thousandths of a bounded range) and the sizes.

Cases: a null or empty text has no feature, weight 0 and isn't drawn; repeated
rows are scored and ranked each; a null id hashes as the empty string and comes
last among ties; empty tables give no rows, an empty target equal counts of 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import documents, tune, written
from .textops import arrow_bytes, distinct_spans, plain_words

#: Bytes of the longest strings whose checksums advance side by side.
LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each byte string buf[starts:ends], one byte of all a step."""
    lens, out = ends - starts, np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(lens > LONG).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]])
    short = np.flatnonzero(lens <= LONG)
    order = short[np.argsort(-lens[short], kind="stable")]  # longest first: those still going are a prefix
    at, falling = starts[order], -lens[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for t in range(-int(falling[0]) if len(order) else 0):
        n = int(np.searchsorted(falling, -t, side="left"))
        c[:n] = _CRC[(c[:n] ^ buf[at[:n] + t]) & 255] ^ (c[:n] >> 8)
    out[order] = ~c
    return out


class Words:
    """The words of a batch on a tape of their own, one space after each; line[i] numbers their lines, doc[i] their documents."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        lower, starts, ends, self.first = plain_words(buf, off)
        size = ends - starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        n = int(self.ends[-1]) + 1 if len(size) else 0
        self.tape = np.full(n, 32, np.uint8)
        word = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        self.tape[self.starts[word] + within] = lower[starts[word] + within]
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        breaks = np.searchsorted(np.flatnonzero(buf == 10), starts)  # line feeds before each word
        new = np.ones(len(size), bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.line = np.cumsum(new) - 1
        self.head = np.flatnonzero(new)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the lines that hold a word, on the tape."""
        return self.starts[self.head], self.ends[np.append(self.head[1:], len(self.line)) - 1] if len(self.line) else self.ends

    def crossing(self, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, doc) of the runs of 2 to ``orders`` words of one document that lie in more than one line."""
        found = []
        for k in range(2, orders + 1):
            i = np.arange(max(0, len(self.line) - k + 1))
            i = i[(self.doc[i] == self.doc[i + k - 1]) & (self.line[i] != self.line[i + k - 1])]
            found.append((self.starts[i], self.ends[i + k - 1], self.doc[i]))
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([empty, *x]) for x in zip(*found, strict=True)) if found else (empty, empty, empty)


def line_features(tape: np.ndarray, starts: np.ndarray, ends: np.ndarray, orders: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, line) of each run of 1 to ``orders`` words of each line tape[starts:ends]."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    size = ends - starts
    line = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + starts[line]
    space = tape[place] == 32
    gap = np.flatnonzero(space)
    a = np.sort(np.concatenate([starts, place[gap] + 1]))
    z = np.sort(np.concatenate([ends, place[gap]]))
    of = np.repeat(np.arange(len(size)), 1 + np.bincount(line[gap], minlength=len(size)))
    found = []
    for k in range(1, orders + 1):
        i = np.arange(max(0, len(of) - k + 1))
        i = i[of[i] == of[i + k - 1]]
        found.append((crc32_spans(tape, a[i], z[i + k - 1]).astype(np.int64) % buckets, of[i]))
    return np.concatenate([x for x, _ in found]), order[np.concatenate([x for _, x in found])]


def segments(texts: DataFrame, orders: int = 1, buckets: int = 10000) -> DataFrame:
    """line, bucket and times: the distinct lines of all texts with their number (bucket null), and how often a bucket's runs cross a line's end (line null)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crossing = np.zeros(buckets, np.int64)
        for b in batches:
            w = Words(*arrow_bytes(b.column("text")))
            starts, ends = w.lines()
            one, which = distinct_spans(w.tape, starts, ends)
            times = np.bincount(which, minlength=len(one))
            size = ends[one] - starts[one]
            edge = np.concatenate([[0], np.cumsum(size)])
            within = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
            data = w.tape[np.repeat(starts[one], size) + within]
            if len(one):
                line = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(one), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_pydict({"line": line.cast(pa.binary()), "bucket": pa.nulls(len(one), pa.int32()), "times": times})
            a, z, _ = w.crossing(orders)
            crossing += np.bincount(crc32_spans(w.tape, a, z).astype(np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(crossing)
        if len(some):
            yield pa.RecordBatch.from_pydict({"line": pa.nulls(len(some), pa.binary()), "bucket": some.astype(np.int32), "times": crossing[some]})

    return texts.select("text").mapInArrow(cut, "line binary, bucket int, times long").groupBy("line", "bucket").agg(F.sum("times").alias("times"))


def bucket_counts(texts: DataFrame, orders: int = 1, buckets: int = 10000) -> np.ndarray:
    """How many features of all texts fall in each bucket; a distinct line's are worked out once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            times = b.column("times").to_numpy()
            plain = b.column("line").is_null().to_numpy(zero_copy_only=False)
            np.add.at(total, b.column("bucket").fill_null(0).to_numpy()[plain], times[plain])
            tape, off = arrow_bytes(b.column("line"))
            own = np.flatnonzero(~plain)
            bucket, line = line_features(tape, off[own], off[own + 1], orders, buckets)
            np.add.at(total, bucket, times[own][line])
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_pydict({"bucket": some.astype(np.int32), "n": total[some]})

    out = np.zeros(buckets, np.int64)
    for r in segments(texts, orders, buckets).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B)/((s+1)(T+B)))) of each of B buckets."""
    total_s, total_t, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (total_s + n) / ((s + 1.0) * (total_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of a document's features. The gains are a number a bucket."""
    buckets, sent = len(gain), docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in batches:
            w = Words(*arrow_bytes(b.column("text")))
            starts, ends = w.lines()
            one, which = distinct_spans(w.tape, starts, ends)
            bucket, line = line_features(w.tape, starts[one], ends[one], orders, buckets)
            of_line, in_line = np.zeros(len(one), np.int64), np.bincount(line, minlength=len(one))
            np.add.at(of_line, line, gain[bucket])
            total, n = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            doc = w.doc[w.head]
            np.add.at(total, doc, of_line[which])
            np.add.at(n, doc, in_line[which])
            a, z, doc = w.crossing(orders)
            np.add.at(total, doc, gain[crc32_spans(w.tape, a, z).astype(np.int64) % buckets])
            n += np.bincount(doc, minlength=len(b))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n_words": np.diff(w.first), "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)})

    return docs.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with rank, from 1 in the given order. The order is that of a range-partitioned, written table; a part's first rank is the number of rows of the parts before it."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33)), "ranked")
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a part
    base = np.concatenate([[0], np.cumsum([n for _, n in sizes])])
    before = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, base[:-1], strict=True)], "__part int, __before long")
    return placed.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10000, percent: int = 10, least: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn.

    Of the documents of ``least`` words or more, floor(percent * N / 100) with the highest weight plus Gumbel noise are drawn.
    """
    tune(docs.sparkSession)
    own = documents(docs, id_col, text_col)
    aim = target.select(F.col(f"`{target_col}`").cast("string").alias("text"))
    gain = gains(bucket_counts(own, orders, buckets), bucket_counts(aim, orders, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weights(own, gain, orders).withColumn("score", F.col("weight") + noise).withColumn("__row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least
    counts = sorted(((r["score"], r["n"]) for r in scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # a row a score, of a bounded range
    drawn = percent * sum(n for _, n in counts) // 100
    left, limit = drawn, None
    for score, n in counts:
        if left <= 0:
            break
        limit, left = score, left - n
    out = ["doc_id", "n_features", "weight", "score"]
    chance = fit & (F.col("score") >= limit) if limit is not None else F.lit(False)
    rest = scored.where(~chance).select(*out, F.lit(None).cast("long").alias("rank"))
    if limit is None:
        return rest
    first = ranked(scored.where(chance), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row"))
    return rest.unionByName(first.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")))
