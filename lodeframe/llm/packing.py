"""Best-fit decreasing packing of token pieces into sequences of fixed capacity.

Pieces of one length are alike to the packer, so best-fit decreasing over all
documents is run on the histogram of lengths, which has as many rows as the
capacity: bins with equal room are handled as one interval, and a segment tree
over the room left gives the tightest open bin. The plan says, for the r-th
piece of each length, its bin and its place. Ranks come from counts of pieces
by (part, length), so no length is ever gathered in one task.

Cases: a null or empty text is one piece with the end id alone; a text longer
than the capacity is cut, its first piece being the short one; repeated rows
are packed each; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, with_end
from .job import documents, tune, written
from .textops import arrow_bytes


class RoomTree:
    """A segment tree over room 0..capacity that counts the open bins with each room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest room of an open bin that is at least ``least``."""
        i = least + self.size
        if self.count[i]:
            return least
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Best-fit decreasing of counts[length] pieces. Rows say: pieces of ``length`` from rank ``rank`` on go to bins from ``bin`` on, ``each`` to a bin, the first at ``offset``. Also the number of bins."""
    tree, open_bins = RoomTree(capacity), {r: [] for r in range(capacity + 1)}
    rows, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n:
            open_bins[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                put(capacity, bins, n)
                bins, room = bins + n, capacity
            first, n = open_bins[room].pop()
            tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                rows.append((length, rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    names = ("length", "rank", "bin", "each", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}, bins


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, part and ``nth``, its rank among the part's pieces of that length; ids too if asked."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            ids, first = with_end(*encoder(path).encode(*arrow_bytes(b.column("text"))), end)
            size = np.diff(first)
            n = -(-size // capacity)
            at = np.concatenate([[0], np.cumsum(n)])
            doc = np.repeat(np.arange(len(n)), n)
            number = np.arange(at[-1]) - at[:-1][doc]
            short = size[doc] - (n[doc] - 1) * capacity
            start = np.where(number == 0, 0, short + (number - 1) * capacity)
            length = np.where(number == 0, short, capacity)
            order = np.argsort(length, kind="stable")
            run = length[order]
            nth = np.empty(len(run), np.int64)
            nth[order] = np.arange(len(run)) - np.searchsorted(run, run) + seen[run]
            seen += np.bincount(length, minlength=capacity + 1)
            begin = first[:-1][doc] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            out = {
                "doc_id": b.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                "piece": number.astype(np.int32),
                "start": start,
                "length": length,
                "ids_crc32": [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)],
                "part": np.full(len(doc), part, np.int32),
                "nth": nth,
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_pydict(out)

    return documents(docs, id_col, text_col).mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and offset of every piece."""
    tune(docs.sparkSession)
    cut = written(pieces(docs, path, capacity, end, with_ids, id_col, text_col), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    base = by_part.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("part", "length", F.coalesce("base", F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length up to the capacity
    rows, _ = plan(counts, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        ln, rk = length.to_numpy(), rank.to_numpy()
        key = rows["length"] * (1 << 44) - rows["rank"]  # lengths fall, ranks rise
        i = np.searchsorted(-key, -(ln * (1 << 44) - rk), side="right") - 1
        j = rk - rows["rank"][i]
        each = rows["each"][i]
        return pd.DataFrame({"sequence_id": rows["bin"][i] + j // each, "offset": rows["offset"][i] + j % each * ln})

    ranked = cut.join(base, ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return ranked.select(*kept, F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
