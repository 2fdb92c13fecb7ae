"""Token-ID files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all documents, serves all blocks. A block of
``BLOCK`` ids is coded by ``LANES`` interleaved 64-bit states that put out
32-bit words; blocks don't depend on each other, so a batch's blocks are coded
and decoded side by side with numpy. A file's head has a checkpoint for each
block (its place, its number of ids, the crc32 of its words), so a reader can
start at any block and notices damage.

A container, little-endian: "LRNS", u32 version, u32 bits of the table, u64
ids, u32 blocks, then for each block u64 place of its words, u32 number of
words, u32 number of ids, u32 crc32; then the states (u64 each lane of each
block), then all words (u32). A dataset is a Parquet table of containers with
their documents (part, seq, doc_ids, n_tokens, data) and a table of the
frequencies (id, freq).

Cases: a null or empty text has the end id alone; repeated rows are written
each; null ids sort first; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, with_end
from .job import documents, shared_dir, tune
from .textops import arrow_bytes

BITS, BLOCK, LANES = 20, 1 << 14, 32
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIQI")
_POINT = np.dtype([("place", "<u8"), ("words", "<u4"), ("ids", "<u4"), ("crc", "<u4")])


class Table:
    """Frequencies of all ids, scaled to 2^BITS; every counted id keeps at least 1."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.int64), freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.place = np.zeros(int(self.ids.max(initial=0)) + 1, np.int32)
        self.place[self.ids] = np.arange(len(self.ids))
        self.slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq.astype(np.int64))

    @classmethod
    def of_counts(cls, ids: np.ndarray, count: np.ndarray) -> Table:
        order = np.argsort(ids)
        ids, count = ids[order], count[order].astype(np.float64)
        total = 1 << BITS
        if len(ids) > total // 2:
            raise ValueError("too many different ids for the table")
        spare = total - len(ids)
        share = count / max(1.0, count.sum()) * spare
        freq = 1 + np.floor(share).astype(np.int64)
        rest = total - int(freq.sum()) if len(ids) else 0
        freq[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]] += 1
        return cls(ids, freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """A container of the ids; their last block is padded with the first id of the table, which the number of ids undoes."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    symbol = np.zeros(blocks * BLOCK, np.int32)
    symbol[:n] = table.place[ids]
    steps = BLOCK // LANES
    symbol = symbol.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), _LOW, np.uint64)
    word = np.zeros((steps, blocks, LANES), np.uint32)
    out = np.zeros((steps, blocks, LANES), bool)
    limit = np.uint64(63 - BITS)
    for t in range(steps - 1, -1, -1):
        s = symbol[:, t]
        f = table.freq[s]
        full = x >= f << limit
        out[t] = full
        word[t] = x & np.uint64(0xFFFFFFFF)
        x = np.where(full, x >> np.uint64(32), x)
        q, r = np.divmod(x, f)
        x = (q << np.uint64(BITS)) + r + table.start[s]
    points = np.zeros(blocks, _POINT)
    streams, at = [], 0
    for b in range(blocks):
        w = word[:, b][out[:, b]].astype("<u4").tobytes()
        points[b] = (at, len(w) // 4, min(BLOCK, n - b * BLOCK), zlib.crc32(w))
        streams.append(w)
        at += len(w) // 4
    return _HEAD.pack(b"LRNS", 1, BITS, n, blocks) + points.tobytes() + x.astype("<u8").tobytes() + b"".join(streams)


def decode(data: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the blocks first..last-1 (all by default) of a container. Raises ValueError on damage."""
    magic, version, bits, _, blocks = _HEAD.unpack_from(data)
    if magic != b"LRNS" or version != 1 or bits != BITS:
        raise ValueError("not a container of this format")
    last = blocks if last is None else last
    points = np.frombuffer(data, _POINT, blocks, _HEAD.size)
    states = _HEAD.size + blocks * _POINT.itemsize
    words_at = states + blocks * LANES * 8
    x = np.frombuffer(data, "<u8", blocks * LANES, states).reshape(blocks, LANES)[first:last].astype(np.uint64)
    words = np.frombuffer(data, "<u4", int(points["words"].sum()), words_at)
    for p in points[first:last]:
        if zlib.crc32(words[int(p["place"]) : int(p["place"]) + int(p["words"])].tobytes()) != p["crc"]:
            raise ValueError("a block's checksum doesn't fit")
    k, steps = last - first, BLOCK // LANES
    symbol = np.empty((steps, k, LANES), np.int32)
    at = points["place"][first:last].astype(np.int64)
    words = np.append(words, np.uint32(0))
    mask = np.uint64((1 << BITS) - 1)
    for t in range(steps):
        slot = x & mask
        s = table.slot[slot.astype(np.int64)]
        symbol[t] = s
        x = table.freq[s] * (x >> np.uint64(BITS)) + slot - table.start[s]
        need = x < _LOW
        place = at[:, None] + np.cumsum(need, axis=1) - 1
        new = words[np.minimum(place, len(words) - 1)]
        x = np.where(need, x << np.uint64(32) | new, x)
        at += need.sum(axis=1)
    ids = table.ids[symbol.transpose(1, 0, 2).reshape(-1)]
    keep = np.concatenate([np.arange(b * BLOCK, b * BLOCK + int(p["ids"])) for b, p in enumerate(points[first:last])]) if k else np.zeros(0, np.int64)
    return ids[keep]


def token_rows(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Batches of documents in ascending order of ids: part, seq, doc_ids, n_tokens and the token ids as bytes (u16, or u32 for wide vocabularies)."""
    schema = "part int, seq int, doc_ids array<long>, n_tokens array<long>, wide boolean, tokens binary"

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, b in enumerate(batches):
            tokens, first = with_end(*encoder(path).encode(*arrow_bytes(b.column("text"))), end)
            wide = bool(len(tokens) and tokens.max() > 0xFFFF)
            n = len(b)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column("doc_id").cast(pa.int64())),
                    "n_tokens": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(np.diff(first))),
                    "wide": [wide],
                    "tokens": [tokens.astype("<u4" if wide else "<u2").tobytes()],
                }
            )

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(ids, schema)


def _tokens(row_tokens: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(row_tokens, "<u4" if wide else "<u2")


def write(docs: DataFrame, path: str, to: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the dataset ``to``: files/ and freq/; ids/ holds the plain ids that both come from."""
    spark = docs.sparkSession
    tune(spark)
    fine = {"compression": "zstd", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    token_rows(documents(docs, id_col, text_col), path, end).write.options(**fine).parquet(f"{to}/ids")
    plain = spark.read.parquet(f"{to}/ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for tokens, wide in zip(b.column("tokens").to_pylist(), b.column("wide").to_pylist(), strict=True):
                new = np.bincount(_tokens(tokens, wide), minlength=len(total))
                new[: len(total)] += total
                total = new
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used.astype(np.int32), "n": total[used]})

    counts = plain.select("tokens", "wide").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # a row for each id of the vocabulary that occurs
    table = Table.of_counts(found["id"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
    spark.createDataFrame(list(zip(table.ids.tolist(), table.freq.astype(np.int64).tolist(), strict=True)), "id int, freq int").coalesce(1).write.parquet(f"{to}/freq")
    shared = spark.sparkContext.broadcast((table.ids, table.freq))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(*shared.value)
        for b in batches:
            data = [encode(_tokens(tokens, wide), own) for tokens, wide in zip(b.column("tokens").to_pylist(), b.column("wide").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("part", "seq", "doc_ids", "n_tokens")] + [pa.array(data, pa.binary())], ["part", "seq", "doc_ids", "n_tokens", "data"])

    coded = plain.mapInArrow(code, "part int, seq int, doc_ids array<long>, n_tokens array<long>, data binary")
    coded.write.options(**fine | {"compression": "uncompressed"}).parquet(f"{to}/files")


def read(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a dataset, from its files alone."""
    tune(spark)
    freq = spark.read.parquet(f"{where}/freq").toPandas()  # as many rows as the vocabulary
    shared = spark.sparkContext.broadcast((freq["id"].to_numpy(np.int64), freq["freq"].to_numpy(np.int64)))
    files = spark.read.schema("part int, seq int, doc_ids array<long>, n_tokens array<long>, data binary").parquet(f"{where}/files")
    size = files.select("part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    within = size.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    parts = size.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = within.join(parts.select("part", "base"), "part").select("part", "seq", (F.coalesce("before", F.lit(0)) + F.coalesce("base", F.lit(0))).alias("base"))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(*shared.value)
        for b in batches:
            for i in range(len(b)):
                docs, n = b.column("doc_ids")[i].values, b.column("n_tokens")[i].values.to_numpy()
                raw = memoryview(decode(b.column("data")[i].as_py(), own).astype("<u4").tobytes())
                at = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"part": np.full(len(n), b.column("part")[i].as_py(), np.int32), "seq": np.full(len(n), b.column("seq")[i].as_py(), np.int32), "doc_id": docs, "start": at[:-1], "n_tokens": n, "ids_crc32": crc})

    rows = files.mapInArrow(out, "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a dataset in the shared folder and reads it back."""
    to = shared_dir(docs.sparkSession)
    write(docs, path, to, end, id_col, text_col)
    return read(docs.sparkSession, to)
