"""Chunks of whole documents, and votes on hashes between chunks.

``chunk_table`` writes the texts once as a bucketed table of chunks, each a row
with some 4 MB of whole documents. Later passes read it in place: only what a
pass has found out is shuffled, by chunk, to the chunks' buckets.

In a vote each chunk sends its distinct hashes, sorted: of 64 bits, or of 128 where
the vote decides and doesn't only choose candidates. They are dealt
by their leading bits into buckets, so a bucket holds one contiguous range of
the sorted order of all hashes, as packets of differences (a few bytes a hash).
Each bucket is sorted by itself, and each packet gets back two bits a hash:
whether another chunk has it, and whether a chunk before it has it. A hash that
every document repeats is sent once by each chunk, so no bucket gets hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import shared_dir, written
from .textops import U, arrow_bytes

#: Bytes of texts in a chunk; a longer document is a chunk of its own.
CHUNK = 4 << 20
#: Bytes of texts for each bucket of a vote, up to ``MANY`` buckets: packets are chunks times buckets, so more are made only where memory asks for them.
SHARE, MANY = 8 << 20, 4096
#: Bytes of texts for each bucket at most, at any size of the input: some 20 million words, at some 45 bytes each.
MOST_SHARE = 128 << 20

_CHUNKS = "chunk long, doc_ids array<long>, sizes array<long>, payload binary"


def chunk_table(docs: DataFrame, in_order: bool = False) -> DataFrame:
    """chunk, doc_ids, sizes and payload of ``docs`` (doc_id, text), bucketed by chunk. in_order: chunks ascend with doc_id, and documents within them."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if in_order:
        docs = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, sizes, texts, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([part << 24 | seq], pa.int64()),
                    "doc_ids": pa.array([[x for a in ids for x in a.to_pylist()]], pa.list_(pa.int64())),
                    "sizes": pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                    "payload": pa.array([b"".join(texts)], pa.binary()),
                }
            )

        for b in batches:
            buf, off = arrow_bytes(b.column("text"))
            a = 0
            while a < len(b):
                z = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK - held, side="right")) - 1)
                ids.append(b.column("doc_id").cast(pa.int64()).slice(a, z - a))
                sizes.append(np.diff(off[a : z + 1]))
                texts.append(buf[off[a] : off[z]].tobytes())
                held += len(texts[-1])
                if held >= CHUNK - (CHUNK >> 6) or z < len(b):
                    yield row()
                    ids, sizes, texts, held, seq = [], [], [], 0, seq + 1
                a = z
        if ids:
            yield row()

    name = f"chunks_{uuid.uuid4().hex}"
    out = docs.mapInArrow(collect, _CHUNKS).write.format("parquet").bucketBy(n, "chunk").option("path", f"{shared_dir(spark)}/{name}")
    out.options(**{"compression": "zstd", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}).saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name goes: the files are the table's own path
    return chunks


def scale(chunks: DataFrame) -> tuple[int, np.uint64]:
    """(buckets, mask) for a vote over the chunks. The mask keeps some 8 bits of a hash more than are needed to count the bytes: enough to choose candidates, which a later vote decides on."""
    total = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    kept = min(64, total.bit_length() + 8)
    return bucket_count(total), np.uint64(2**64 - 2 ** (64 - kept))


def bucket_count(total: int) -> int:
    """Buckets of a vote over so many bytes of texts: none gets more than ``MOST_SHARE`` bytes' hashes, so their number has no bound."""
    return max(16, min(MANY, total // SHARE), -(-total // MOST_SHARE))


def pack_sorted(h: np.ndarray) -> tuple[int, bytes]:
    """(bytes a difference, packed differences) of sorted hashes; the first difference is from 0."""
    d = np.diff(h, prepend=np.uint64(0))
    width = max(1, (int(d[1:].max(initial=0)).bit_length() + 7) // 8) if len(d) > 1 else 1
    return width, int(d[0]).to_bytes(8, "little") + d[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(width: int, data: bytes) -> np.ndarray:
    rest = np.frombuffer(data, np.uint8, offset=8).reshape(-1, width)
    d = np.zeros((len(rest) + 1, 8), np.uint8)
    d[0] = np.frombuffer(data, np.uint8, 8)
    d[1:, :width] = rest
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def distinct(h: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one, group, times): of the hashes in order, each once, a place; of each hash its number in that order, and of each number how often it comes."""
    order = np.argsort(h, kind="stable") if second is None else np.lexsort((second, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if second is not None:
        new[1:] |= second[order][1:] != second[order][:-1]
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group, np.bincount(group, minlength=int(new.sum()))


def packets(hashes: np.ndarray, buckets: int, second: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(bucket, width, data, second) of the sorted, distinct hashes; bucket b holds those from b/buckets of the range on."""
    edges = edge_hashes(buckets)
    at = np.searchsorted(hashes, edges)
    for b, (a, z) in enumerate(zip(at, np.append(at[1:], len(hashes)), strict=True)):
        if z > a:
            yield b, *pack_sorted(hashes[a:z]), b"" if second is None else second[a:z].astype("<u8").tobytes()


def edge_hashes(buckets: int) -> np.ndarray:
    """The first hash of each bucket: equal steps of the range, for any number of buckets."""
    b = np.arange(buckets, dtype=np.uint64)
    step, rest = divmod(2**64, buckets)
    return b * U(step % 2**64) + b * U(rest) // U(buckets)


def count_bucket(table: pa.Table) -> pa.Table:
    """Sorts one bucket. For each packet: bits ``elsewhere`` and ``earlier``, a bit a hash."""
    chunk = table.column("chunk").to_numpy()
    parts = [unpack_sorted(w, d) for w, d in zip(table.column("width").to_pylist(), table.column("data").to_pylist(), strict=True)]
    size = np.array([len(p) for p in parts])
    sender = np.repeat(np.argsort(np.argsort(chunk)).astype(np.int32), size)
    h = np.concatenate(parts)
    parts.clear()
    second = np.frombuffer(b"".join(table.column("second").to_pylist()), "<u8")
    order = np.lexsort((second, h)) if len(second) else np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    if len(second):
        new[1:] |= second[order[1:]] != second[order[:-1]]
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(s))) > 1
    lowest = np.minimum.reduceat(sender[order], begin)
    elsewhere, earlier = np.empty(len(s), bool), np.empty(len(s), bool)
    elsewhere[order] = many[group]
    earlier[order] = lowest[group] < sender[order]
    at = np.concatenate([[0], np.cumsum(size)])
    bits = lambda x: [np.packbits(x[a:z]).tobytes() for a, z in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"chunk": chunk, "bucket": table.column("bucket"), "n": size, "elsewhere": pa.array(bits(elsewhere), pa.binary()), "earlier": pa.array(bits(earlier), pa.binary())})


_PACKETS = "chunk long, bucket int, width int, data binary, second binary"
_BITS = "chunk long, bucket int, n long, elsewhere binary, earlier binary"


def vote(chunks: DataFrame, hashes: Callable[..., tuple[np.ndarray, np.ndarray | None]], buckets: int, columns: list[str], before: DataFrame | None = None) -> DataFrame:
    """What the other chunks say of each chunk's hashes: chunk and an array of (bucket, n, elsewhere, earlier), written.

    hashes(row) gives the sorted, distinct hashes of a chunk, a dict of ``columns`` of ``before`` joined to ``chunks``, and their second halves or None.
    """
    source = chunks if before is None else chunks.join(before.hint("shuffle_hash"), "chunk", "left")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows(b):
                h, second = hashes(row)
                found = list(packets(h, buckets, second))
                if found:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "chunk": pa.array([row["chunk"]] * len(found), pa.int64()),
                            "bucket": pa.array([f[0] for f in found], pa.int32()),
                            "width": pa.array([f[1] for f in found], pa.int32()),
                            "data": pa.array([f[2] for f in found], pa.binary()),
                            "second": pa.array([f[3] for f in found], pa.binary()),
                        }
                    )

    sent = source.select("chunk", "sizes", "payload", *columns).mapInArrow(send, _PACKETS)
    bits = sent.groupBy("bucket").applyInArrow(count_bucket, _BITS)
    name = f"bits{len(columns)}"
    gathered = bits.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "elsewhere", "earlier"))).alias(name))
    if before is not None:
        gathered = before.join(gathered, "chunk", "full")
    return written(gathered, "bits")


def rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The chunks of a batch; payload and sizes as numpy arrays, the votes as they came."""
    for i in range(len(batch)):
        row = {"chunk": batch.column("chunk")[i].as_py()}
        buf, _ = arrow_bytes(batch.column("payload").slice(i, 1))
        row["payload"] = buf
        row["off"] = np.concatenate([[0], np.cumsum(batch.column("sizes")[i].values.to_numpy(zero_copy_only=False))]).astype(np.int64)
        for name in batch.schema.names:
            if name.startswith("bits"):
                row[name] = batch.column(name)[i].as_py()
            elif name == "doc_ids":
                row[name] = batch.column(name)[i].values
        yield row


def answers(votes: list[dict] | None, which: str) -> np.ndarray:
    """The bits of a chunk's sorted, distinct hashes, in their order."""
    if not votes:
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(v[which], np.uint8), count=v["n"]).astype(bool) for v in votes])
