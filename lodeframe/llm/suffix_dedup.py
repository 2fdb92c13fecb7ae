"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A suffix is a place with at least ``width`` bytes left in its document. Suffixes
are dealt into buckets by their anchor: the ``GRAM`` bytes of the first ``width``
with the smallest hash (the first of equal ones). Suffixes that share ``width``
bytes have the same anchor, and neighbours mostly do too, so a run of neighbours
with one anchor goes to its bucket as one string of bytes. Anchors are counted
first, and runs whose anchor occurs once in all documents stay where they are.
A bucket with over ``HEAVY`` bytes, as a phrase that many documents hold makes, is
split by a second anchor of more bytes, and so on (``levels``); the last has all
``width`` bytes, so its buckets hold one string each. Suffixes that share
``width`` bytes have equal anchors of all sizes, so they meet all the same.

Each task sorts its buckets one after another, some ``BUCKET`` bytes at a time,
by the bytes themselves. Of a bucket's text, the places whose number modulo v is
in a perfect difference set are the cover sample. It is ranked beforehand, by v
bytes, then 2 v, and so on. Suffixes then are sorted by v bytes, eight at a time.
Those that still tie are parted by a pivot of their group: for any two places p
and q some d < v puts both p + d and q + d in the sample, so two ranks settle
which is smaller, however long the tie. Neighbours in that order are compared
byte by byte, and those that share ``width`` bytes repeat. Equal strings of a
bucket are sorted once. Memory is that of one bucket: its different strings, of
``HEAVY`` bytes at most, and a few numbers for each run.

Matches never cross documents. A byte goes if a string of ``width`` bytes covers
it that also starts anywhere else, its own document included.

Cases: a null or empty text has 0 bytes; documents shorter than ``width`` keep
all; repeated rows are documents of their own, so both lose all their bytes if
long enough; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import chunk_table, rows
from .job import documents, tune, written
from .textops import U, arrow_bytes, eights, mix, spans

# A perfect difference set of 10 modulo 91, and one of 5 modulo 21 for narrow windows.
COVERS = {91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81), 21: (0, 1, 4, 14, 16)}
#: Bytes of an anchor, and of one in narrow windows.
GRAM, NARROW = 24, 8
#: Bytes of runs that are sorted at once.
BUCKET = 6 << 20
#: Bytes of a bucket's runs from which on it is split by longer anchors.
HEAVY = 6 << 20
#: Places whose anchors are found at once.
BLOCK = 1 << 16


def modulus(width: int) -> int:
    v = next((m for m in sorted(COVERS, reverse=True) if width > 2 * m - 2), None)
    if v is None:
        raise ValueError(f"width must be over {2 * min(COVERS) - 2}")
    return v


def meeting(v: int) -> np.ndarray:
    """(v, v): for places that leave i and j modulo v, the least d found that puts both in the cover sample."""
    at = np.zeros(v, np.int64)
    for x in COVERS[v]:
        for y in COVERS[v]:
            at[(y - x) % v] = x
    i = np.arange(v)
    return (at[(i[None] - i[:, None]) % v] - i[:, None]) % v


def levels(width: int) -> list[int]:
    """Bytes of the anchors by which buckets are split, one level after another."""
    first = GRAM if width >= 4 * GRAM else NARROW
    return sorted({first, *(x for x in (width * 12 // 25 // 8 * 8, width * 19 // 25 // 8 * 8) if x > first), width})


def _grams(eight: np.ndarray, at: np.ndarray | slice, gram: int) -> np.ndarray:
    """Hashes of the ``gram`` bytes, 8 or more, from each of the places ``at`` on."""
    h = U(0)
    for k, by in enumerate([*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]):
        there = slice(at.start + by, at.stop + by) if isinstance(at, slice) else at + by
        h = h + mix(eight[there] + U((k + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1))
    return mix(h)


def _held(sorted_keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted ones."""
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)] == key if len(sorted_keys) else np.zeros(len(key), bool)


def runs(buf: np.ndarray, off: np.ndarray, width: int, heavy: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, key, level): runs of neighbouring suffixes with one anchor, from place ``first`` to ``last``, and the anchor's hash. heavy: for each level the sorted keys whose runs the next level splits; a key of that level then stands for all anchors up to it."""
    size = np.diff(off)
    long = size >= width
    n = len(buf) - width + 1
    if n <= 0 or not long.any():
        return *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.int8)
    step = np.zeros(n + 1, np.int8)
    step[off[:-1][long]] += 1
    step[(off[1:] - width + 1)[long]] -= 1
    good = np.cumsum(step[:n], dtype=np.int8) > 0
    eight = eights(buf)
    change = np.ones(n + 1, bool)
    change[1:n] = ~good[:-1] | ~good[1:]
    key = level = None
    for k, gram in enumerate(levels(width)[: 1 + len(heavy)]):
        if k:  # only in what a heavy key holds
            split = np.zeros(len(first), bool)
            split[level == k - 1] = _held(heavy[k - 1], key[level == k - 1])
            if not split.any():
                break
        anchor = _anchors(eight, n, width, gram)
        if k == 0:
            change[1:n] |= anchor[1:] != anchor[:-1]
        else:
            inside = np.repeat(split, last - first + 1)
            place = np.repeat(first - np.concatenate([[0], np.cumsum(last - first + 1)[:-1]]), last - first + 1) + np.arange((last - first + 1).sum())
            place = place[inside]
            change[place[place > 0]] |= anchor[place[place > 0]] != anchor[place[place > 0] - 1]
            before, held = (key, level), (first, split)
        first, last = np.flatnonzero(change[:n] & good), np.flatnonzero(change[1:] & good)
        if k == 0:
            key, level = _grams(eight, anchor[first], gram).view(np.int64), np.zeros(len(first), np.int8)
        else:
            of = np.searchsorted(held[0], first, side="right") - 1  # the run that it is a part of
            key, level = before[0][of], before[1][of]
            new = held[1][of]
            key[new] = mix((key[new].view(np.uint64) ^ _grams(eight, anchor[first[new]], gram)) + U(k)).view(np.int64)
            level[new] = k
    return first, last, key, level


def _anchors(eight: np.ndarray, n: int, width: int, gram: int) -> np.ndarray:
    """The anchor of ``gram`` bytes of each of n suffixes: its place."""
    span = width - gram + 1
    anchor = np.empty(n, np.int32 if len(eight) <= 2**31 else np.int64)
    for a in range(0, n, BLOCK):  # in parts that a processor's cache holds
        m = min(BLOCK, n - a)
        k = m + span - 1
        # The smallest of each ``span`` hashes and the first place that has it: of blocks of that size, the least up to a place and the least from it on.
        low = np.full(-(-k // span) * span, 2**64 - 1, np.uint64)
        low[:k] = (_grams(eight, slice(a, a + k), gram) & U(0xFFFFFFFF00000000)) | np.arange(k, dtype=np.uint64)
        low = low.reshape(-1, span)
        upto = np.minimum.accumulate(low, axis=1).ravel()
        onward = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor[a : a + m] = (np.minimum(onward[:m], upto[span - 1 : span - 1 + m]) & U(0xFFFFFFFF)).astype(np.int64) + a
    return anchor


class Sorter:
    """Suffixes of strings text[off[i]:off[i+1]], compared up to the string's end, which is smaller than any byte."""

    def __init__(self, text: np.ndarray, off: np.ndarray, v: int):
        self.v, self.eight = v, eights(text).view(">u8")
        self.end = np.repeat(off[1:], np.diff(off))
        self.cover = np.zeros(v, bool)
        self.cover[list(COVERS[v])] = True
        self.meet = meeting(v)

    def _part(self, rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts groups of equal rank by ``key``; a rank is the number of suffixes in groups before. Returns the active ones in order, their keys and the sizes of their new groups."""
        old = rank[active]
        order = np.argsort(key)
        if old.any():
            dense = np.empty(len(key), np.int64)
            dense[order] = np.cumsum(np.append(False, key[order[1:]] != key[order[:-1]]))[: len(key)]
            order = np.argsort(old << 32 | dense)
        active, key, old = active[order], key[order], old[order]
        group, new = np.ones(len(old), bool), np.ones(len(old), bool)
        group[1:] = old[1:] != old[:-1]
        new[1:] = group[1:] | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(old)))
        head = np.flatnonzero(group)
        rank[active] = old + np.repeat(begin, size) - np.repeat(head, np.diff(np.append(head, len(old))))
        return active, key, np.repeat(size, size)

    def leading(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Ranks by the first ``depth`` bytes."""
        rank, left = np.zeros(len(at), np.int64), np.minimum(self.end[at] - at, depth)
        active = np.arange(len(at))
        for k in range(0, depth, 8):
            if len(active) < 2:
                return rank
            some = np.clip(left[active] - k, 0, 8)
            key = np.zeros(len(active), np.uint64)
            inside = np.flatnonzero(some)
            shift = U(8) * (8 - some[inside]).astype(np.uint64)
            key[inside] = self.eight[at[active[inside]] + k].astype(np.uint64) >> shift << shift
            active, _, size = self._part(rank, active, key)
            active = active[size > 1]
        self._part(rank, active, left[active])
        return rank

    def ranks(self) -> np.ndarray:
        """Of each place of the cover sample its rank among them, from 1; 0 elsewhere."""
        at = np.flatnonzero(self.cover[np.arange(len(self.end)) % self.v])
        rank, out = self.leading(at, self.v), np.zeros(len(self.end) + 1, np.int64)
        most, depth = int((self.end[at] - at).max(initial=0)), self.v
        while depth < most:
            out[at] = rank + 1
            then = np.where(at + depth < self.end[at], out[np.minimum(at + depth, len(self.end))], 0)
            self._part(rank, np.arange(len(at)), then)
            depth *= 2
        out[at] = rank + 1
        return out

    def order(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, lead): the suffixes ``at``, each of over v bytes, in order, and their ranks by v bytes."""
        lead = self.leading(at, self.v)
        rank, (_, group, size) = lead.copy(), np.unique(lead, return_inverse=True, return_counts=True)
        active = np.flatnonzero(size[group] > 1)
        if len(active):
            known, draw = self.ranks(), np.random.default_rng(len(at))
            active = active[np.argsort(rank[active], kind="stable")]
        while len(active):
            _, begin, group, size = np.unique(rank[active], return_index=True, return_inverse=True, return_counts=True)
            p, q = at[active], at[active[begin + draw.integers(size)]][group]
            d = self.meet[p % self.v, q % self.v]
            active, side, size = self._part(rank, active, np.sign(known[p + d] - known[q + d]))
            active = active[(side != 0) & (size > 1)]  # those like the pivot are equal to their ends
        return np.argsort(rank, kind="stable"), lead

    def repeats(self, at: np.ndarray, width: int) -> np.ndarray:
        """Which of the suffixes share ``width`` bytes with another."""
        order, lead = self.order(at)
        i = np.flatnonzero(lead[order[1:]] == lead[order[:-1]])
        a, b = at[order[i]], at[order[i + 1]]
        for k in [*range(self.v // 8 * 8, width - 8, 8), width - 8]:
            same = np.flatnonzero(self.eight[a + k] == self.eight[b + k])
            i, a, b = i[same], a[same], b[same]
        out = np.zeros(len(at), bool)
        out[order[i]] = out[order[i + 1]] = True
        return out


def repeated(strings: pa.Array, key: np.ndarray, times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(again, first): which suffixes of different strings occur twice, where string i has the suffixes first[i]:first[i+1] and occurs ``times`` times."""
    size = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64) - width + 1
    first = np.concatenate([[0], np.cumsum(size)])
    again = np.repeat(times > 1, size)
    _, group, many = np.unique(key, return_inverse=True, return_counts=True)
    two = np.flatnonzero(many[group] > 1)  # alone with its anchor a string has no repeat
    if len(two):
        text, off = arrow_bytes(strings.take(pa.array(two)))
        number = np.arange(size[two].sum()) - np.repeat(np.cumsum(size[two]) - size[two], size[two])
        found = Sorter(text, off, modulus(width)).repeats(np.repeat(off[:-1], size[two]) + number, width)
        again[np.repeat(first[two], size[two]) + number] |= found
    return again, first


def bucket_spans(table: pa.Table, strings: pa.Array, width: int) -> pa.RecordBatch:
    """chunk and spans (pairs of i32: from, to) of the bytes that go, of a bucket's runs (key, chunk, places, which), ``which`` being the number of a run's string."""
    used, which = np.unique(table.column("which").to_numpy(), return_inverse=True)
    strings = strings.take(pa.array(used))
    raw, off = arrow_bytes(table.column("places"))
    places, count = np.frombuffer(raw.tobytes(), "<i4").astype(np.int64), np.diff(off) // 4
    key = np.zeros(len(strings), np.int64)
    key[which] = table.column("key").to_numpy()
    again, first = repeated(strings, key, np.bincount(which, weights=count, minlength=len(strings)), width)
    begin, end, at = spans(again, first)
    row = np.repeat(np.arange(len(which)), count)  # of each place
    n = np.diff(at)[which[row]]
    i = np.repeat(at[which[row]] - np.cumsum(n) + n, n) + np.arange(n.sum())
    shift = np.repeat(places - first[which[row]], n)
    chunk = table.column("chunk").to_numpy()[np.repeat(row, n)]
    order = np.argsort(chunk, kind="stable")
    pair = np.stack([begin[i] + shift, end[i] - 1 + shift + width], axis=1)[order].astype("<i4")
    names, head = np.unique(chunk[order], return_index=True)
    return pa.RecordBatch.from_pydict({"chunk": pa.array(names, pa.int64()), "spans": pa.array([p.tobytes() for p in np.split(pair, head[1:])] if len(names) else [], pa.binary())})


def sort_buckets(batches: Iterator[pa.RecordBatch], width: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The answers to runs (key, chunk, places, data) that come in order of their keys: whole keys, some ``most`` bytes at once. Equal strings are held once, which bounds what a key that all documents share needs."""
    most = most or BUCKET
    table, strings, waiting, size = None, pa.array([], pa.binary()), [], 0

    def fold() -> tuple[pa.Table, pa.Array]:
        data = pa.concat_arrays([strings, *[b.column("data") for b in waiting]]).dictionary_encode()
        new = pa.Table.from_batches(waiting).drop_columns("data").append_column("which", data.indices[len(strings) :])
        return pa.concat_tables([table, new] if table is not None else [new]).combine_chunks(), data.dictionary

    for b in batches:
        if not len(b):
            continue
        waiting.append(b)
        size += b.nbytes
        if size < max(most, strings.nbytes):
            continue
        table, strings = fold()
        waiting, size = [], 0
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield bucket_spans(table.slice(0, cut), strings, width)
            table = table.slice(cut).combine_chunks()
            used, which = np.unique(table.column("which").to_numpy(), return_inverse=True)
            strings = strings.take(pa.array(used))
            table = table.set_column(3, "which", pa.array(which.astype(np.int32)))
    if waiting:
        table, strings = fold()
    if table is not None:
        yield bucket_spans(table, strings, width)


def removed_spans(chunks: DataFrame, width: int) -> DataFrame:
    """chunk and a list of spans of the bytes that go, written."""
    last_level = len(levels(width)) - 1

    def listed(b: pa.RecordBatch, i: int) -> list[np.ndarray]:
        """A chunk's heavy keys, level by level."""
        return [np.sort(b.column(f"heavy{k}")[i].values.to_numpy()) if b.column(f"heavy{k}")[i].is_valid else np.zeros(0, np.int64) for k in range(last_level) if f"heavy{k}" in b.schema.names]

    def anchors(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, row in enumerate(rows(b)):
                    first, last, key, at = runs(row["payload"], row["off"], width, listed(b, i))
                    own = at == level
                    key, which, times = np.unique(key[own], return_inverse=True, return_counts=True)
                    # Equal strings count once; their ends and lengths tell them apart well enough for a size.
                    eight, a, z = eights(row["payload"]), first[own], (last + width)[own]
                    print_ = mix(key[which].view(np.uint64) + mix(eight[a] + U(1)) + mix(eight[z - 8] + U(2)) + (z - a).astype(np.uint64) * U(0x9E3779B97F4A7C15))
                    one = np.unique(print_, return_index=True)[1]
                    size = np.bincount(which[one], weights=(z - a)[one], minlength=len(key)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"key": key, "chunk": np.full(len(key), row["chunk"]), "times": times, "size": size})

        return count

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(rows(b)):
                first, last, key, _ = runs(row["payload"], row["off"], width, listed(b, i))
                go = np.flatnonzero(_held(np.sort(b.column("keys")[i].values.to_numpy()), key))
                if not len(go):
                    continue
                raw = row["payload"].tobytes()
                data = pa.array([raw[x:y] for x, y in zip(first[go].tolist(), (last[go] + width).tolist(), strict=True)], pa.binary()).dictionary_encode()
                which = data.indices.to_numpy()
                order = np.argsort(which, kind="stable")
                head = np.searchsorted(which[order], np.arange(len(data.dictionary)))
                places = np.split(first[go][order].astype("<i4"), head[1:])
                yield pa.RecordBatch.from_pydict({"key": key[go][order[head]], "chunk": np.full(len(head), row["chunk"]), "places": pa.array([p.tobytes() for p in places], pa.binary()), "data": data.dictionary})

    wanted, source = None, chunks.select("chunk", "sizes", "payload")
    for level in range(last_level + 1):
        seen = source.mapInArrow(anchors(level), "key long, chunk long, times long, size long")
        same = Window.partitionBy("key")
        shared = seen.select("key", "chunk", F.sum("times").over(same).alias("n"), (F.sum("size").over(same) > HEAVY).alias("heavy") if level < last_level else F.lit(False).alias("heavy")).filter("n > 1")
        own = shared.groupBy("chunk").agg(F.collect_list(F.when(~F.col("heavy"), F.col("key"))).alias("keys"), F.collect_list(F.when(F.col("heavy"), F.col("key"))).alias(f"heavy{level}"))  # as many as the chunk has runs
        if wanted is not None:
            own = wanted.join(own.withColumnRenamed("keys", "more"), "chunk", "left").withColumn("keys", F.concat("keys", F.coalesce("more", F.array().cast("array<long>")))).drop("more")
        wanted = written(own, "keys")
        some = wanted.filter(F.size(F.coalesce(f"heavy{level}", F.array().cast("array<long>"))) > 0)
        if level == last_level or some.isEmpty():
            break
        source = chunks.join(some.select("chunk", *[f"heavy{k}" for k in range(level + 1)]).hint("shuffle_hash"), "chunk").select("chunk", "sizes", "payload", *[f"heavy{k}" for k in range(level + 1)])
    heavies = [c for c in wanted.columns if c.startswith("heavy")]
    sent = chunks.join(wanted.hint("shuffle_hash"), "chunk").select("chunk", "sizes", "payload", "keys", *heavies).mapInArrow(send, "key long, chunk long, places binary, data binary")
    found = sent.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: sort_buckets(batches, width), "chunk long, spans binary")
    return written(found.groupBy("chunk").agg(F.collect_list("spans").alias("spans")), "spans")


def dedup_suffixes(docs: DataFrame, width: int = 200, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document; with_text: its kept bytes as text, too (parts of characters are dropped)."""
    modulus(width)
    tune(docs.sparkSession)
    chunks = chunk_table(documents(docs, id_col, text_col))
    gone_spans = removed_spans(chunks, width)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(rows(b)):
                off, buf = row["off"], row["payload"]
                pair = np.frombuffer(b"".join(b.column("spans")[i].as_py() or []), "<i4").reshape(-1, 2)
                step = np.bincount(pair[:, 0], minlength=len(buf) + 1) - np.bincount(pair[:, 1], minlength=len(buf) + 1)
                gone = np.cumsum(step[: len(buf)]) > 0
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                start[off[:-1][off[:-1] < len(buf)]] |= gone[off[:-1][off[:-1] < len(buf)]]
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[off])
                n_removed = total(gone)
                raw, kept_at = buf[~gone].tobytes(), np.concatenate([[0], np.cumsum(np.diff(off) - n_removed)])
                kept = [raw[a:z] for a, z in zip(kept_at[:-1].tolist(), kept_at[1:].tolist(), strict=True)]
                columns = {"doc_id": row["doc_ids"], "n_bytes": np.diff(off), "n_removed": n_removed, "n_spans": total(start), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
                if with_text:
                    columns["text"] = [k.decode("utf-8", "ignore") for k in kept]
                yield pa.RecordBatch.from_pydict(columns)

    found = chunks.join(gone_spans.hint("shuffle_hash"), "chunk", "left").select("chunk", "doc_ids", "sizes", "payload", "spans")
    return found.mapInArrow(out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text)
