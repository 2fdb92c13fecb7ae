"""Removal of repeated word windows, found by level-wise doubling.

At the first level each run of 5 words is voted on (see ``exchange``): it goes
on if it occurs twice anywhere. A run of 10 words is a candidate only if both of
its halves went on, a run of 20 only if both of its halves did, and so on up to
``width`` (the first level is width halved while it is even and over 5), or until
no candidates are left. At the last level a window goes if its words also start
earlier: in a document with a smaller doc_id, or before it in the same one.

Words are ``[^\\x20\\x09-\\x0D]+``. Windows never cross documents and are judged
on the input. Hashes have 128 bits at the last level, which decides; the levels
before only choose candidates, by 64 bits at most.

Cases: a null or empty text has no words; documents shorter than a window keep
all; repeated rows are documents of their own, in order of (doc_id, text); null
ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import answers, chunk_table, distinct, rows, scale, vote
from .job import documents, tune
from .textops import covered, grams, span_hashes, word_spans


def levels(width: int) -> list[int]:
    out = [width]
    while out[0] > 5 and out[0] % 2 == 0:
        out.insert(0, out[0] // 2)
    return out


class Chunk:
    """The words of a chunk, and what the levels so far have left of it."""

    def __init__(self, row: dict, width: int, coarse: np.uint64):
        self.buf, self.row, self.width, self.coarse = row["payload"], row, width, coarse
        self.starts, self.ends, self.first = word_spans(self.buf, row["off"])
        self.words = span_hashes(self.buf, self.starts, self.ends)

    def candidates(self, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(places, hashes, second halves at the last level) of the candidates of level ``upto``, from the votes on those before."""
        n, steps = len(self.words), levels(self.width)
        count = np.diff(self.first)
        # Runs of the first level that lie in a document of at least ``width`` words.
        left = np.zeros(n + 1, bool)
        d = np.repeat(count, count)
        room = np.repeat(self.first[1:], count) - np.arange(n)  # words up to the document's end
        left[:n] = d >= self.width
        for k, size in enumerate(steps[: upto + 1]):
            at, last = np.flatnonzero(left[:n] & (room >= size)), k == len(steps) - 1
            h = grams(self.words, size)[at] if len(at) else np.zeros(0, np.uint64)
            if last:
                return at, h, grams(span_hashes(self.buf, self.starts, self.ends, salt=1), size)[at] if len(at) else h
            h &= self.coarse
            if k == upto:
                return at, h, None
            _, group, times = np.unique(h, return_inverse=True, return_counts=True)
            twice = (answers(self.row[f"bits{k}"], "elsewhere") | (times > 1))[group]
            left = np.zeros(n + size + 1, bool)
            left[at[twice]] = True
            left = np.append(left[:n] & left[size : n + size], False)
        raise ValueError(upto)


def _hashes(width: int, coarse: np.uint64, level: int):
    def sent(row: dict) -> tuple[np.ndarray, np.ndarray | None]:
        _, h, second = Chunk(row, width, coarse).candidates(level)
        one = distinct(h, second)[0]
        return h[one], None if second is None else second[one]

    return sent


def repeated(row: dict, width: int, coarse: np.uint64) -> tuple[Chunk, np.ndarray]:
    """The chunk and which of its words go."""
    c = Chunk(row, width, coarse)
    last = len(levels(width)) - 1
    at, h, second = c.candidates(last)
    one, group, _ = distinct(h, second)
    first = at[one]  # the order is stable: the earliest of each
    again = answers(row[f"bits{last}"], "earlier")[group] | (at > first[group]) if len(at) else np.zeros(0, bool)
    return c, covered(at[again], width, len(c.words))


def judged(docs: DataFrame, width: int) -> tuple[DataFrame, np.uint64]:
    """Chunks with the votes of all levels, and the mask of the levels before the last."""
    tune(docs.sparkSession)
    chunks = chunk_table(docs, in_order=True)
    (buckets, coarse), votes, names = scale(chunks), None, []
    for level in range(len(levels(width))):
        votes = vote(chunks, _hashes(width, coarse, level), buckets, names, votes)
        names = [*names, f"bits{level}"]
    return chunks.join(votes.hint("shuffle_hash"), "chunk", "left").select("chunk", "doc_ids", "sizes", "payload", *names), coarse


def dedup_windows(docs: DataFrame, width: int = 20, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document; with_text: its kept words joined by one space, too."""

    found, coarse = judged(documents(docs, id_col, text_col), width)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows(b):
                c, gone = repeated(row, width, coarse)
                keep = ~gone
                spaced = np.flatnonzero(keep)
                size = c.ends[spaced] - c.starts[spaced] + 1
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                joined = np.full(at[-1], 32, np.uint8)
                inside = np.arange(at[-1]) - np.repeat(at[:-1], size)
                letter = inside < np.repeat(size - 1, size)
                joined[letter] = c.buf[(inside + np.repeat(c.starts[spaced], size))[letter]]
                raw = joined.tobytes()
                kept = np.concatenate([[0], np.cumsum(keep)])[c.first]
                texts = [raw[a : max(a, z - 1)] for a, z in zip(at[kept[:-1]].tolist(), at[kept[1:]].tolist(), strict=True)]
                n = np.diff(c.first)
                columns = {"doc_id": row["doc_ids"], "n_words": n, "n_removed": n - np.diff(kept), "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts]}
                if with_text:
                    columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return found.mapInArrow(out, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
