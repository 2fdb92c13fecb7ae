"""Greedy longest-match word-piece counts by a linear automaton.

The vocabulary's trie gets a failure link for each node: where to go on when no
child fits, with the number of pieces that are popped on the way worked out
beforehand. So each byte of a word is read once and no piece is ever built. All
distinct words of a batch go through the automaton side by side, one byte of
each at a time; words of over ``LONG`` bytes go through it one after another, in
a time that is linear in their length.

A word is ``[^\\x20\\x09-\\x0D]+``, matched with one space before it. All single
bytes must be in the vocabulary, as they are in byte-level ones.

Cases: null and empty texts have 0 words and 0 tokens; repeated rows are
counted each; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .job import documents, tune
from .textops import arrow_bytes, same_spans, span_hashes, word_spans


#: Bytes of the longest words that advance side by side.
LONG = 256


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    def __init__(self, vocabulary: list[bytes]):
        child, token, depth = {}, [False], [(0, 0)]
        for word in vocabulary:
            at = 0
            for c in word:
                at = child.setdefault(at << 8 | c, len(token))
                if at == len(token):
                    token.append(False)
                    depth.append((0, 0))
            token[at] = bool(word)
        if missing := [c for c in range(256) if c not in child or not token[child[c]]]:
            raise ValueError(f"single bytes not in the vocabulary: {missing[:5]}")
        self.fail, self.popped = np.zeros(len(token), np.int32), np.zeros(len(token), np.int32)
        fail, popped = self.fail.tolist(), self.popped.tolist()
        children: dict[int, list[tuple[int, int]]] = {}
        for key, v in child.items():
            children.setdefault(key >> 8, []).append((key & 255, v))
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in children.get(u, ()):
                    below.append(v)
                    if token[v]:
                        fail[v], popped[v] = 0, 1
                        continue
                    z, n = fail[u], popped[u]
                    while z << 8 | c not in child:  # the root has a child for every byte
                        z, n = fail[z], n + popped[z]
                    fail[v], popped[v] = child[z << 8 | c], n
            level = below
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        self.edge = np.array(sorted(child), np.int64)
        self.to = np.array([child[k] for k in self.edge.tolist()], np.int32)
        self._plain: tuple | None = None

    def count(self, word: bytes) -> int:
        """Number of pieces of one word, a step a byte."""
        if self._plain is None:
            self._plain = dict(zip(self.edge.tolist(), self.to.tolist(), strict=True)), self.fail.tolist(), self.popped.tolist()
        child, fail, popped = self._plain
        at = n = 0
        for c in word:
            while (to := child.get(at << 8 | c)) is None:
                n += popped[at]
                at = fail[at]
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n

    def counts(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of pieces of " " + buf[starts:ends]."""
        n = len(starts)
        long = ends - starts > LONG
        if long.any():
            out = np.empty(n, np.int64)
            out[~long] = self.counts(buf, starts[~long], ends[~long])
            out[long] = [self.count(b" " + buf[a:z].tobytes()) for a, z in zip(starts[long], ends[long], strict=True)]
            return out
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still going are a prefix
        begin, size = starts[order], (ends - starts)[order]
        state, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        going = n
        for t in range(int(size[0]) + 1 if n else 0):
            going = n if t == 0 else int(np.searchsorted(-size, -t, side="right"))
            byte = np.full(going, 32) if t == 0 else buf[begin[:going] + t - 1].astype(np.int64)
            todo = np.arange(going)
            while len(todo):
                key = state[todo] << 8 | byte[todo]
                i = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                found = self.edge[i] == key
                state[todo[found]] = self.to[i[found]]
                todo = todo[~found]
                count[todo] += self.popped[state[todo]]
                state[todo] = self.fail[state[todo]]
        while len(todo := np.flatnonzero(state)):
            count[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
        out = np.empty(n, np.int64)
        out[order] = count
        return out


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every text. The automaton's size is that of the vocabulary file; it is broadcast."""
    spark = docs.sparkSession
    tune(spark)
    automaton = spark.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = arrow_bytes(b.column("text"))
            starts, ends, first = word_spans(buf, off)
            _, one, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
            n = automaton.value.counts(buf, starts[one], ends[one])[which]
            other = np.flatnonzero(~same_spans((buf, starts, ends), (buf, starts[one][which], ends[one][which])))
            n[other] = automaton.value.counts(buf, starts[other], ends[other])  # words with another's hash
            total = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "n_words": np.diff(first), "n_tokens": np.diff(total[first])})

    return documents(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
