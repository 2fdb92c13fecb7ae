"""Token ids of many texts by the tokenizers library, each distinct stretch of text encoded once.

A byte-level BPE first splits a text into runs of letters, digits, other signs
and white space, and never merges across them. ``cuts`` finds places that are
surely such borders; between two cuts the ids don't depend on what is around.
So a batch's stretches are hashed, each new one goes through the tokenizers
library once, and the ids of the texts are gathered by numpy. A stretch takes the
ids of a remembered one only if their bytes are equal, too; others go through the
library. The ids equal those of encoding the whole texts (tests/llm/test_tokens.py).
"""

from __future__ import annotations

import os

import numpy as np

from .textops import SPACE, same_spans, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER, _DIGIT, _OTHER, _UNKNOWN = 1, 2, 3, 4
_CLASS = np.full(256, _UNKNOWN, np.uint8)
_CLASS[:128] = _OTHER
_CLASS[SPACE] = 0
_CLASS[28:32] = _UNKNOWN  # separators that count as white space in some libraries
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
#: Stretches whose ids a worker remembers.
REMEMBERED = 1 << 20
#: Stretches that the library encodes at once.
SLICE = 1 << 13


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the stretches: all documents' starts, and places within that are borders for certain."""
    n = len(buf)
    kind = _CLASS[buf]
    # Latin letters of two bytes: C3 80 to C3 BF but for the signs C3 97 and C3 B7.
    lead = np.flatnonzero(buf[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    kind[lead] = _LETTER
    kind[lead + 1] = _LETTER
    cut = np.zeros(n + 1, bool)
    if n > 1:
        before, here = kind[:-1], kind[1:]
        known = (before != 0) & (before != _UNKNOWN)
        cut[1:n] = known & (here != before) & (here != _UNKNOWN) & ((buf[:-1] != 0x27) | (here == 0))
    cut[off] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Encoder:
    """Ids by tokenizers' file ``path``, without special tokens added; one per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.raw_at, self.raw_length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.raw = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) by the library."""
        ids: list[list[int]] = []
        for a in range(0, len(texts), SLICE):  # the library's results are large
            ids += [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts[a : a + SLICE]], add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for row in ids for x in row), np.int32, int(length.sum())), length

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        flat, length = self._encode(texts)
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = lambda before, n: before + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        new = (keys, begin(len(self.ids), length), length, begin(len(self.raw), size), size)
        self.ids = np.concatenate([self.ids, flat])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(texts), np.uint8)])
        order = np.argsort(np.concatenate([self.keys, keys]))
        old = (self.keys, self.at, self.length, self.raw_at, self.raw_length)
        self.keys, self.at, self.length, self.raw_at, self.raw_length = (np.concatenate(x)[order] for x in zip(old, new, strict=True))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all documents and the n+1 offsets of the documents in them."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        raw = buf.tobytes()
        if any(s in raw for s in self.special):  # the library finds these before it splits a text
            each = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(off[:-1], off[1:], strict=True)]
            return np.array([x for row in each for x in row], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        starts = cuts(buf, off)
        ends = np.append(starts[1:], len(buf))
        distinct, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool) if not len(self.keys) else self.keys[np.minimum(known, len(self.keys) - 1)] != distinct
        if new.any():
            if len(self.keys) + new.sum() > REMEMBERED:
                self._forget()
                new[:] = True
            self._learn(distinct[new], [raw[starts[i] : ends[i]] for i in first[new]])
        slot = np.searchsorted(self.keys, distinct)[which]
        length, at, ids = self.length[slot], self.at[slot], self.ids
        known = self.raw_at[slot]
        other = np.flatnonzero(~same_spans((buf, starts, ends), (self.raw, known, known + self.raw_length[slot])))
        if len(other):  # stretches with another's hash
            own, n = self._encode([raw[starts[i] : ends[i]] for i in other])
            at[other], length[other] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, own])
        place = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=place[1:])
        source = np.arange(place[-1])
        source += np.repeat(at - place[:-1], length)
        return ids[source], place[np.searchsorted(starts, off)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each document."""
    n = len(first) - 1
    out = np.empty(len(ids) + n, np.int32)
    offsets = first + np.arange(n + 1)
    ends = np.zeros(len(out), bool)
    ends[offsets[1:] - 1] = True
    out[ends] = end
    out[~ends] = ids
    return out, offsets
