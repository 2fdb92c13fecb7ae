"""Features of every line of a batch of texts, worked out from running counts over its bytes."""

from __future__ import annotations

import numpy as np

from .textops import span_hashes, word_spans

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_stop = np.zeros(256, bool)
_stop[[*b".,;:"]] = True
_shout = np.zeros(256, bool)
_shout[[*b"!?"]] = True
_sign = np.zeros(256, bool)
_sign[33:127] = True
_sign &= ~(_letter | _digit | _stop | _shout)
_sign[[*b"'\"-()"]] = False
KINDS = (_letter, _upper, _digit, _stop, _shout, _sign)
N_FEATURES = 17


def line_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, first) of the lines that hold a word; lines first[d]:first[d+1] are document d's."""
    starts, ends, word_first = word_spans(buf, off)
    if not len(starts):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    edge[np.flatnonzero(buf == 10) + 1] = True
    edge[-1] = True
    begin = np.flatnonzero(edge)
    line = np.searchsorted(begin, starts, side="right") - 1  # of each word
    head = np.ones(len(line), bool)
    head[1:] = line[1:] != line[:-1]
    at = np.flatnonzero(head)  # first word of each line that has one
    last = np.append(at[1:], len(line)) - 1
    a, z = starts[at], ends[last]
    size = z - a
    words = last - at + 1
    first = np.searchsorted(at, word_first)

    def total(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return c[z] - c[a]

    counts = [total(k[buf]) for k in KINDS]
    letters = np.maximum(counts[0], 1)
    word_size = ends - starts
    short = np.add.reduceat((word_size <= 3).astype(np.int64), at)
    long = np.add.reduceat((word_size >= 14).astype(np.int64), at)
    hashes = span_hashes(buf, starts, ends)
    number = np.cumsum(head) - 1
    pair = np.unique((number.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
    distinct = np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=len(at))
    whole = np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(at, words).astype(np.uint64) + np.uint64(1)), at)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    key = np.unique((doc.astype(np.uint64) << np.uint64(40)) ^ (whole >> np.uint64(24)), return_inverse=True, return_counts=True)
    again = key[2][key[1]] > 1
    density = [c / size for c in counts]
    f = np.stack(
        [
            density[0],
            counts[1] / letters,
            density[2],
            density[3],
            density[4],
            density[5],
            np.minimum(1, counts[5] / words),
            np.minimum(1, counts[4] / words),
            np.minimum(1, counts[3] / words),
            short / words,
            long / words,
            np.log1p(words) / 5,
            distinct / words,
            (distinct < 0.7 * words).astype(float),
            again.astype(float),
            _stop[buf[z - 1]].astype(float),
            np.minimum(2, (size - words + 1) / words / 8),
        ],
        axis=1,
    ).astype(np.float32)
    return f, size, first


