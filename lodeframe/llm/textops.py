"""Vectorised byte and word arithmetic over one Arrow batch of texts.

Every helper works on a whole batch at once with numpy: ``buf`` is the
concatenated UTF-8 of the texts, ``off`` the n+1 offsets of the documents in it.
Nulls count as empty texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: The white space that separates words: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(buf, off) of an Arrow string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes hashes in place, so that all their bits are even."""
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on, little-endian, as if zeros followed buf."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


#: Keeps the first n bytes of eight.
_FIRST = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
_STEP, _SIZE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def _words(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, number, first): each string in words of eight bytes, the last filled with zeros; string i's are first[i] on, numbered from 0."""
    wide = (lens + 7) >> 3
    first = np.zeros(len(wide), np.int64)
    np.cumsum(wide[:-1], out=first[1:])
    number = np.arange(first[-1] + wide[-1]) - np.repeat(first, wide)
    left = np.repeat(lens, wide) - 8 * number
    return eights(buf)[np.repeat(starts, wide) + 8 * number] & _FIRST[np.minimum(left, 8)], number, first


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of the byte strings buf[starts:ends], which aren't empty. Each eight bytes are mixed with their place before they are added up, so no sum of powers can vanish."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    x, number, first = _words(buf, starts, lens)
    x += (number + (salt << 40) + 1).astype(np.uint64) * _STEP
    h = np.add.reduceat(mix(x), first)
    h += lens.astype(np.uint64) * _SIZE
    return mix(h)


def same_spans(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the i-th strings of two sides (buf, starts, ends) are equal byte for byte; none is empty."""
    lens = a[2] - a[1]
    same = lens == b[2] - b[1]
    i = np.flatnonzero(same)
    if len(i):
        x, _, first = _words(a[0], a[1][i], lens[i])
        y, _, _ = _words(b[0], b[1][i], lens[i])
        same[i] = np.logical_and.reduceat(x == y, first)
    return same


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, which): a place of each distinct byte string buf[starts:ends], none of which is empty, and for each place the number of its string."""
    _, one, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    other = np.flatnonzero(~same_spans((buf, starts, ends), (buf, starts[one][which], ends[one][which])))
    more: dict[bytes, tuple[int, int]] = {}
    for i in other.tolist():  # strings with another's hash
        which[i] = more.setdefault(buf[starts[i] : ends[i]].tobytes(), (len(one) + len(more), i))[0]
    return np.append(one, [i for _, i in more.values()]).astype(np.int64), which


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the runs of bytes that are ``inside``, cut at documents' borders; runs first[d]:first[d+1] are document d's."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all documents."""
    return spans(~SPACE[buf], off)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NAME = np.zeros(256, bool)
_NAME[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def plain_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower, starts, ends, first): runs of letters and digits, A to Z as small letters in ``lower``."""
    return _LOWER[buf], *spans(_NAME[buf], off)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, from the words' hashes; runs may cross documents."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    c = U(0xFF51AFD7ED558CCD)
    h = words[:m].copy()
    for j in range(1, n):
        h *= c
        h += words[j : j + m]
    return mix(h)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each word (or byte), from the n+1 offsets."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for one of ``starts``."""
    d = np.zeros(n + 1, np.int32)
    if len(starts):
        d[: n + 1] += np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int32)
        d[: n + 1] -= np.bincount(np.minimum(starts + width, n), minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(d[:n]) > 0
