"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A to Z as small letters. Every 3-gram of
the test items is a seed, so that edited copies, which have lost some, are found.
Where a seed occurs in a document, the words around it, if enough of them are
words of the item for a score of ``MIN_SCORE``, are aligned with the item by
Smith-Waterman on words (match 2, mismatch -1, gap -1), and the best score is
divided by that of a perfect copy, so edited and paraphrased copies are found and
measured, too. Pairs from ``MIN_SCORE`` on are contaminated. Every pair with such a
score that shares three words in a row with its item is found, with its full score;
one that shares no three, as where every third word is another, isn't.

A rare seed is joined with all its items. For a seed of over ``HOT`` items, as in
a preamble that many share, the rare words decide, without loss: a score of s
matches at least a share s of the item's words, so at least one of its rarest
words is among them, if they are more than a share of 1 - s. Only items that have
such a word in the document are joined. Items of equal texts are one item.

The items are the query set. They go through in blocks of at most ``BLOCK``
items and ``BLOCK_BYTES`` bytes, each block's n-grams and words being what is
broadcast; a longer item is a block of its own.

Cases: null and empty texts, and items of fewer than 3 words, match nothing;
repeated documents and items are matched each; null ids are kept; a document
that holds an item twice is one row with its best place (the first among equal
ones); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import documents, tune
from .textops import arrow_bytes, grams, plain_words, span_hashes

N, MIN_SCORE, BLOCK = 3, 0.5, 20_000
MATCH, MISS, GAP = 2, -1, -1
#: Items of a seed that are all joined with the documents that have it.
HOT = 64
#: Bytes of the texts of a block.
BLOCK_BYTES = 8 << 20
_CELLS = 1 << 19
#: Joined rows that are worked on at once.
_WORK = 1 << 20


class Batch:
    """Words of a batch of documents, and their n-grams that don't cross documents."""

    def __init__(self, column):
        buf, off = arrow_bytes(column)
        self.off = off
        lower, self.starts, self.ends, self.first = plain_words(buf, off)
        self.words = span_hashes(lower, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.grams = grams(self.words, N)
        self.whole = self.doc[: len(self.grams)] == self.doc[N - 1 :] if len(self.grams) else np.zeros(0, bool)

    def hits(self, known: Known) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of the n-grams that are known."""
        at = np.flatnonzero(known.maybe(self.grams) & self.whole)
        i = np.minimum(np.searchsorted(known.grams, self.grams[at]), max(0, len(known.grams) - 1))
        ok = known.grams[i] == self.grams[at] if len(known.grams) else np.zeros(0, bool)
        return at[ok], i[ok]


class Known:
    """A sorted array of hashes with a table of bits in front."""

    def __init__(self, hashes: np.ndarray):
        self.grams = np.unique(hashes)
        self.shift = np.uint64(64 - max(16, min(26, int(len(self.grams)).bit_length() + 5)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self.grams >> self.shift] = True

    def maybe(self, h: np.ndarray) -> np.ndarray:
        return self.bits[(h >> self.shift).astype(np.int64)]


def _listed(owner: np.ndarray, n: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, *values): the values in order of their owners; those of owner i are first[i]:first[i+1]."""
    order = np.argsort(owner, kind="stable")
    return np.searchsorted(owner[order], np.arange(n + 1)), *[v[order] for v in values]


def _expanded(first: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): each row with a key, as often as the key has places in a list."""
    n = first[key + 1] - first[key]
    return np.repeat(np.arange(len(key)), n), np.repeat(first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())


class Items:
    """The words of a block of different test items, their n-grams as seeds, and the rare words of items with seeds that many share. ids: a list for each item, of all that have its text."""

    def __init__(self, ids: list[list], texts: list, min_score: float = MIN_SCORE):
        b = Batch(pa.array(texts, pa.string()))
        self.ids, self.words, self.first = ids, b.words, b.first
        self.at = np.flatnonzero(b.whole)
        self.known = Known(b.grams[self.at])
        gram = np.searchsorted(self.known.grams, b.grams[self.at])
        item = b.doc[self.at]
        place = self.at - b.first[item]
        self.post_first, self.post_item, self.post_place = _listed(gram, len(self.known.grams), item, place)
        self.hot = np.diff(self.post_first) > HOT
        own = self.hot[gram]
        self.hot_first, self.hot_gram, self.hot_place = _listed(item[own], len(ids), gram[own], place[own])
        # Of each item with hot seeds: so many of its rarest words that an alignment must match one of them.
        names, number = np.unique(b.words, return_inverse=True)
        pair = np.unique(b.doc * max(1, len(names)) + number)
        items_of = np.bincount(pair % max(1, len(names)), minlength=len(names))
        order = np.lexsort((number, items_of[number], b.doc))
        size = np.diff(b.first)[b.doc]
        rank = np.arange(len(order)) - b.first[b.doc[order]]
        rare = order[(rank <= size - np.ceil(min_score * size - 1e-9)) & (np.diff(self.hot_first)[b.doc[order]] > 0)]
        pair = np.unique(number[rare] * max(1, len(ids)) + b.doc[rare])
        used, which = np.unique(pair // max(1, len(ids)), return_inverse=True)
        self.rare = names[used]
        self.rare_first, self.rare_item = _listed(which, len(used), pair % max(1, len(ids)))


def joined(b: Batch, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, item, diagonal) of the seeds' occurrences, some documents at a time."""
    at, seed = b.hits(items.known)
    hot = items.hot[seed]
    n, m = len(b.off) - 1, max(1, len(items.ids))
    doc = b.doc[at]
    cold_at, cold_seed, cold_doc = at[~hot], seed[~hot], doc[~hot]
    grams = len(items.known.grams)
    key = doc[hot] * grams + seed[hot]
    hot_at = at[hot][np.argsort(key, kind="stable")]
    key = np.sort(key)
    has = np.zeros(n + 1, bool)
    has[doc[hot]] = True
    word = np.flatnonzero(has[b.doc]) if len(items.rare) else np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(items.rare, b.words[word]), max(0, len(items.rare) - 1))
    ok = items.rare[i] == b.words[word] if len(word) else np.zeros(0, bool)
    some = np.unique(b.doc[word[ok]] * max(1, len(items.rare)) + i[ok])
    some_doc, some_word = some // max(1, len(items.rare)), some % max(1, len(items.rare))
    work = np.bincount(cold_doc, weights=np.diff(items.post_first)[cold_seed], minlength=n) + np.bincount(some_doc, weights=np.diff(items.rare_first)[some_word], minlength=n)
    total, lo = np.concatenate([[0], np.cumsum(work)]), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _WORK, side="right")) - 1)
        cut = slice(*np.searchsorted(cold_doc, [lo, hi]))
        row, j = _expanded(items.post_first, cold_seed[cut])
        parts = [(cold_doc[cut][row], items.post_item[j], cold_at[cut][row] - items.post_place[j])]
        cut = slice(*np.searchsorted(some_doc, [lo, hi]))
        row, j = _expanded(items.rare_first, some_word[cut])
        pair = np.unique(some_doc[cut][row] * m + items.rare_item[j])
        row, j = _expanded(items.hot_first, pair % m)  # the item's hot seeds
        wanted = (pair // m)[row] * grams + items.hot_gram[j]
        a, z = np.searchsorted(key, wanted), np.searchsorted(key, wanted, side="right")
        each = np.repeat(np.arange(len(a)), z - a)
        place = hot_at[np.repeat(a - np.cumsum(z - a) + (z - a), z - a) + np.arange((z - a).sum())]
        parts.append(((pair // m)[row][each], (pair % m)[row][each], place - items.hot_place[j][each]))
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        lo = hi


def windows(b: Batch, items: Items, doc: np.ndarray, item: np.ndarray, diagonal: np.ndarray, min_score: float = MIN_SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, item, from, to): stretches of words around the seeds' occurrences, one for each run of occurrences on nearby diagonals.

    An alignment that scores ``min_score`` has at most so many gaps that its points
    are worth more than they cost; by so many diagonals it can leave a seed's. No
    stretch is cut where a gap of that size may lie, nor at its ends.
    """
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    size = np.diff(items.first)[item]
    reach = np.floor(MATCH * size * (1 - min_score) / -GAP + 1e-9).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > reach[1:])
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(doc)) - 1 if len(i) else i
    slack = reach[i]
    lo = np.maximum(b.first[doc[i]], diagonal[i] - slack)
    hi = np.minimum(b.first[doc[i] + 1], diagonal[last] + size[i] + slack)
    return doc[i], item[i], lo, hi


def align(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, items: Items, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, from, to) of the best local alignment of each stretch with its item; all of a slab of stretches advance together, an item's word at a time."""
    n = len(lo)
    score, begin, end = np.zeros(n, np.int64), lo.copy(), lo.copy()
    order = np.lexsort((hi - lo, np.diff(items.first)[item]))
    a = 0
    while a < n:
        z = a + 1
        width, rows = int((hi - lo)[order[a]]), 0
        while z < n and (z - a + 1) * max(width, int((hi - lo)[order[z]])) <= _CELLS:
            width = max(width, int((hi - lo)[order[z]]))
            z += 1
        i = order[a:z]
        a = z
        size = np.diff(items.first)[item[i]]
        rows, k = int(size.max()), len(i)
        column = np.arange(width)
        inside = column[None] < (hi - lo)[i][:, None]
        text = words[np.minimum(lo[i][:, None] + column, len(words) - 1)]
        h, origin = np.zeros((k, width + 1), np.int64), np.tile(np.arange(width + 1), (k, 1))
        best, best_to, best_from = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for r in range(rows):
            live = r < size
            word = items.words[np.minimum(items.first[item[i]] + r, len(items.words) - 1)]
            diagonal = h[:, :-1] + np.where((text == word[:, None]) & inside & live[:, None], MATCH, MISS)
            start = np.where(h[:, :-1] > 0, origin[:, :-1], column)
            up = h[:, 1:] + GAP
            better = up > diagonal
            cell = np.maximum(np.where(better, up, diagonal), 0)
            start = np.where(better, origin[:, 1:], start)
            # A gap in the item: the best cell to the left, less a point a step.
            key = np.maximum.accumulate((cell - GAP * column) * (width + 1) + column, axis=1)
            source = key % (width + 1)
            left = key // (width + 1) + GAP * column
            cell = np.where(live[:, None], np.maximum(left, 0), 0)
            h = np.concatenate([np.zeros((k, 1), np.int64), cell], axis=1)
            origin = np.concatenate([np.zeros((k, 1), np.int64), np.take_along_axis(start, source, axis=1)], axis=1)
            top = cell.argmax(axis=1)
            value = cell[np.arange(k), top]
            won = value > best
            best = np.where(won, value, best)
            best_to = np.where(won, top + 1, best_to)
            best_from = np.where(won, origin[np.arange(k), top + 1], best_from)
        score[i], begin[i], end[i] = best, lo[i] + best_from, lo[i] + best_to
    return score, begin, end


def reachable(b: Batch, items: Items, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, min_score: float) -> np.ndarray:
    """Which stretches have as many words of their item as ``min_score`` needs: a score is at most MATCH for each of them."""
    names = np.unique(items.words)
    number = np.searchsorted(names, items.words)
    owner = np.repeat(np.arange(len(items.ids)), np.diff(items.first))
    own = np.unique(owner * len(names) + number)
    at = np.minimum(np.searchsorted(names, b.words), max(0, len(names) - 1))
    known = names[at] == b.words if len(names) else np.zeros(len(b.words), bool)
    before = np.concatenate([[0], np.cumsum(known)])
    size = np.diff(items.first)[item]
    good = before[hi] - before[lo] >= min_score * size - 1e-9
    left, at_known = np.flatnonzero(good), np.flatnonzero(known)
    for k in range(0, len(left), 4096):  # the words of some stretches at a time
        i = left[k : k + 4096]
        n = before[hi[i]] - before[lo[i]]
        stretch = np.repeat(np.arange(len(i)), n)
        place = at_known[np.repeat(before[lo[i]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        key = item[i][stretch] * len(names) + at[place]
        hit = own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key
        good[i] = np.bincount(stretch[hit], minlength=len(i)) >= min_score * size[i] - 1e-9
    return good


_PAIRS = "doc_id long, item_id long, score double, begin_byte long, end_byte long"


def _prepare(docs: DataFrame, items: Items):
    """The items as a broadcast."""
    return docs.sparkSession.sparkContext.broadcast(items)


def matches(batch: Batch, own: Items, min_score: float) -> pd.DataFrame:
    """doc, item, score, begin and end (words) of a batch's pairs."""
    parts = []
    for found in joined(batch, own):
        doc, item, lo, hi = windows(batch, own, *found, min_score)
        keep = reachable(batch, own, item, lo, hi, min_score)
        doc, item, lo, hi = doc[keep], item[keep], lo[keep], hi[keep]
        score, begin, end = align(batch.words, lo, hi, own, item)
        rows = pd.DataFrame({"doc": doc, "item": item, "score": score / (MATCH * np.maximum(np.diff(own.first)[item], 1)), "begin": begin, "end": end})
        parts.append(rows[rows["score"] >= min_score])
    rows = pd.concat(parts) if parts else pd.DataFrame({"doc": [], "item": [], "score": [], "begin": [], "end": []})
    return rows.sort_values(["doc", "item", "score", "begin"], ascending=[True, True, False, True]).drop_duplicates(["doc", "item"])


def _pairs(docs: DataFrame, items: Items, min_score: float) -> DataFrame:
    shared = _prepare(docs, items)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            batch = Batch(b.column("text"))
            rows = matches(batch, own, min_score)
            each = np.repeat(np.arange(len(rows)), [len(own.ids[j]) for j in rows["item"].astype(int)])
            rows, named = rows.iloc[each], [x for j in rows["item"].astype(int) for x in own.ids[j]]
            d = rows["doc"].to_numpy(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id").cast(pa.int64()).take(pa.array(d)),
                    "item_id": pa.array(named, pa.int64()),
                    "score": rows["score"].to_numpy(float),
                    "begin_byte": batch.starts[rows["begin"].to_numpy(np.int64)] - batch.off[d],
                    "end_byte": batch.ends[rows["end"].to_numpy(np.int64) - 1] - batch.off[d],
                }
            )

    return docs.mapInArrow(match, _PAIRS)


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, min_score: float) -> Iterator[Items]:
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    texts = items.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("item_id"))).alias("ids"))  # nulls, too
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK), -(-size // BLOCK_BYTES))
    for k in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("text").collect()  # one block
        part = Items([[i["item_id"] for i in r["ids"]] for r in rows], [r["text"] for r in rows], min_score)
        if len(part.at):
            yield part


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score (0 to 1) and the place in the text (bytes) of every pair of a document and a test item it holds."""
    tune(docs.sparkSession)
    docs = documents(docs, id_col, text_col)
    out = None
    for part in _blocks(benchmark, item_col, item_text_col, min_score):
        found = _pairs(docs, part, min_score)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], _PAIRS)


def clean(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns are kept, and nothing is shuffled."""
    tune(docs.sparkSession)
    texts, out = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")), docs
    for part in _blocks(benchmark, item_col, item_text_col, min_score):
        shared = _prepare(texts, part)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = np.ones(len(b), bool)
                good[matches(Batch(b.column(text_col)), shared.value, min_score)["doc"].to_numpy(np.int64)] = False
                yield b.filter(pa.array(good))

        out = out.mapInArrow(keep, docs.schema)
    return out
