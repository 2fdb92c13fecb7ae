"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another. The model of each reads which
words, and which beginnings of words, a text has, and the probabilities of all the
categories before it in the chain. For training, those probabilities are out of
fold: each labelled document's come from a model that was fitted without it.

The labels hold two marks, so the chain here is ``low_quality``, then ``toxic``.
``train`` takes any list of 0/1 columns. Labels of documents that are held out
(as in ``quality``) aren't learned.

Models are fitted on the driver, on at most ``SAMPLE`` labelled documents, each
on at most ``WORDS`` features. All documents are scored in tasks.

Cases: a null or empty text has no features, so it gets the models' biases; a
category that has one kind of label only gets its share; repeated rows are
scored each; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import documents, tune
from .quality import held_out, labelled_sample
from .textops import arrow_bytes, plain_words, span_hashes

SAMPLE, WORDS, FOLDS = 4000, 2048, 4
#: Bytes of the beginnings of words that count as features besides whole words.
BEGINNINGS = (5, 6, 7, 8)
CHAIN = ("low_quality", "toxic")


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the distinct 32-bit features of each document."""
    lower, starts, ends, first = plain_words(buf, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    keys = [span_hashes(lower, starts, ends) >> np.uint64(32)]
    docs = [doc]
    for n in BEGINNINGS:
        has = ends - starts >= n
        keys.append((span_hashes(lower, starts[has], starts[has] + n) + np.uint64(n)) >> np.uint64(32))
        docs.append(doc[has])
    pair = np.unique(np.concatenate(docs).astype(np.uint64) << np.uint64(32) | np.concatenate(keys))
    return (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(pair, np.arange(len(off), dtype=np.uint64) << np.uint64(32))


def informative(ids: np.ndarray, doc: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The features most tied to y=1 by the likelihood ratio, of those in at least 3 documents; sorted."""
    words, which = np.unique(ids, return_inverse=True)
    n = np.bincount(which, minlength=len(words)).astype(float)
    a = np.bincount(which, weights=y[doc], minlength=len(words))
    n1, total = y.sum(), float(len(y))
    with np.errstate(divide="ignore", invalid="ignore"):
        e = n * n1 / total
        part = lambda o, e: np.where(o > 0, o * np.log(o / e), 0.0)
        g = part(a, e) + part(n - a, n - e) + part(n1 - a, n1 - e) + part(total - n - n1 + a, total - n - n1 + e)
    g[(n < 3) | (a <= e)] = -1
    best = np.argsort(-g, kind="stable")[:most]
    return np.sort(words[best[g[best] > 2]])


@dataclass
class Linear:
    words: np.ndarray
    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def odds(self, ids: np.ndarray, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Log odds of each document, clipped to 12."""
        z = np.full(len(first) - 1, self.bias)
        if len(self.words) and len(ids):
            at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == ids)
            doc = np.searchsorted(first, hit, side="right") - 1
            z += np.bincount(doc, weights=self.weights[at[hit]], minlength=len(z))
        if extra.shape[1]:
            z += extra @ self.extra
        return np.clip(z, -12, 12)

    def probability(self, ids: np.ndarray, first: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.odds(ids, first, extra)))


def fit(ids: np.ndarray, first: np.ndarray, extra: np.ndarray, y: np.ndarray, rounds: int = 250) -> Linear:
    """Ridge-logistic model by gradient ascent with momentum (Adam)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(0, np.uint32), np.zeros(0), np.zeros(extra.shape[1]), bias)
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    words = informative(ids, doc, y, WORDS)
    at = np.minimum(np.searchsorted(words, ids), max(0, len(words) - 1))
    hit = words[at] == ids if len(words) else np.zeros(len(ids), bool)
    col, row = at[hit], doc[hit]
    k, e = len(words), extra.shape[1]
    theta = np.zeros(k + e + 1)
    theta[-1] = bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    ridge = np.concatenate([np.full(k, 0.1), np.full(e, 0.05), [0.0]])
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=theta[:k][col], minlength=len(y)) + extra @ theta[k : k + e] + theta[-1]
        r = y - 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        grad = np.concatenate([np.bincount(col, weights=r[row], minlength=k), extra.T @ r, [r.sum()]]) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Linear(words, theta[:k], theta[k : k + e], float(theta[-1]))


def chain(ids: np.ndarray, first: np.ndarray, labels: np.ndarray) -> list[Linear]:
    """A model for each column of labels; each is fitted with the out-of-fold probabilities of those before it."""
    n, models = len(labels), []
    fold = np.arange(n) % FOLDS
    extra = np.zeros((n, 0))
    doc = np.repeat(np.arange(n), np.diff(first))
    for j in range(labels.shape[1]):
        y, outside = labels[:, j].astype(float), np.zeros(n)
        for k in range(FOLDS if j < labels.shape[1] - 1 else 0):
            inn, out = fold != k, fold == k
            part = lambda mask: (ids[mask[doc]], np.concatenate([[0], np.cumsum(np.diff(first)[mask])]).astype(np.int64))
            outside[out] = fit(*part(inn), extra[inn], y[inn]).probability(*part(out), extra[out])
        models.append(fit(ids, first, extra, y))
        extra = np.column_stack([extra, outside])
    return models


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> list[Linear]:
    schema = f"doc_id long, n int, ids binary, {', '.join(f'`{c}` int' for c in categories)}"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, first = features(*arrow_bytes(b.column("text")))
            own = {"doc_id": b.column("doc_id").cast(pa.int64()), "n": np.diff(first).astype(np.int32), "ids": pa.array([ids[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())}
            yield pa.RecordBatch.from_pydict(own | {c: b.column(c).cast(pa.int32()) for c in categories})

    rows = labelled_sample(docs, labels, categories, sample, ~held_out(F.col("doc_id"))).mapInArrow(extract, schema).toPandas()
    rows = rows.sample(frac=1, random_state=7).sort_values("doc_id", kind="stable")
    ids = np.frombuffer(b"".join(rows["ids"]), np.uint32)
    first = np.concatenate([[0], np.cumsum(rows["n"].to_numpy(np.int64))]).astype(np.int64)
    return chain(ids, first, rows[categories].to_numpy())


def score(docs: DataFrame, models: list[Linear], categories: list[str], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, p_<category> of each category, and ``flagged``: whether the last reaches the threshold."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)  # at most WORDS weights each

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, first = features(*arrow_bytes(b.column("text")))
            extra = np.zeros((len(b), 0))
            for model in shared.value:
                extra = np.column_stack([extra, model.probability(ids, first, extra)])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64())} | {f"p_{c}": extra[:, j] for j, c in enumerate(categories)})

    scored = docs.select("doc_id", "text").mapInArrow(out, "doc_id long, " + ", ".join(f"`p_{c}` double" for c in categories))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *[f"p_{c}" for c in categories], (F.col(f"p_{categories[-1]}") >= threshold).cast("int").alias("flagged"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains the chain on the labels and scores all documents."""
    tune(docs.sparkSession)
    docs = documents(docs, id_col, text_col)
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return score(docs, train(docs, marks, list(CHAIN), sample), list(CHAIN), threshold)
