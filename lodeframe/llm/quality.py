"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad; its score comes from its own features and those of the
lines beside it, and two lines in a row have a weight for each pair of labels.
Forward-backward gives each line's probability of being good, a document's is
their mean weighted by length, and a logistic curve fitted on the same rows
turns that into the score.

The field is fitted on the driver, on at most ``SAMPLE`` labelled documents
(those with the smallest hashes of their ids), whose lines take their document's
label. Everything else runs over all rows in tasks.

Cases: a null or empty text has no line, and its score is the share of good
documents in the sample; without labels of both kinds all scores are that share
(0.5 if there are none); repeated rows are scored each; null ids are kept, and
not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .job import documents, tune
from .lines import N_FEATURES, line_features
from .textops import arrow_bytes

#: Labelled documents that the fit takes at most.
SAMPLE = 3000
#: Lines of a document from which on forward-backward goes by doubling.
LONG = 512


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def neighbours(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, the line before and the line after, and whether those exist."""
    n = len(f)
    out = np.zeros((n, 3 * N_FEATURES + 3), np.float32)
    if not n:
        return out
    has = np.ones(n + 1, bool)
    has[first] = False
    before, after = has[:n].copy(), np.append(has[1:n], False)
    out[:, :N_FEATURES] = f
    out[1:, N_FEATURES : 2 * N_FEATURES] = f[:-1] * before[1:, None]
    out[:-1, 2 * N_FEATURES : 3 * N_FEATURES] = f[1:] * after[:-1, None]
    out[:, -3], out[:, -2], out[:, -1] = 1, before, after
    return out


def scan(psi: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors of one long document: products of all its steps' matrices by doubling, so the number of numpy calls is the logarithm of its lines."""
    step = m[None] * psi[:, None, :]
    ahead, back = step.copy(), step.copy()
    ahead[0] = np.diag(psi[0])
    back[:-1], back[-1] = step[1:], np.eye(2)
    k, unit = 1, lambda x: x / x.sum(axis=(1, 2), keepdims=True)
    while k < len(psi):
        ahead[k:] = unit(ahead[:-k] @ ahead[k:])
        back[:-k] = unit(back[:-k] @ back[k:])
        k *= 2
    alpha, beta = ahead.sum(axis=1), back.sum(axis=2)
    return alpha / alpha.sum(axis=1, keepdims=True), beta / beta.sum(axis=1, keepdims=True)


def marginals(score: np.ndarray, pair: np.ndarray, first: np.ndarray, with_pairs: bool = False):
    """P(good) of each line by forward-backward over all documents side by side; with_pairs: the expected pair counts, too.

    score: log odds of good for each line by itself; pair[a, b]: weight of label b after a.
    """
    size = np.diff(first)
    m = np.exp(pair - pair.max())
    odds = np.clip(score, -30, 30)
    psi = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], axis=1)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    for d in np.flatnonzero(size > LONG):
        here = slice(first[d], first[d + 1])
        alpha[here], beta[here] = scan(psi[here], m)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG]
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # documents with over t lines
    for t in range(longest):
        i = begin[: live[t]] + t
        x = psi[i] if t == 0 else psi[i] * (alpha[i - 1] @ m)
        alpha[i] = x / x.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        i = begin[: live[t + 1]] + t
        x = (psi[i + 1] * beta[i + 1]) @ m.T
        beta[i] = x / x.sum(axis=1, keepdims=True)
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1) if len(both) else np.zeros(0)
    if not with_pairs:
        return good
    inner = np.ones(len(score), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    joint = alpha[i - 1][:, :, None] * m[None] * (psi[i] * beta[i])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return good, joint.sum(axis=0)


@dataclass
class Field:
    weights: np.ndarray
    pair: np.ndarray
    slope: float
    bias: float
    share: float
    mean: np.ndarray
    spread: np.ndarray

    def raw(self, f: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean log odds of each document's lines being good, weighted by length; NaN without lines."""
        x = neighbours((f - self.mean) / self.spread, first)
        good = np.clip(marginals(x @ self.weights, self.pair, first), 1e-6, 1 - 1e-6)
        at = np.concatenate([[0], np.cumsum(size * good)])
        weight = np.concatenate([[0], np.cumsum(size)])
        with np.errstate(invalid="ignore", divide="ignore"):
            p = (at[first[1:]] - at[first[:-1]]) / (weight[first[1:]] - weight[first[:-1]])
            p = np.clip(p, 1e-6, 1 - 1e-6)
            return np.log(p / (1 - p))

    def score(self, f: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.raw(f, size, first)
        p = 1 / (1 + np.exp(-np.clip(self.slope * z + self.bias, -40, 40)))
        return np.where(np.isnan(z), self.share, p)


def fit(f: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120) -> Field:
    """The field that makes the documents' labels likely, by gradient ascent with momentum (Adam) and a small ridge; each document counts alike."""
    share = float(label.mean()) if len(label) else 0.5
    mean = f.mean(axis=0) if len(f) else np.zeros(N_FEATURES, np.float32)
    spread = f.std(axis=0) + 1e-3 if len(f) else np.ones(N_FEATURES, np.float32)
    field = Field(np.zeros(3 * N_FEATURES + 3), np.zeros((2, 2)), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))), share, mean, spread)
    lines = np.diff(first)
    if not len(f) or share in (0.0, 1.0):
        return field
    x = neighbours((f - mean) / spread, first).astype(np.float64)
    y = np.repeat(label.astype(float), lines)
    inner = np.maximum(lines - 1, 0)
    seen = np.diag([inner[label == 0].sum(), inner[label == 1].sum()]).astype(float)
    theta = np.zeros(x.shape[1] + 4)
    m, v, scale = np.zeros_like(theta), np.zeros_like(theta), 1.0 / len(f)
    for step in range(1, rounds + 1):
        w, pair = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected = marginals(x @ w, pair, first, True)
        grad = np.concatenate([x.T @ (y - good), (seen - expected).ravel()]) * scale - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    field.weights, field.pair = theta[:-4], theta[-4:].reshape(2, 2)
    z = field.raw(f, size, first)
    ok = ~np.isnan(z)
    field.slope, field.bias = logistic(z[ok], label[ok])
    return field


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of P(y=1) as a logistic curve of z, by Newton's method with smoothed targets."""
    n1 = y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((target - p) * z).sum() - 1e-3 * a, (target - p).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        da, db = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: list[str], most: int, where: Column | None = None) -> DataFrame:
    """At most ``most`` labelled documents with their texts, those with the smallest hashes of their ids."""
    marked = labels.select("doc_id", *label).dropna()
    marked = marked.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in label])
    if where is not None:
        marked = marked.filter(where)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``most``


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality") -> Field:
    """A field from the labels of documents that aren't held out."""
    schema = "doc_id long, label double, lines int, size binary, features binary"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, size, first = line_features(*arrow_bytes(b.column("text")))
            cut = [slice(x, y) for x, y in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id").cast(pa.int64()),
                    "label": b.column(label_col).cast(pa.float64()),
                    "lines": np.diff(first).astype(np.int32),
                    "size": pa.array([size[c].astype("<i4").tobytes() for c in cut], pa.binary()),
                    "features": pa.array([f[c].tobytes() for c in cut], pa.binary()),
                }
            )

    rows = labelled_sample(docs, labels, [label_col], sample, ~held_out(F.col("doc_id"))).mapInArrow(extract, schema).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    f = np.frombuffer(b"".join(rows["features"]), np.float32).reshape(-1, N_FEATURES)
    size = np.frombuffer(b"".join(rows["size"]), "<i4").astype(np.int64)
    first = np.concatenate([[0], np.cumsum(rows["lines"].to_numpy(np.int64))]).astype(np.int64)
    return fit(f, size, first, rows["label"].to_numpy(float))


def score(docs: DataFrame, field: Field, threshold: float = 0.3, with_lines: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document (doc_id, text); with_lines: P(good) of each line with a word, too."""
    schema = "doc_id long, score double" + ", line_good array<double>" * with_lines

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, size, first = line_features(*arrow_bytes(b.column("text")))
            columns = {"doc_id": b.column("doc_id").cast(pa.int64()), "score": field.score(f, size, first)}
            if with_lines:
                x = neighbours((f - field.mean) / field.spread, first)
                columns["line_good"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(marginals(x @ field.weights, field.pair, first)))
            yield pa.RecordBatch.from_pydict(columns)

    scored = docs.select("doc_id", "text").mapInArrow(out, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["line_good"] * with_lines)


def reject(docs: DataFrame, field: Field, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that score under the threshold; all columns are kept, and nothing is shuffled."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, size, first = line_features(*arrow_bytes(b.column(text_col)))
            yield b.filter(pa.array(field.score(f, size, first) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the labels and scores all documents."""
    tune(docs.sparkSession)
    docs = documents(docs, id_col, text_col)
    return score(docs, train(docs, labels, sample), threshold)
