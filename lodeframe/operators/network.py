"""The order network: a perceptron trained on minibatches that are spread over the cluster.

Rows are dealt once to ``slices``, folders of a written table. An epoch draws a
new order of the slices and takes some as each minibatch, so a step reads only its
own files. A step is one distributed sum: tasks run forward and back through
numpy with the same weights and return one gradient each; the driver, which holds
the weights alone, makes a step of AdamW. Dropout comes from numbers drawn from
the row's id and the step, so a task that is run again draws the same ones. After
each epoch the validation rows are judged in one pass, and the weights that did
best (the first of equal ones) are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, written
from .variance import summed_block

NAME_X, NAME_Y = "x", "y"
#: Files of a slice, which as many tasks can read.
FILES = 8


@dataclass
class Model:
    """Weights of all layers, and the features' means and deviations."""

    mean: np.ndarray
    deviation: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    history: list[dict] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = (x - self.mean) / self.deviation
        for k, (w, b) in enumerate(self.layers):
            out = out @ w + b
            out = np.maximum(out, 0) if k + 1 < len(self.layers) else out
        return out[:, 0]


def _flat(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([a.ravel() for w, b in parts for a in (w, b)])


def _shaped(flat: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for n, m in zip(sizes[:-1], sizes[1:], strict=True):
        out.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def _mask(ids: np.ndarray, width: int, salt: int, drop: float) -> np.ndarray:
    """(rows, width): 1 / (1 - drop) where a cell stays, from hashes of the id, the cell and the step."""
    h = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ ((np.arange(width, dtype=np.uint64) + np.uint64(salt) * np.uint64(1 << 20) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))[None]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return (h >> np.uint64(40) >= np.uint64(drop * (1 << 24))) / (1 - drop)


def gradient(x: np.ndarray, y: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray | None = None, step: int = 0, drop: float = 0.0) -> tuple[float, np.ndarray]:
    """Sum of the logistic losses of standardised rows, and of its gradients by all weights."""
    held, masks, out = [x], [], x
    for k, (w, b) in enumerate(layers):
        out = out @ w + b
        if k + 1 < len(layers):
            out = np.maximum(out, 0)
            if drop and ids is not None:
                masks.append(_mask(ids, out.shape[1], step * 64 + k, drop))
                out = out * masks[-1]
            held.append(out)
    z = out[:, 0]
    loss = float((np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum())
    back = (1 / (1 + np.exp(-z)) - y)[:, None]
    grads = []
    for k in range(len(layers) - 1, -1, -1):
        grads.append((held[k].T @ back, back.sum(axis=0)))
        if k:
            back = (back @ layers[k][0].T) * (held[k] > 0)
            if masks:
                back = back * masks[k - 1]
    return loss, _flat(grads[::-1])


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1), b.column("y").to_numpy(zero_copy_only=False).astype(float), b.column("id").to_numpy(zero_copy_only=False)


def rows_of(data: DataFrame, names: list[str], label: str, id_col: str) -> DataFrame:
    """id, x (an array of the features; what has no value is 0) and y."""
    clean = lambda n: F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0))
    return data.select(F.col(id_col).cast("long").alias("id"), F.array(*[clean(n) for n in names]).alias("x"), F.col(label).cast("double").alias("y"))


def train(training: DataFrame, validation: DataFrame, names: list[str], label: str = "label", id_col: str = "event_id", hidden: tuple[int, ...] = (128, 64), epochs: int = 10, batch: int = 8192, rate: float = 1e-3, decay: float = 1e-4, drop: float = 0.1, seed: int = 7, slices: int = 64) -> Model:
    """The network that does best on the validation rows, with a history row an epoch."""
    spark = training.sparkSession
    prepare(spark)
    own = rows_of(training, names, label, id_col).withColumn("slice", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(slices)).cast("int"))
    # Some files a slice, so that a step, which reads one slice of a large table, is more than one task.
    own = written(own.repartition(slices * FILES, "slice", F.pmod(F.xxhash64("id"), F.lit(FILES))), "slices", "slice")
    held = written(rows_of(validation, names, label, id_col), "validation")
    n = len(names)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x, _, _ = _columns(b)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    total = summed_block(own.select("id", "x", "y"), moments, (2 * n + 1,))
    rows = max(1.0, total[0])
    mean = total[1 : n + 1] / rows
    deviation = np.sqrt(np.maximum(total[n + 1 :] / rows - mean * mean, 0))
    deviation[deviation < 1e-6] = 1.0
    rng, sizes = np.random.default_rng(seed), [n, *hidden, 1]
    layers = [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    weights, first, second, step = _flat(layers), np.zeros(len(_flat(layers))), np.zeros(len(_flat(layers))), 0
    together = int(np.clip(round(batch * slices / rows), 1, slices))
    best, model = -1.0, Model(mean, deviation, layers)
    for epoch in range(1, epochs + 1):
        order, seen = rng.permutation(slices).tolist(), np.zeros(2)
        for a in range(0, slices, together):
            step += 1
            now = _shaped(weights, sizes)

            def partial(b: pa.RecordBatch, now=now, step=step) -> np.ndarray:
                x, y, ids = _columns(b)
                loss, g = gradient((x - mean) / deviation, y, now, ids, step, drop)
                return np.concatenate([[len(y), loss], g])

            got = summed_block(own.filter(F.col("slice").isin(order[a : a + together])).select("id", "x", "y"), partial, (len(weights) + 2,))
            if not got[0]:
                continue
            seen += got[:2]
            g = got[2:] / got[0]
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            weights = weights * (1 - rate * decay) - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        trial = Model(mean, deviation, _shaped(weights, sizes))
        loss, accuracy = judge(held, trial)
        model.history.append({"epoch": epoch, "train_loss": seen[1] / max(1.0, seen[0]), "loss": loss, "accuracy": accuracy})
        if accuracy > best:
            best, model.layers = accuracy, trial.layers
    return model


def judge(rows: DataFrame, model: Model) -> tuple[float, float]:
    """Mean loss and accuracy, in one pass."""

    def partial(b: pa.RecordBatch) -> np.ndarray:
        x, y, _ = _columns(b)
        z = model.logits(x)
        return np.array([len(y), (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).sum(), ((z >= 0) == (y >= 0.5)).sum()])

    n, loss, right = summed_block(rows.select("id", "x", "y"), partial, (3,))
    return loss / max(1.0, n), right / max(1.0, n)


def scored(data: DataFrame, model: Model, names: list[str], label: str = "label", id_col: str = "event_id") -> DataFrame:
    """id, y and p, the probability that the network gives to the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, y, _ = _columns(b)
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "y": y, "p": 1 / (1 + np.exp(-model.logits(x)))})

    prepare(data.sparkSession)
    return rows_of(data, names, label, id_col).mapInArrow(run, "id long, y double, p double")
