"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown breadth-first on binned statistics by second-order gain, with
logistic loss.  A fitted model is a few flat arrays (feature, threshold, left
child, value); a batch of documents walks all trees level by level in numpy.

The model is fitted on the driver on the statistics of at most ``SAMPLE``
labelled documents; their texts never leave the executors.  All documents are
scored whole.  No label, lang, source or id enters a score.

Defined results: null and empty texts have all-zero statistics and get the score
the trees give these; without any label every score is 0.5; repeated rows get
equal rows; an empty table gives no rows; a null doc_id is kept, not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import NAMES, statistics
from .labelled import held_out, label_sample

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_HESSIAN = 60, 4, 64, 0.15, 1.0, 2.0
CUT = 0.3


@dataclass
class Forest:
    """Node i of tree t: go to left[t, i] + (x[feature[t, i]] > threshold[t, i]); leaves point to themselves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    step: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = self.left[t, at] + self.step[t, at] * (x[rows, self.feature[t, at]] > self.threshold[t, at])
            total += self.value[t, at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    forest = Forest(0.0, np.zeros(shape, np.int64), np.full(shape, np.inf), np.tile(np.arange(nodes), (trees, 1)), np.zeros(shape, np.int64), np.zeros(shape))
    if not len(y):
        return forest
    rate = (y.sum() + 1) / (len(y) + 2)
    forest.base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * BINS
    margin = np.full(len(y), forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        free = 1
        level = [0]
        for d in range(depth + 1):
            following = []
            for node in level:
                mine = np.flatnonzero(at == node)
                g, h = grad[mine].sum(), hess[mine].sum()
                forest.value[t, node] = -RATE * g / (h + L2)
                if d == depth or len(mine) < 2:
                    continue
                hg = np.bincount(flat[mine].ravel(), np.repeat(grad[mine], x.shape[1]), x.shape[1] * BINS).reshape(-1, BINS).cumsum(axis=1)
                hh = np.bincount(flat[mine].ravel(), np.repeat(hess[mine], x.shape[1]), x.shape[1] * BINS).reshape(-1, BINS).cumsum(axis=1)
                gain = hg**2 / (hh + L2) + (g - hg) ** 2 / (h - hh + L2) - g**2 / (h + L2)
                gain[(hh < LEAST_HESSIAN) | (h - hh < LEAST_HESSIAN)] = 0
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] <= 1e-9 or b >= len(edges[f]):
                    continue
                forest.feature[t, node], forest.threshold[t, node] = f, edges[f][b]
                forest.left[t, node], forest.step[t, node] = free, 1
                at[mine] = free + (binned[mine, f] > b)
                following += [free, free + 1]
                free += 2
            level = following
        margin += forest.value[t, at]
    return forest


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(NAMES)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled documents (a sampled id that repeats in ``docs`` counts each time, up to that bound)."""
    chosen = label_sample(labels, label, sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")  # at most ``sample`` ids
    described = texts.mapInArrow(_statistics_rows, "label int, x array<float>")
    rows = described.orderBy(F.xxhash64("x", "label")).limit(sample).toArrow()  # the same rows in every run
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(-1, len(NAMES))
    y = np.asarray(rows.column("label").to_pylist(), float)
    order = np.lexsort([*x.T, y])  # rows arrive in no fixed order
    return fit(x[order], y[order])


def classify(docs: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(forest.score(statistics(part.column(1))), 6))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
