"""What the trained operators share: bounded samples of labelled rows and logistic regression in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CLASSES = 10_000
"""Labels that a column may have; one with more doesn't hold classes, and fitting fails."""
MOST_ROWS = 8000
"""Rows of a sample over all classes, about, unless LEAST_ROWS of each are more."""
LEAST_ROWS = 4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def class_sample(rows: DataFrame, key: Column, label: Column, a_class: int, most_rows: int = MOST_ROWS) -> tuple[DataFrame, dict]:
    """A sample by a hash of the key, about a_class rows of each class (fewer, but LEAST_ROWS, where most_rows is met) or all if there are fewer; (rows with _label, {label: rows in all})."""
    rows = rows.withColumn("_label", label).filter(F.col("_label").isNotNull())
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} labels are no classes")
    if not counts:
        return rows.filter(F.lit(False)), counts
    a_class = min(a_class, max(LEAST_ROWS, most_rows // len(counts)))
    place = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    shares = rows.sparkSession.createDataFrame([(c, a_class / n) for c, n in counts.items()], T.StructType([T.StructField("_of", rows.schema["_label"].dataType), T.StructField("_share", T.DoubleType())]))
    found = rows.join(F.broadcast(shares), F.col("_label") == F.col("_of")).filter(place < F.col("_share"))
    return found.drop("_of", "_share"), counts


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(id, _label, text) of the sampled ids among (id, text): one row an id, however often it is repeated, so that the sample stays bounded."""
    found = docs.join(F.broadcast(sample.select("id", "_label")), "id")
    return found.groupBy("id", "_label").agg(F.min("text").alias("text"))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 150, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, outputs) and biases of independent logistic regressions; y in 0 to 1, (rows, outputs). Adam on all rows at once."""
    n, d = x.shape
    w, b = np.zeros((d, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    wt = (np.ones(n, np.float32) if weight is None else weight.astype(np.float32))[:, None]
    wt = wt / wt.sum()
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        e = (sigmoid(x @ w + b) - y) * wt
        for i, (p, g) in enumerate(((w, x.T @ e + l2 * w), (b, e.sum(0)))):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            p -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return w, b
