"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > j) = sigmoid(w.x - theta_j) with one weight vector over hashed features of the whole text (its words, and the
kinds of every three bytes) and rising thresholds theta. The model gives the expected grade and the tail probability P(grade > j) by which documents are kept.
It is fitted by full-batch descent on a bounded sample of rated documents (SAMPLE) and broadcast: DIMS weights and one
threshold for each grade but one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T
from fieldloom.llm.features import SIGNAL, Csr, adam, graded_bins, labelled_sample, sigmoid, signal_of

DIMS = 1 << 14
SAMPLE = 6_000
L2 = 1e-5
KEEP = 0.5


def fit_ordinal(x: Csr, grade: np.ndarray, n_grades: int, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative logit model; thresholds rise by construction."""
    cuts = n_grades - 1
    base = np.array([(grade > j).mean() for j in range(cuts)]).clip(1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(base / (1 - base)) + 1e-3 * np.arange(cuts))
    start = np.r_[np.zeros(x.dims), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))]
    p = adam(ordinal_gradient(x, grade.astype(int), cuts, l2), start)
    return p[: x.dims], p[x.dims] + np.r_[0, np.cumsum(np.exp(p[x.dims + 1 :]))]


def ordinal_gradient(x: Csr, g: np.ndarray, cuts: int, l2: float):
    """Gradient of the mean negative log-likelihood over (weights, first threshold, logarithms of the further steps)."""

    def gradient(p):
        w, first, steps = p[: x.dims], p[x.dims], np.exp(p[x.dims + 1 :])
        t = np.r_[-np.inf, first + np.r_[0, np.cumsum(steps)], np.inf]
        z = x.dot(w)
        hi, lo = sigmoid(t[g + 1] - z), sigmoid(t[g] - z)  # P(y <= g), P(y < g)
        prob = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        dt = np.zeros(cuts)
        for j in range(cuts):
            dt[j] = (-(dhi / prob) * (g == j) + (dlo / prob) * (g == j + 1)).sum()
        n = max(1, len(g))
        dsteps = np.array([dt[j + 1 :].sum() for j in range(cuts - 1)]) * steps
        return np.r_[x.back((dhi - dlo) / prob) / n + 2 * l2 * w, dt.sum() / n, dsteps / n]

    return gradient


def _score(model, dims: int):
    def run(batches):
        w, theta = model.value
        for b in batches:
            for i, j, data, offs in T.blocks(b):
                doc, bins, value = graded_bins(data, offs, dims)
                z = np.bincount(doc, value * w[bins], minlength=j - i) if len(doc) else np.zeros(j - i)
                tail = sigmoid(z[:, None] - theta[None, :])
                (doc_id,) = T.take(b, i, j, "doc_id")
                yield pa.record_batch({"doc_id": doc_id.cast(pa.int64()), "expected_grade": pa.array(np.round(tail.sum(1), 9)), "tail_probability": pa.array(np.round(tail[:, 0], 9))})

    return run


def rate_quality(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, keep: float = KEEP, sample: int = SAMPLE, dims: int = DIMS) -> DataFrame:
    """doc_id, expected_grade (0 to n_grades - 1), tail_probability P(grade > 0), keep of each row of docs.

    grade is a Column over labels, 0 to n_grades - 1; unrated rows are left out of the sample. Without any rating the
    weights are 0 and all documents are kept. Null or empty texts have no features and get the thresholds' own
    probabilities; repeated rows get equal scores, so ties at the threshold are all kept; texts of any length are read
    whole; rows without an id are rated too; other columns, whatever their names, are ignored.
    """

    def told(counts):
        part = lambda ok: (sum((c[1] for g, c in counts.items() if ok(g)), np.zeros(dims)), sum(c[0] for g, c in counts.items() if ok(g)))
        most = np.zeros(dims)
        for j in range(n_grades - 1):
            (a, n1), (b, n0) = part(lambda g: g > j), part(lambda g: g <= j)
            most = np.maximum(most, signal_of(a, b, n1, n0))
        return (most >= SIGNAL) | (np.arange(dims) < dims // 4)  # kinds of bytes are few, words are many

    x, y = labelled_sample(docs, labels, {"grade": grade}, graded_bins, dims, sample, told=told)
    if x.n:
        model = fit_ordinal(x, y["grade"].clip(0, n_grades - 1), n_grades)
    else:
        model = np.zeros(dims), np.full(n_grades - 1, -5.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = T.texts(docs)
    out = docs.mapInArrow(_score(shared, dims), "doc_id long, expected_grade double, tail_probability double")
    return out.withColumn("keep", F.col("tail_probability") >= F.lit(keep))


def given_grade() -> Column:
    """Rating of the given labels: 0 low quality, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, F.lit(0)).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, F.lit(1)).otherwise(F.lit(2)))
