"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over hashed words and word beginnings; each model also gets the
probabilities of the categories before it. In training those are out-of-fold predictions, so a later model sees
probabilities as uncertain as they will be on new texts. The models are fitted on a bounded sample of labelled documents
(SAMPLE) and broadcast: DIMS weights for each category.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T
from fieldloom.llm.features import SIGNAL, Csr, adam, labelled_sample, sigmoid, signal, word_bins

DIMS = 1 << 16
SAMPLE = 8_000
FOLDS = 3
L2 = 1e-4


def given_categories() -> dict[str, Column]:
    """Categories of the given labels, in chain order: junk (low quality), junk that is toxic, and toxic itself."""
    low = (F.col("quality") == 0).cast("int")
    return {"junk": low, "toxic_junk": low * F.col("toxic"), "toxic": F.col("toxic")}


def fit_logistic(x: Csr, more: np.ndarray, y: np.ndarray, l2: float = L2) -> np.ndarray:
    """Weights over the bins, then over `more` (dense columns), then the bias; bins without a signal weigh 0."""
    used = np.flatnonzero(signal(x, y) >= SIGNAL)
    if len(used) < x.dims:
        to = np.full(x.dims, -1)
        to[used] = np.arange(len(used))
        keep = to[x.col] >= 0
        w = fit_logistic_dense(Csr(x.row[keep], to[x.col[keep]], x.val[keep], x.n, len(used)), more, y, l2)
        out = np.zeros(x.dims + more.shape[1] + 1)
        out[used], out[x.dims :] = w[: len(used)], w[len(used) :]
        return out
    return fit_logistic_dense(x, more, y, l2)


def fit_logistic_dense(x: Csr, more: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    d, m, n = x.dims, more.shape[1], max(1, len(y))
    p = y.mean() if len(y) else 0.0
    start = np.zeros(d + m + 1)
    start[-1] = np.log((p + 1e-3) / (1 - p + 1e-3))

    def gradient(w):
        g = (sigmoid(x.dot(w[:d]) + more @ w[d:-1] + w[-1]) - y) / n
        return np.r_[x.back(g) + 2 * l2 * w[:d], more.T @ g + 2 * l2 * w[d:-1], g.sum()]

    return adam(gradient, start, steps=300, rate=0.1)


def predict(x: Csr, more: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x.dot(w[: x.dims]) + more @ w[x.dims : -1] + w[-1])


def fit_chain(x: Csr, labels: list[np.ndarray], folds: int = FOLDS) -> list[np.ndarray]:
    """One weight vector for each category, in order."""
    fold = np.arange(x.n) % folds
    before = np.zeros((x.n, 0))
    models = []
    for y in labels:
        models.append(fit_logistic(x, before, y))
        out = np.zeros(x.n)
        for k in range(folds):
            own = fold == k
            if own.any() and (~own).any():
                part = fit_logistic(x.rows(~own), before[~own], y[~own])
                out[own] = predict(x.rows(own), before[own], part)
        before = np.c_[before, out]
    return models


def _score(model, names: tuple[str, ...], dims: int):
    def run(batches):
        models = model.value
        only = np.any([w[:dims] != 0 for w in models], axis=0)
        for b in batches:
            for i, j, data, offs in T.blocks(b):
                doc, bins, value = word_bins(data, offs, dims, only)
                x = Csr(doc, bins, value, j - i, dims)
                before = np.zeros((j - i, 0))
                for w in models:
                    before = np.c_[before, predict(x, before, w)]
                (doc_id,) = T.take(b, i, j, "doc_id")
                yield pa.record_batch({"doc_id": doc_id.cast(pa.int64()), **{f"p_{c}": pa.array(np.round(before[:, k], 9)) for k, c in enumerate(names)}})

    return run


def toxicity_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], verdict: str, threshold: float = 0.5, sample: int = SAMPLE, dims: int = DIMS) -> DataFrame:
    """doc_id, p_<category> of each category in chain order, toxic (p_<verdict> >= threshold) of each row of docs.

    categories: name to a Column over labels with 0 or 1; rows with a null category are left out, a category without a
    member is predicted by its bias. Without labels every probability is 0. Null or empty texts have no words and get
    the models' bias; repeated rows get equal results, so ties at the threshold are all toxic; texts of any length are
    read whole; other columns, whatever their names, are ignored.
    """
    x, y = labelled_sample(docs, labels, categories, word_bins, dims, sample)
    names = tuple(categories)
    models = fit_chain(x, [y[c] for c in names]) if x.n else [np.r_[np.zeros(dims + k), -40.0] for k in range(len(names))]
    shared = docs.sparkSession.sparkContext.broadcast(models)
    docs = T.texts(docs)
    out = docs.mapInArrow(_score(shared, names, dims), "doc_id long, " + ", ".join(f"p_{c} double" for c in names))
    return out.withColumn("toxic", F.col(f"p_{verdict}") >= F.lit(threshold))
