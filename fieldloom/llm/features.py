"""Hashed features of whole texts and a bounded labelled sample, for the trained models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T
from fieldloom.operators.shared import checkpoint

#: Features of a sample that the driver holds, 12 bytes each.
ENTRIES = 6_000_000
#: A model uses the word bins whose shares among its positive and negative documents differ by so many standard errors.
SIGNAL = 5.0

#: Lengths in bytes of the word beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7, 8)


def word_bins(data: np.ndarray, offs: np.ndarray, dims: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin, value): presence of each hashed word and of each longer word's beginnings; of the bins `only`, if given."""
    doc, start, end = T.spans(data, offs, "alnum")
    keys = []
    for n in (None, *BEGINNINGS):
        d, s, e = (doc, start, end) if n is None else (x[end - start > n] for x in (doc, start, start + n))
        bins = (T.mix(T.word_hashes(data, s, e, "alnum") + np.uint64(n or 0)) % np.uint64(dims)).astype(np.int64)
        if only is not None:
            d, bins = d[only[bins]], bins[only[bins]]
        keys.append(d * dims + bins)
    key = np.unique(np.concatenate(keys))
    return key // dims, key % dims, np.ones(len(key))


def shape_bins(data: np.ndarray, offs: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin, value): the square root of the share of each hashed token.

    Tokens are the kinds of the three bytes at every place of the text (each letter's case, digit, space, other bytes
    as they are) and, for every word, whether it repeats the word before it.
    """
    n = len(offs) - 1
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0)
    kind = _KIND[data].astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(offs))
    half = dims // 2
    ok = np.flatnonzero(doc[:-2] == doc[2:]) if len(data) > 2 else np.zeros(0, np.int64)
    code = (kind[ok] * 131 + kind[ok + 1]) * 131 + kind[ok + 2]
    n_code = np.bincount(doc[ok], minlength=n)
    key = doc[ok] * dims + (T.mix(code.astype(np.uint64)) % np.uint64(half)).astype(np.int64)
    wdoc, h = T.words(data, offs, "space")
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    n_word = np.bincount(wdoc, minlength=n)
    at, many = np.unique(key, return_counts=True)
    d = at // dims
    value = np.sqrt(many / n_code[d])
    rep = np.bincount(wdoc[again], minlength=n)
    r = np.flatnonzero(rep)
    return np.concatenate([d, r]), np.concatenate([at % dims, np.full(len(r), half)]), np.concatenate([value, np.sqrt(rep[r] / n_word[r])])


def graded_bins(data: np.ndarray, offs: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bin, value): shape_bins in the first quarter, then the text's hashed words, each by 1 over the square root
    of their number."""
    low = dims // 4
    d, b, v = shape_bins(data, offs, low)
    wdoc, h = T.words(data, offs, "alnum")
    high = dims - low
    key = np.unique(wdoc * high + (T.mix(h) % np.uint64(high)).astype(np.int64))
    own = key // high
    n = np.bincount(own, minlength=len(offs) - 1)
    return np.concatenate([d, own]), np.concatenate([b, low + key % high]), np.concatenate([v, 1 / np.sqrt(n[own])])


def _kinds() -> np.ndarray:
    k = np.arange(256) % 128
    k[128:] = 1  # characters beyond ASCII
    k[97:123] = 2
    k[65:91] = 3
    k[48:58] = 4
    return k.astype(np.uint8)


_KIND = _kinds()


def _examples(maker, dims: int, columns: tuple[str, ...]):
    def run(batches):
        for b in batches:
            for i, j, data, offs in T.blocks(b):
                n = j - i
                doc, bins, value = maker(data, offs, dims)
                order = np.argsort(doc, kind="stable")
                cut = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]
                bins, value = bins[order].astype(np.int32), value[order].astype(np.float32)
                out = dict(zip(columns, T.take(b, i, j, *columns)))
                out["bins"] = pa.array([bins[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())
                out["vals"] = pa.array([value[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.record_batch(out)

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: dict, maker, dims: int, rows: int, entries: int = ENTRIES, told=None):
    """At most `rows` labelled documents with `entries` features together as (CSR arrays, {target: values}).

    Labels meet the documents first: of all documents with a label whose targets are all known, those with the smallest
    hash of doc_id are taken, in that order, so the sample is spread over the input and does not depend on its order or
    on labels of other documents. Of several labels of one doc_id the one with the largest targets counts, of several
    texts the last in byte order; null texts are empty. A document whose features no longer fit is passed over, later ones
    that fit are taken. targets: name to a Column over labels. No other column of either
    table is read. told: gets {value: (documents, how many of them have each bin)} of the first target and says which
    bins are kept; it is asked before any feature is held.
    """
    names = tuple(targets)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(c.cast("int").alias(n) for n, c in targets.items())).alias("y"))
    given = given.where(F.col("doc_id").isNotNull() & F.forall(F.array(*(F.col("y").getField(n) for n in names)), lambda x: x.isNotNull()))
    given = given.groupBy("doc_id").agg(F.max("y").alias("y"))
    own = T.texts(docs)
    picked = given.join(own.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(7))).orderBy("h", "doc_id").limit(rows)
    picked = checkpoint(picked)
    own = own.join(F.broadcast(picked), "doc_id")  # `rows` rows at most
    own = own.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.first("y").alias("y"), F.first("h").alias("h"))
    own = own.select("doc_id", "h", "text", *(F.col("y").getField(n).alias(f"y{i}") for i, n in enumerate(names)))
    kept = ("doc_id", "h", *(f"y{i}" for i in range(len(names))))
    made = own.mapInArrow(_examples(maker, dims, kept), "doc_id long, h long, " + "".join(f"y{i} int, " for i in range(len(names))) + "bins binary, vals binary")
    made = checkpoint(made.orderBy("h", "doc_id"))
    keep = None
    if told is not None:
        counts: dict[int, list] = {}
        for r in made.select("y0", "bins").toLocalIterator():
            own = counts.setdefault(r.y0, [0, np.zeros(dims)])
            own[0] += 1
            own[1][np.frombuffer(r.bins, np.int32)] += 1
        keep = told({v: tuple(c) for v, c in counts.items()}) if counts else np.ones(dims, bool)
    bins, vals, y, total = [], [], [], 0
    for r in made.toLocalIterator():
        b, v = np.frombuffer(r.bins, np.int32), np.frombuffer(r.vals, np.float32)
        if keep is not None:
            b, v = b[keep[b]], v[keep[b]]
        if total + len(b) > entries:
            continue
        total += len(b)
        bins.append(b)
        vals.append(v)
        y.append([r[f"y{i}"] for i in range(len(names))])
    n = np.array([len(b) for b in bins], np.int64)
    x = Csr(
        np.repeat(np.arange(len(y), dtype=np.int32), n),
        np.concatenate(bins) if y else np.zeros(0, np.int32),
        np.concatenate(vals) if y else np.zeros(0, np.float32),
        len(y),
        dims,
    )
    return x, {t: np.array([r[i] for r in y], np.float64) for i, t in enumerate(names)}


class Csr:
    """A sparse matrix as row, column and value arrays."""

    def __init__(self, row, col, val, n, dims):
        self.row, self.col, self.val, self.n, self.dims = row, col, val, n, dims

    def dot(self, w):
        return np.bincount(self.row, self.val * w[self.col], minlength=self.n)

    def back(self, g):
        return np.bincount(self.col, self.val * g[self.row], minlength=self.dims)

    def rows(self, keep):
        new = np.cumsum(keep) - 1
        m = keep[self.row]
        return Csr(new[self.row[m]], self.col[m], self.val[m], int(keep.sum()), self.dims)

    def columns(self, keep):
        """The same matrix with 0 in all other columns."""
        m = keep[self.col]
        return Csr(self.row[m], self.col[m], self.val[m], self.n, self.dims)


def signal(x: Csr, y: np.ndarray) -> np.ndarray:
    """By how many standard errors a bin's shares among positive and negative documents differ."""
    a = np.bincount(x.col, y[x.row], minlength=x.dims)
    b = np.bincount(x.col, 1 - y[x.row], minlength=x.dims)
    return signal_of(a, b, y.sum(), len(y) - y.sum())


def signal_of(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """signal() from the counts of each bin among n1 positive and n0 negative documents."""
    p = (a + b + 1) / (n1 + n0 + 2)
    return np.abs(a / max(1, n1) - b / max(1, n0)) / np.sqrt(p * (1 - p) * (1 / max(1, n1) + 1 / max(1, n0)))


def adam(loss, start: np.ndarray, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Full-batch descent; loss returns the gradient."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = loss(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x -= rate * (1 - t / (steps + 1)) ** 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
