"""Vectorised work on whole blocks of texts: word spans and 64-bit word hashes straight from the UTF-8 bytes.

A block is some rows of an Arrow batch whose texts take about BLOCK bytes together; a longer text is a block by itself
and is never cut. Memory of a task is about 40 times the larger of BLOCK and its longest text: 20 MB for short texts,
4 GB for one of 100 MB, which needs executors to match.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.shared import bounded_batches

BLOCK = 1 << 19

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_P) + _U(seed))


_BYTE = seeded(256, 11)


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_table(kind: str) -> np.ndarray:
    """Byte to its lower-cased byte, or 0 where it separates words. Bytes of characters beyond ASCII are word bytes."""
    t = _lower()
    if kind == "space":  # words [^\x20\x09-\x0D]+
        t[[0x20, *range(0x09, 0x0E)]] = 0
        nul = 1  # NUL is a word byte here: give it a value of its own
        t[0] = nul
    elif kind == "exact":  # the same words, letters as they are
        t = np.arange(256, dtype=np.uint8)
        t[[0x20, *range(0x09, 0x0E)]] = 0
        t[0] = 1
    elif kind == "alnum":  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
        for a, b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
            t[a : b + 1] = 0
    else:
        raise ValueError(kind)
    return t


TABLES = {k: word_table(k) for k in ("space", "alnum", "exact")}
#: What a byte adds to a hash. In "space" words byte 0 and byte 1 must differ, so hashes use the byte itself.
_VALUES = {}
for _k, _t in TABLES.items():
    _v = _BYTE if _k == "exact" else _BYTE[_lower()]
    _VALUES[_k] = _v


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    a, b = np.full(n, _P, dtype=_U), np.full(n, _PINV, dtype=_U)
    a[0] = b[0] = 1
    return np.cumprod(a), np.cumprod(b)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(20, int(n).bit_length()))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and whole text (string) of each row of docs; no other column is read, whatever its name."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def blocks(batch: pa.RecordBatch, name: str = "text", limit: int = BLOCK):
    """(first row, end row, bytes, offsets) for runs of rows; null texts are empty."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers stay for later tasks, and would keep what their largest block took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def spans(data: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end) of each word, in order, in bytes of the block."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = TABLES[kind][data] != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    return doc, starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """A 64-bit hash of each lower-cased word: a polynomial in its bytes, taken from prefix sums, then mixed."""
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(_VALUES[kind][data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each word of a block."""
    doc, s, e = spans(data, offs, kind)
    return doc, word_hashes(data, s, e, kind)


def hash_words(texts: list[str], kind: str) -> list[np.ndarray]:
    """Word hashes of a few texts, for templates, items and tests."""
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    out: list[np.ndarray] = []
    for i, j, data, offs in blocks(batch):
        doc, h = words(data, offs, kind)
        out += [h[doc == k] for k in range(j - i)]
    return out


def counts(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def take(batch: pa.RecordBatch, i: int, j: int, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in names]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def vocabulary_counts(docs, vocabulary: np.ndarray, kind: str) -> np.ndarray:
    """How often each of the word hashes (sorted, few) stands in all texts: partial counts by task, then their sums."""
    want = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = want.value
        n = np.zeros(len(v), np.int64)
        for b in batches:
            for _, _, data, offs in blocks(b):
                h = words(data, offs, kind)[1]
                at = np.minimum(np.searchsorted(v, h), len(v) - 1)
                n += np.bincount(at[v[at] == h], minlength=len(v))
        yield pa.record_batch({"i": pa.array(np.flatnonzero(n)), "n": pa.array(n[n > 0])})

    total = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for i, n in docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n")).collect():
            total[i] = n
    return total
