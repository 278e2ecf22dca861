"""Periodic runs of words: maximal stretches that repeat with a period, found and collapsed.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), at least LEAST words and
three periods long, which no neighbouring word continues.

* Recursive frequency splitting. Every word of a run stands in it three times or more. So a word that its segment (at
  first the whole text) holds more rarely is in no run: it splits the segment. What is left is counted anew, segments
  shorter than LEAST go, and this repeats until nothing changes, for all segments of a block of texts together.
* Lag scan. A run of three periods holds two neighbouring blocks of q words that begin at multiples of q and are equal.
  So for each lag q up to a third of a segment, blocks are compared with their neighbours by prefix hashes, n / q of
  them, and an equal pair is extended word by word in both directions. A pair inside a run that is known already has a
  multiple of its period and is left out. A segment of n words takes some n log n steps.

Words are compared by 64-bit hashes, which are taken as exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T

#: Words of a run at least, and its periods at least.
LEAST, PERIODS = 24, 3
_U = np.uint64
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def split(doc: np.ndarray, h: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the segments of a block's words (document, hash) that may hold runs."""
    at = np.arange(len(h))  # words still alive; a segment is a stretch of them without a gap, in one document
    _, h = np.unique(h, return_inverse=True)
    while len(at):
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])]
        seg = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(at)])
        key = seg * (int(h.max()) + 1) + h[at]
        _, group, n = np.unique(key, return_inverse=True, return_counts=True)
        keep = (n[group] >= periods) & (size[seg] >= least)
        if keep.all():
            return at[first], at[first] + size
        at = at[keep]
    z = np.zeros(0, np.int64)
    return z, z


def scan(h: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment's word hashes."""
    n = len(h)
    up, _ = T.powers(n + 1)
    sums = np.r_[_U(0), np.cumsum(h * up[:n])]
    far = np.zeros(n, np.int64)  # the end of the longest known run over a word
    out = []
    for q in range(1, n // periods + 1):
        a = np.arange(0, n - 2 * q + 1, q)
        step = up[q]
        b = sums[a + q]
        hit = a[((b - sums[a]) * step == sums[a + 2 * q] - b) & (far[a] < a + 2 * q)]
        while len(hit):
            i = int(hit[0])
            s = _back(h, i, q)
            e = _forth(h, i + 2 * q, q)
            hit = hit[hit + 2 * q > e]
            if e - s >= max(least, periods * q):
                out.append((s, e - s, q))
                far[s:e] = np.maximum(far[s:e], e)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _back(h: np.ndarray, i: int, q: int) -> int:
    """The smallest start from which all words up to i equal those q later."""
    step = 64
    while i > 0:
        a = max(0, i - step)
        wrong = np.flatnonzero(h[a:i] != h[a + q : i + q])
        if len(wrong):
            return a + int(wrong[-1]) + 1
        i, step = a, 4 * step
    return 0


def _forth(h: np.ndarray, i: int, q: int) -> int:
    """The largest end up to which all words from i on equal those q before."""
    step = 64
    while i < len(h):
        z = min(len(h), i + step)
        wrong = np.flatnonzero(h[i:z] != h[i - q : z - q])
        if len(wrong):
            return i + int(wrong[0])
        i, step = z, 4 * step
    return len(h)


def _join(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """The words of each of n texts, joined by one space."""
    size = ends - starts + 1  # with a byte behind each word
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    at = np.arange(len(out)) - np.repeat(stop - size, size)
    word = at < np.repeat(size - 1, size)
    out[word] = data[(np.repeat(starts, size) + at)[word]]
    per = np.bincount(doc, size, minlength=n).astype(np.int64)
    begin = np.cumsum(per) - per
    raw = out.tobytes()
    return pa.array([raw[a : a + m - 1] if m else b"" for a, m in zip(begin.tolist(), per.tolist())], pa.binary()).cast(pa.string())


def _run(least: int, periods: int):
    def run(batches):
        for b in batches:
            for i, j, data, offs in T.blocks(b):
                n = j - i
                doc, starts, ends = T.spans(data, offs, "exact")
                h = T.word_hashes(data, starts, ends, "exact")
                per = T.counts(doc, n)
                begin = np.cumsum(per) - per
                found: list[list] = [[] for _ in range(n)]
                drop = np.zeros(len(h) + 1, np.int64)
                for s, e in zip(*split(doc, h, least, periods)):
                    d = int(doc[s])
                    for a, m, q in scan(h[s:e], least, periods):
                        a += int(s)
                        found[d].append({"start": a - int(begin[d]), "length": m, "period": q})
                        drop[a + q] += 1
                        drop[a + m] -= 1
                keep = np.cumsum(drop)[:-1] == 0
                (doc_id,) = T.take(b, i, j, "doc_id")
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                runs = pa.array([sorted(x, key=lambda r: (r["start"], r["period"])) for x in found], kind)
                text = _join(data, starts[keep], ends[keep], doc[keep], n)
                yield pa.record_batch({"doc_id": doc_id, "n_words": pa.array(per), "runs": runs, "collapsed": text})

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period), collapsed of each row of docs.

    collapsed holds the words, joined by one space, without those that a run contains behind its first period; where runs
    overlap, a word goes if any of them says so. Words are compared letter for letter. Null or empty texts have no words
    and an empty collapsed text; rows without an id and repeated rows are treated like others; texts of any length are
    scanned whole; other columns, whatever their names, are ignored; an empty table gives an empty one.
    """
    if periods < PERIODS:
        raise ValueError("the lag scan needs three periods at least")
    return T.texts(docs).mapInArrow(_run(least, periods), SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs, in a tenth of which (h = crc32 of the decimal doc_id, h % 10 = 0) a stretch repeats up to
    the text's end: with g = h div 10, each word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div
    (3 + g % 8). Their words are joined by one space. Texts without an id or words stay as they are."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    out = T.texts(docs).select("doc_id", "text", h.alias("h"), F.expr("crc32(cast(doc_id as string)) div 10").alias("g"))
    out = out.withColumn("w", F.when(F.col("h") % 10 == 0, words))
    out = out.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    out = out.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = F.expr("array_join(transform(sequence(0L, cast(n as long) - 1L), i -> get(w, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')")
    return out.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the smallest start, then period on ties; null if none."""
    def order(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        ahead = (a > b) | ((a == b) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
        return F.when(ahead, -1).otherwise(1)

    best = F.aggregate(runs, F.get(runs, 0), lambda s, x: F.when(order(x, s) < 0, x).otherwise(s))
    return F.when(F.size(runs) > 0, best)


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of periodic_runs' rows."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("_b", longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_b.start").alias("start"),
        F.col("_b.length").alias("length"),
        F.col("_b.period").alias("period"),
        F.expr("(1000 * _b.length) div _b.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
