"""Document fingerprints: quartile bucket digests.

Every three adjacent bytes are hashed into one of 128 buckets. A bucket's code says between which quartiles of all
bucket counts its own lies. The digest is "Q1", two hex digits of the logarithm of the length, two of the quartiles'
ratios, then the codes, two bits each: 70 characters. Two digests differ by the sum over buckets of 0, 1, 2 or (for
codes at opposite ends) 6, plus the differences of length and ratios, bounded by BOUND; likeness is 1 - that / BOUND.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T
from fieldloom.operators.shared import partitions

BUCKETS = 128
BOUND = 300

_BUCKET = (T.seeded(256 * 3, 77) >> np.uint64(57)).astype(np.uint8).reshape(3, 256)
_FAR = np.array([0, 1, 2, 6])


def fingerprint(data: bytes) -> str:
    b = np.frombuffer(data, np.uint8)
    if len(b) >= 3:
        n = np.bincount(_BUCKET[0][b[:-2]] ^ _BUCKET[1][b[1:-1]] ^ _BUCKET[2][b[2:]], minlength=BUCKETS)
    else:
        n = np.zeros(BUCKETS, np.int64)
    q1, q2, q3 = np.sort(n)[[31, 63, 95]]
    codes = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    body = np.packbits(np.unpackbits(codes.astype(np.uint8)[:, None], axis=1)[:, 6:].ravel()).tobytes().hex()
    length = min(255, int(math.log(len(b) + 1) * 10))
    top = max(1, int(q3))
    return f"Q1{length:02x}{int(q1) * 15 // top:x}{int(q2) * 15 // top:x}{body}"


def difference(x: str, y: str) -> int:
    """0 to BOUND."""
    far = abs(int(x[2:4], 16) - int(y[2:4], 16)) + abs(int(x[4], 16) - int(y[4], 16)) + abs(int(x[5], 16) - int(y[5], 16))
    p, q = (np.frombuffer(bytes.fromhex(z[6:]), np.uint8) for z in (x, y))
    for shift in (0, 2, 4, 6):
        far += int(_FAR[np.abs((p >> shift & 3).astype(np.int8) - (q >> shift & 3).astype(np.int8))].sum())
    return min(far, BOUND)


def likeness(x: str, y: str) -> float:
    return 1.0 - difference(x, y) / BOUND


def _fingerprints(batches):
    for b in batches:
        for i, j, data, offs in T.blocks(b):
            (doc_id,) = T.take(b, i, j, "doc_id")
            raw = data.tobytes()
            yield pa.record_batch({"doc_id": doc_id.cast(pa.int64()), "fingerprint": pa.array([fingerprint(raw[a:z]) for a, z in zip(offs[:-1], offs[1:])], pa.string())})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of docs; null texts count as empty."""
    docs = T.texts(docs)
    return docs.mapInArrow(_fingerprints, "doc_id long, fingerprint string")


def _parts(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Ranges of doc_id, from 1 on in rising order; 0 for rows without an id."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    return np.where(null, 0, 1 + np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "right"))


def _tops(bounds):
    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            part = _parts(ids, bounds.value)
            val = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            for p in np.unique(part):
                yield pa.record_batch({"part": pa.array([int(p)]), "top": pa.array([int(val[part == p].max())])})

    return run


def _deal(bounds, lend):
    """Each row with its range; the first row of a range also goes, lent, to the range that precedes it."""

    def run(batches):
        to = lend.value
        for b in batches:
            ids = b.column("doc_id")
            part = _parts(ids, bounds.value)
            val = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            own = np.arange(len(part))
            also = np.array([r for r in own if part[r] in to and to[part[r]][0] == val[r]], np.int64)
            target = [t for r in also for t in to[part[r]][1]]
            rows = np.concatenate([own, np.repeat(also, [len(to[part[r]][1]) for r in also]).astype(np.int64)]) if len(also) else own
            yield pa.record_batch(
                {
                    "part": pa.array(np.concatenate([part, np.array(target, np.int64)])),
                    "lent": pa.array(np.r_[np.zeros(len(own), bool), np.ones(len(target), bool)]),
                    "doc_id": ids.take(pa.array(rows)),
                    "text": b.column("text").take(pa.array(rows)),
                }
            )

    return run


def _compare(batches):
    """Along each range: every own row with the row after it."""
    held = None  # (part, doc_id, text, fingerprint)
    for b in batches:
        for i, j, _, _ in T.blocks(b):
            cols = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            out: dict[str, list] = {c: [] for c in cols}
            for part, lent, doc_id, text in zip(*(x.to_pylist() for x in T.take(b, i, j, "part", "lent", "doc_id", "text"))):
                text = text or ""
                own = fingerprint(text.encode())
                if held and held[0] == part:
                    n = len(held[2])
                    edited = (held[2][: n - n // 2] + text[: n // 2]).encode()
                    mark = fingerprint(edited)
                    row = (held[1], n, hashlib.sha256(edited).hexdigest(), held[3], mark, likeness(held[3], mark), likeness(held[3], own))
                    for c, x in zip(cols, row):
                        out[c].append(x)
                held = None if lent else (part, doc_id, text, own)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.record_batch({c: pa.array(out[c], k) for c, k in zip(cols, kinds)})


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is taken from the next document's start.

    Documents follow each other by falling doc_id, rows without an id last, ties by text; after the last comes the
    first. Rows are dealt once, by ranges of doc_id; only the first row of a range goes to two tasks. Null texts are
    empty; a single document follows itself; repeated rows follow each other; texts of any length are read whole, and a
    task holds two of them; rows without an id, or with one and the same, are sorted by one task (which spills). Other
    columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    n = partitions(spark)
    docs = T.texts(docs)
    cuts = docs.select(F.percentile_approx("doc_id", [k / (4 * n) for k in range(1, 4 * n)], 100 * n).alias("q")).first()["q"]
    bounds = sc.broadcast(np.unique(np.array(cuts or [], np.int64)))
    tops = docs.select("doc_id").mapInArrow(_tops(bounds), "part long, top long").groupBy("part").agg(F.max("top").alias("top"))
    tops = sorted((r.part, r.top) for r in tops.collect())  # at most 4 n + 1 rows
    lend: dict[int, tuple[int, list[int]]] = {}
    for (part, top), above in zip(tops, [*(p for p, _ in tops[1:]), None]):
        # the highest range holds the first document, which follows the last one, in the lowest range
        lend[part] = (top, [tops[0][0]] if above is None else [above])
    dealt = docs.mapInArrow(_deal(bounds, sc.broadcast(lend)), "part long, lent boolean, doc_id long, text string")
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", "lent", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
