"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct k-word shingles (64-bit hashes; a shorter text is one shingle, an empty one has
none). Two sets link when |A & B| >= t |A | B|, here with t = 3/4, so |A ^ B| <= (|A| + |B|) (1-t)/(1+t).

* Sketch: every shingle toggles one bit of a wide sparse bit sketch (its hash's leading bits choose the piece, the rest
  the bit). A piece is kept as the XOR of its toggled hashes. Each element of the symmetric difference changes one
  piece, so the number of differing pieces never exceeds |A ^ B|.
* Pigeonhole per size band: with k = floor(|A|/3) possible differences against any partner, A shares at least
  |pieces| - k non-empty pieces with a partner. Taken in one global order, the first k + h pieces of both then have at
  least h in common. Bands span a factor of 16 in size; a set within 4/3 of the next band joins there too.
* Buckets: sets that share a piece. Each member is verified against its bucket's first one, and large buckets'
  neighbours: a linear number of pairs, whose links join most of what belongs together. Then come the pairs of buckets
  with at most HOT sets that these components leave apart.
* Large buckets: a set with fewer than h rows in them has met every partner in a small bucket. Of the others ("rich":
  they hold passages that many documents share) all pieces are counted, and they join once more in an order that puts
  the frequent pieces last; so shared passages drop out of the first k + 1 pieces, unless they are most of a text. In
  the bucket of the first piece that two partners share, all pieces before it differ, so their ranks there add up to
  |A ^ B| at most, and one rank is at most half of that. The rows of a large bucket are paired under these bounds, those
  outside the bucket's most frequent component with all others; what stays is nearly always one family of near copies.
* Hot pieces: those that a 32nd of all documents show to be in thousands of sets. Their rows are dealt over all tasks by
  set, count as rows of a large bucket wherever they are, and the first sets of the shares are linked by size.
* Verify: Hamming distance of dense parity sketches (it bounds |A ^ B| from below), then the exact sets.

So all components are exact, while links inside a component that it does without are not looked at.

Equal sets are one class from the start, so copies are never paired. The 64-bit class and shingle hashes are taken as
exact: N sets meet by chance N^2/2^65 times, 0.03 at a billion documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.llm import _text as T
from fieldloom.operators.components import connected_components
from fieldloom.operators.shared import BROADCAST_ROWS, checkpoint, partitions, sized, stored

SHINGLE = 5
HOT = 24
#: Frequent pieces that the second order knows, the most frequent ones: 8 bytes each are broadcast. Which ones are known
#: changes the work, not the result.
KNOWN = 500_000
#: Rows that a task gathers before it sends them, and those of a share that it unpacks at a time.
FLUSH, PART = 300_000, 750_000
#: A piece is hot if, of the documents whose hash is divisible by SAMPLED, so many hold it. Which pieces are hot changes
#: where rows go, not the result.
SAMPLED, SHOWN = 32, 64
#: Rows of a large bucket that meet as many others in one task.
CELL = 1_024
_U = np.uint64
_MUL = T.seeded(64, 101) | _U(1)


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles of a block, sorted by both."""
    n = len(offs) - 1
    doc, h = T.words(data, offs, "space")
    per = T.counts(doc, n)
    m = len(h)
    last = max(0, m - k + 1)
    s = np.zeros(last, _U)
    for i in range(k):
        s += h[i : i + last] * _MUL[i]
    ok = doc[:last] == doc[k - 1 : k - 1 + last] if last else np.zeros(0, bool)
    d, s = doc[:last][ok], T.mix(s[ok])
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        at = np.cumsum(per) - per
        whole = np.zeros(len(short), _U)
        for i in range(k - 1):
            has = per[short] > i
            whole[has] += h[at[short[has]] + i] * _MUL[i]
        whole = T.mix(whole + _MUL[32 + per[short]])
        d, s = np.concatenate([d, short]), np.concatenate([s, whole])
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if len(d):
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        d, s = d[new], s[new]
    return d, s


def classes(d: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and class hash of each text; 0 for an empty set."""
    size = T.counts(d, n)
    ids = np.zeros(n, _U)
    if len(d):
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        ids[d[at]] = T.mix(np.add.reduceat(T.mix(s ^ _U(0x5851F42D4C957F2D)), at) + size[d[at]].astype(_U))
    return size, ids


def _band(n: np.ndarray) -> np.ndarray:
    """j with 16^j <= n < 16^(j+1)."""
    return (np.frexp(n.astype(np.float64))[1] - 1) // 4


def _bits(band: np.ndarray) -> np.ndarray:
    """Log2 of the number of pieces: below 4096 elements every element has its own, then 4 to 64 times the size."""
    return np.where(band < 3, 63, 4 * band + 6)


#: Sets below this size join only in bands where every element is a piece of its own, so that ranks can be added.
APART = 3072


def pieces(d: np.ndarray, s: np.ndarray, size: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, key) of the non-empty pieces in the band's sketch of each text with elements in (d, s)."""
    if not len(d):
        return d, s
    part = s >> (64 - _bits(band)[d]).astype(_U)
    at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (part[1:] != part[:-1])])
    doc = d[at]
    return doc, T.mix(np.bitwise_xor.reduceat(s, at) + _MUL[band[doc]])


def first_pieces(doc: np.ndarray, key: np.ndarray, size: np.ndarray, extra: np.ndarray, last: np.ndarray | None = None):
    """The first size // 3 + extra keys of each text, with their ranks, in a global order: by hash, after it those in
    `last` (sorted)."""
    if not len(doc):
        return doc, key, doc
    order = T.mix(key ^ _MUL[63]) >> _U(1)
    if last is not None and len(last):
        order |= (last[np.minimum(np.searchsorted(last, key), len(last) - 1)] == key).astype(_U) << _U(63)
    order = np.lexsort((order, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    rank = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
    keep = rank < size[doc] // 3 + extra[doc]
    return doc[keep], key[keep], rank[keep]


def spare(n: np.ndarray) -> np.ndarray:
    """h: pieces that two partners have in common among those they emit, at least."""
    return np.maximum(1, n // 16)


def dense(s: np.ndarray, size: int) -> np.ndarray:
    """A dense parity sketch of a set, 2 to 4 bits an element, 512 at least; a wider one can be folded to a narrower."""
    bits = max(512, 1 << (int(size).bit_length() + 1))
    at, n = np.unique(T.mix(s) % _U(bits), return_counts=True)
    words = np.zeros(bits, bool)
    words[at[n % 2 == 1].astype(np.int64)] = True
    return np.packbits(words)


def _meta(k: int):
    def run(batches):
        for b in batches:
            for i, j, data, offs in T.blocks(b):
                d, s = shingles(data, offs, k)
                size, ids = classes(d, s, j - i)
                at = np.cumsum(size) - size
                sketch = [dense(s[a : a + n], n).tobytes() if n else b"" for a, n in zip(at, size)]
                (doc_id,) = T.take(b, i, j, "doc_id")
                yield pa.record_batch({"doc_id": doc_id.cast(pa.int64()), "n_shingles": pa.array(size), "set_id": T.signed(ids), "sketch": pa.array(sketch, pa.binary())})

    return run


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def _pack(keys: np.ndarray, ids: np.ndarray, size: np.ndarray, rank: np.ndarray, deal: int, ranked: bool, hot: np.ndarray):
    """Rows (p, blob): the keys of one share p with the sets that have them. Of a key, p and its first 40 bits are kept:
    a chance match only makes a pair that verification drops. Hot keys go by set, to the shares from `deal` on."""
    p = ((keys & _U(0xFFFFFF)) % _U(deal)).astype(np.int64)
    p = np.where(_among(keys, hot), deal + (T.mix(ids) % _U(deal)).astype(np.int64), p)
    order = np.lexsort((ids, p))
    p, keys, ids, size, rank = p[order], keys[order], ids[order], size[order], rank[order].astype(np.uint16)
    at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    blobs = []
    for a, z in zip(at, np.r_[at[1:], len(p)]):
        own = np.flatnonzero(np.r_[True, ids[a + 1 : z] != ids[a : z - 1]])
        n = np.diff(np.r_[own, z - a]).astype(np.uint32)
        k = keys[a:z] >> _U(24)
        head = (np.array([len(own), z - a], np.int64), ids[a:z][own], size[a:z][own].astype(np.uint32), n)
        blobs.append(b"".join(x.tobytes() for x in (*head, (k >> _U(8)).astype(np.uint32), k.astype(np.uint8), rank[a:z] if ranked else rank[:0])))
    return pa.record_batch({"p": pa.array(p[at]), "blob": pa.array(blobs, pa.binary())})


def _unpack(blob: pa.Buffer):
    m, k = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    ids = np.frombuffer(blob, _U, m, 16)
    size, n = np.frombuffer(blob, np.uint32, m, 16 + 8 * m), np.frombuffer(blob, np.uint32, m, 16 + 12 * m)
    high, low = np.frombuffer(blob, np.uint32, k, 16 + 16 * m), np.frombuffer(blob, np.uint8, k, 16 + 16 * m + 4 * k)
    at = 16 + 16 * m + 5 * k
    rank = np.frombuffer(blob.to_pybytes()[at:], np.uint16) if blob.size > at else np.zeros(k, np.uint16)
    return high.astype(_U) << _U(8) | low, np.repeat(ids, n), np.repeat(size, n), rank


def _keys(batches, k: int, ask: np.ndarray | None):
    """Per block: sizes, class ids, and (text index, key) of all pieces in the home band and, for guests, the next one.
    ask: sorted classes to look at, or None for all. A task looks at one text of each class."""
    seen = np.zeros(0, _U)
    for b in batches:
        for i, j, data, offs in T.blocks(b):
            d, s = shingles(data, offs, k)
            size, ids = classes(d, s, j - i)
            first = np.zeros(j - i, bool)
            first[np.unique(ids, return_index=True)[1]] = True
            first &= ~np.isin(ids, seen)
            seen = np.union1d(seen, ids[first])
            d, s = d[first[d]], s[first[d]]
            if ask is not None:
                mine = ids.view(np.int64)
                known = ask[np.minimum(np.searchsorted(ask, mine), len(ask) - 1)] == mine if len(ask) else np.zeros(j - i, bool)
                d, s = d[known[d]], s[known[d]]
            if not len(d):
                continue
            band = _band(np.maximum(size, 1))
            guest = (4 * size >= 3 * (np.int64(16) ** (band + 1)))[d]
            for dd, ss, bb in ((d, s, band), (d[guest], s[guest], band + 1)):
                if len(dd):
                    yield size, ids, *pieces(dd, ss, size, bb)


def _emit(k: int, deal: int, ask=None, last=None, hot=None, flush: int | None = None):
    """Rows (p, blob) of the first pieces; without `last` with h to spare."""
    flush = flush or FLUSH

    def run(batches):
        far = hot.value if hot is not None else np.zeros(0, _U)
        held: list[tuple] = []
        rows = 0
        for size, ids, doc, key in _keys(batches, k, ask and ask.value):
            doc, key, rank = first_pieces(doc, key, size, spare(size) if last is None else np.ones(len(size), np.int64), last and last.value)
            held.append((key, ids[doc], size[doc], np.minimum(rank, 65535)))
            rows += len(doc)
            if rows >= flush:
                yield _pack(*map(np.concatenate, zip(*held)), deal, last is not None, far)
                held, rows = [], 0
        if rows:
            yield _pack(*map(np.concatenate, zip(*held)), deal, last is not None, far)

    return run


def _key_counts(k: int, deal: int, ask, flush: int | None = None):
    """Rows (p, blob) of distinct keys and how often a task has met them."""
    flush = flush or FLUSH

    def pack(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        p = (key % _U(deal)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        p, key, n = p[order], key[order], n[order].astype(np.uint32)
        at = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        blobs = [key[a:z].tobytes() + n[a:z].tobytes() for a, z in zip(at, np.r_[at[1:], len(p)])]
        return pa.record_batch({"p": pa.array(p[at]), "blob": pa.array(blobs, pa.binary())})

    def run(batches):
        held: list[np.ndarray] = []
        rows = 0
        for _, _, _, key in _keys(batches, k, ask and ask.value):
            held.append(key)
            rows += len(key)
            if rows >= flush:
                yield pack(held)
                held, rows = [], 0
        if rows:
            yield pack(held)

    return run


def _frequent(least: int):
    """Keys that more than `least` sets have, with their counts."""

    def run(batches):
        held = [x.as_py() for b in batches for x in b.column("blob")]  # packed
        parts = -(-sum(map(len, held)) // 12 // PART)
        for part in range(parts):
            keys, counts = [], []
            for x in held:
                n = len(x) // 12
                key = np.frombuffer(x, _U, n)
                mine = (key >> _U(8)) % _U(parts) == part
                keys.append(key[mine])
                counts.append(np.frombuffer(x, np.uint32, n, 8 * n)[mine])
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            yield pa.record_batch({"key": T.signed(key[n > least]), "n": pa.array(n[n > least])})

    return run


def _near(na, nb):
    return (4 * na >= 3 * nb) & (4 * nb >= 3 * na)


def _early(key, size):
    """Rows whose pairs a bucket tells in the first round: of larger sets, which share many pieces, those of every m-th
    piece. What a small bucket keeps back here it tells in the second round; a large bucket's rows all meet there."""
    return (key >> _U(24)) % np.clip(size // 48, 1, 8).astype(_U) == 0


def _pairs(kind: int, ids, size, a, b) -> pa.RecordBatch:
    """The distinct pairs of rows whose sets are near enough in size."""
    ok = (ids[a] != ids[b]) & _near(size[a], size[b])
    both = np.unique(np.stack([ids[a[ok]], ids[b[ok]]], 1), axis=0)
    return pa.record_batch({"kind": pa.array(np.full(len(both), kind, np.int32)), "a": T.signed(both[:, 0].copy()), "b": T.signed(both[:, 1].copy()), "n": pa.array(np.zeros(len(both), np.int64)), "rank": pa.array(np.zeros(len(both), np.int32))})


def _buckets(hot: int, deal: int):
    """Of the classes that share a piece: pairs of the first round (kind 0) and of the second (kind 2), each with a < b,
    and the rows (class, bucket) of large buckets (kind 1). A hot piece's buckets are large, and give their first class
    as well (kind 3)."""
    part_rows = PART

    def run(batches):
        # a share is held packed, and its buckets are made for some of the keys at a time
        held = [(p, x) for b in batches for p, x in zip(b.column("p").to_pylist(), b.column("blob").to_pylist())]
        rows = sum(int(np.frombuffer(x, np.int64, 2)[1]) for _, x in held)
        parts = -(-rows // part_rows)
        for part in range(parts):
            for far in (False, True):
                got = []
                for p, x in held:
                    if (p >= deal) == far:
                        key, *rest = _unpack(pa.py_buffer(x))
                        mine = key % _U(parts) == part
                        # a hot piece has one name in all shares
                        got.append((key[mine] << _U(24) | _U(0xFFFFFF if far else p), np.full(mine.sum(), p), *(r[mine] for r in rest)))
                if got:
                    yield from make(far, *(np.concatenate(x) for x in zip(*got)))

    def make(far, key, share, ids, size, rank):
        if not len(key):
            return
        if far:  # a bucket is a piece in one share
            for p in np.unique(share):
                own = share == p
                yield from salted(key[own], ids[own], size[own].astype(np.int64), rank[own])
            return
        size = size.astype(np.int64)
        order = np.lexsort((ids, key))
        key, ids, size, rank = key[order], ids[order], size[order], rank[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
        key, ids, size, rank = key[new], ids[new], size[new], rank[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        rows = np.repeat(n > 1, n)
        key, ids, size, rank = key[rows], ids[rows], size[rows], rank[rows]
        n = n[n > 1]
        if not len(n):
            return
        first = np.cumsum(n) - n
        per, head = np.repeat(n, n), np.repeat(first, n)
        rows = np.arange(len(key))
        small, large = rows[per <= hot], rows[per > hot]
        beside = large[:-1][key[large[:-1]] == key[large[1:]]]
        early = _early(key, size)
        a, b = np.r_[head, beside], np.r_[rows, beside + 1]
        yield _pairs(0, ids, size, a[early[b]], b[early[b]])
        yield pa.record_batch({"kind": pa.array(np.full(len(large), 1, np.int32)), "a": T.signed(ids[large]), "b": T.signed(key[large]), "n": pa.array(size[large]), "rank": pa.array(rank[large].astype(np.int32))})
        rest = [(i, i + gap) for gap in range(1, min(hot, int(n.max()))) for i in [small[small + gap < len(key)]]]
        rest = [(i[key[i] == key[j]], j[key[i] == key[j]]) for i, j in rest]
        rest = [(i[new], j[new]) for i, j in rest for new in [(i != head[i]) | ~early[j]]]
        if rest:
            yield _pairs(2, ids, size, *map(np.concatenate, zip(*rest)))

    def salted(key, ids, size, rank):
        order = np.lexsort((ids, size, key))
        key, ids, size, rank = key[order], ids[order], size[order], rank[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
        key, ids, size, rank = key[new], ids[new], size[new], rank[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        head = np.repeat(first, np.diff(np.r_[first, len(key)]))
        beside = np.flatnonzero(key[:-1] == key[1:])
        rows = np.arange(len(key))
        early = _early(key, size)
        a, b = np.r_[head, beside], np.r_[rows, beside + 1]
        yield _pairs(0, ids, size, a[early[b]], b[early[b]])
        for kind, own in ((1, rows), (3, first)):
            yield pa.record_batch({"kind": pa.array(np.full(len(own), kind, np.int32)), "a": T.signed(ids[own]), "b": T.signed(key[own]), "n": pa.array(size[own]), "rank": pa.array(rank[own].astype(np.int32))})

    return run


def _heads(found: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the first classes of a hot piece's shares that follow each other in size."""
    w = W.partitionBy("b").orderBy("n", "a")  # a row a share
    near = found.where("kind = 3").select(F.col("a").alias("y"), F.lag("a").over(w).alias("x")).where("x <> y")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _hot_pieces(docs: DataFrame, k: int, deal: int) -> np.ndarray:
    """Keys of the KNOWN most frequent hot pieces, sorted."""
    part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLED)) == 0)
    often = part.mapInArrow(_key_counts(k, deal, None), "p long, blob binary").repartition(deal, "p").mapInArrow(_frequent(SHOWN - 1), "key long, n long")
    return np.sort(_column(often.orderBy(F.desc("n"), "key").limit(KNOWN), "key").view(_U))


def _column(df: DataFrame, name: str) -> np.ndarray:
    """A bounded column of longs, collected without a Python object for each."""
    return df.select(name).toArrow().column(0).to_numpy().astype(np.int64)


def _short(s: np.ndarray) -> bytes:
    """A sorted set by the first 48 bits of its hashes; two of n elements agree by chance n^2/2^48 times."""
    s = s >> _U(16)
    return (s >> _U(16)).astype(np.uint32).tobytes() + s.astype(np.uint16).tobytes()


def _long(x: bytes) -> np.ndarray:
    n = len(x) // 6
    return np.frombuffer(x, np.uint32, n).astype(_U) << _U(16) | np.frombuffer(x, np.uint16, n, 4 * n)


def _sets(k: int, wanted):
    """Sets of the texts whose class is wanted (a sorted broadcast, or None for all)."""

    def run(batches):
        ask = None if wanted is None else wanted.value
        for b in batches:
            for i, j, data, offs in T.blocks(b):
                d, s = shingles(data, offs, k)
                size, ids = classes(d, s, j - i)
                mine = ids.view(np.int64)
                if ask is None:
                    rows = np.flatnonzero(size)
                else:
                    at = np.minimum(np.searchsorted(ask, mine), len(ask) - 1)
                    rows = np.flatnonzero((ask[at] == mine) & (size > 0)) if len(ask) else np.zeros(0, np.int64)
                if not len(rows):
                    continue
                at = np.cumsum(size) - size
                own = [s[at[r] : at[r] + size[r]] for r in rows]
                yield pa.record_batch({"set_id": pa.array(mine[rows]), "shingles": pa.array([_short(x) for x in own], pa.binary())})

    return run


def _hamming(batches):
    """Drop pairs whose sketches differ in more bits than their sets may."""
    for b in batches:
        keep = []
        for x, y, na, nb in zip(*(b.column(c).to_pylist() for c in ("x", "y", "na", "nb"))):
            width = min(len(x), len(y))
            p, q = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, width), 0) for z in (x, y))
            keep.append(7 * int(np.bitwise_count(p ^ q).sum()) <= na + nb)
        m = pa.array(keep, pa.bool_())
        yield pa.record_batch({"a": b.column("a").filter(m), "b": b.column("b").filter(m)})


FOLDED = [f"s{i}" for i in range(8)]


def _fold(batches):
    """Sketches folded to 512 bits, as eight numbers that a join can compare."""
    for b in batches:
        rows = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, 64), 0).view(np.int64) for x in b.column("sketch").to_pylist()]
        rows = np.stack(rows) if rows else np.zeros((0, 8), np.int64)
        yield pa.record_batch({"set_id": b.column("set_id"), **{c: pa.array(rows[:, i].copy()) for i, c in enumerate(FOLDED)}})


def _verify(batches):
    for b in batches:
        keep, inter = [], []
        for x, y in zip(b.column("x"), b.column("y")):
            x, y = x.as_py(), y.as_py()
            p, q = _long(x), _long(y)
            same = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * same >= 75 * (len(p) + len(q) - same))
            inter.append(same)
        m = pa.array(keep, pa.bool_())
        yield pa.record_batch({"a": b.column("a").filter(m), "b": b.column("b").filter(m), "shared": pa.array(inter, pa.int64()).filter(m)})


def _checked(docs: DataFrame, pairs: DataFrame, light: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough; sets are made only for pairs that the sketches leave."""
    near = pairs.join(light.toDF("a", "x", "na"), "a").join(light.toDF("b", "y", "nb"), "b")
    near = checkpoint(near.mapInArrow(_hamming, "a long, b long"))
    near = sized(near, near.count())
    sets = _wanted(docs, near.select("a").union(near.select("b")).distinct().toDF("set_id"), k)
    return checkpoint(near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").mapInArrow(_verify, "a long, b long, shared long"))


def _component(links: DataFrame) -> DataFrame:
    return checkpoint(connected_components(links, "a", "b").toDF("set_id", "c"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs of different components."""
    p = pairs.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    return p.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _large_bucket_pairs(rows: DataFrame, comp: DataFrame, light: DataFrame) -> DataFrame:
    """Pairs (a, b) of large buckets' rows in different components that the bounds on size, rank and folded sketches allow."""
    rows = rows.join(comp, "set_id", "left").select("key", "set_id", "n", "rank", F.coalesce("c", "set_id").alias("c"))
    low = (F.col("n") >= APART) | (6 * F.col("rank") <= F.col("n"))
    rows = checkpoint(rows.withColumn("low", low))
    per = rows.groupBy("key", "c").agg(F.count("*").alias("m"))
    top = per.groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    mixed = rows.join(top, "key").select("key", "set_id", "c", "n", "rank", "low", (F.col("c") == F.col("top")).alias("main"))
    folded = light.join(mixed.select("set_id").distinct(), "set_id", "left_semi").mapInArrow(_fold, "set_id long, " + ", ".join(f"{c} long" for c in FOLDED))
    mixed = checkpoint(mixed.join(folded, "set_id").select("key", "set_id", "c", "n", "rank", "low", "main", *FOLDED))
    bits = " + ".join(f"bit_count(x{c} ^ y{c})" for c in FOLDED)
    xs, ys = [f"x{c}" for c in FOLDED], [f"y{c}" for c in FOLDED]
    # rows of one key meet in cells of CELL x CELL at most
    many = rows.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")).where("cells > 1")
    mixed = mixed.join(many, "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("cells"))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    out = None
    for few, all_ in ((mixed.where("not main and low"), mixed), (mixed.where("not main and not low"), mixed.where("low"))):
        x, y = few.toDF("key", "a", "ca", "na", "ra", "la", "ma", *xs, "cells"), all_.toDF("key", "b", "cb", "nb", "rb", "lb", "mb", *ys, "cells")
        x = x.select("*", block("a").alias("i"), every.alias("j")).drop("cells")
        y = y.select("*", every.alias("i"), block("b").alias("j")).drop("cells")
        ok = f"ca <> cb and 4 * na >= 3 * nb and 4 * nb >= 3 * na and 7 * (case when na < {APART} and nb < {APART} then ra + rb else greatest(ra, rb) end) <= na + nb and 7 * ({bits}) <= na + nb"
        j = x.join(y, (x.key == y.key) & (x.i == y.i) & (x.j == y.j) & F.expr(ok)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        out = j if out is None else out.union(j)
    return out


def jaccard_join(docs: DataFrame, k: int = SHINGLE, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of the join.

    documents: doc_id, n_shingles, set_id (class of equal sets), one row per row of docs. links: pairs (a, b) of
    classes that link, with the number of shared shingles: enough of them to connect all that links connect. Null or empty texts have no set and link with nothing, rows without an id are returned but link nothing,
    repeated rows fall into one class; pairs exactly at the threshold link; texts of any length are read whole; an
    empty table gives two empty tables. Columns beyond doc_id and text, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    deal = partitions(spark)
    docs = T.texts(docs)
    meta = checkpoint(docs.mapInArrow(_meta(k), "doc_id long, n_shingles long, set_id long, sketch binary"))
    light = meta.where("n_shingles > 0").groupBy("set_id").agg(F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    packed, bucket = "p long, blob binary", "kind int, a long, b long, n long, rank int"
    far = sc.broadcast(_hot_pieces(docs, k, deal))
    found = stored(docs.mapInArrow(_emit(k, deal, hot=far), packed).repartition(deal, "p").mapInArrow(_buckets(hot, deal), bucket))
    links = _checked(docs, found.where("kind = 0").select("a", "b").union(_heads(found)).distinct(), light, k)
    rest = found.where("kind = 2").select("a", "b")
    # h of the smallest partner; with fewer rows in large buckets a set has met every partner in a small one
    large = found.where("kind = 1").groupBy(F.col("a").alias("set_id")).agg(F.count("*").alias("rows"), F.first("n").alias("n"))
    rich = checkpoint(large.where(F.col("rows") >= F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * 0.75) / 16))).select("set_id"))
    if rich.limit(1).count():
        # up to BROADCAST_ROWS ids of 8 bytes; beyond, every set takes part
        few = rich.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        ask = sc.broadcast(np.sort(_column(rich, "set_id"))) if few else None
        often = docs.mapInArrow(_key_counts(k, deal, ask), packed).repartition(deal, "p").mapInArrow(_frequent(hot), "key long, n long")
        known = often.orderBy(F.desc("n"), "key").limit(KNOWN).toArrow()
        key, n = (known.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
        of = lambda least: sc.broadcast(np.sort(key[n >= least].view(_U)))
        last, far = of(0), of(SAMPLED * SHOWN)
        again = docs.mapInArrow(_emit(k, deal, ask, last, far), packed).repartition(deal, "p").mapInArrow(_buckets(hot, deal), bucket)
        again = stored(again)
        new = again.where("kind = 0").select("a", "b").union(_heads(again)).distinct()
        links = links.union(_checked(docs, _apart(new, _component(links)), light, k))
        rest = rest.union(again.where("kind = 2").select("a", "b"))
    comp = _component(links)
    rest = _apart(rest.distinct(), comp)
    if rich.limit(1).count():
        rest = rest.union(_large_bucket_pairs(again.where("kind = 1").select(F.col("a").alias("set_id"), F.col("b").alias("key"), "n", "rank"), comp, light)).distinct()
    links = links.union(_checked(docs, rest, light, k))
    return meta.drop("sketch"), links


def _wanted(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """One row (set_id, shingles) for each of the ids; up to BROADCAST_ROWS ids are broadcast, more are joined."""
    schema = "set_id long, shingles binary"
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # a sorted array of 8 bytes each
        want = np.sort(_column(ids, "set_id"))
        out = docs.mapInArrow(_sets(k, docs.sparkSession.sparkContext.broadcast(want)), schema)
    else:
        out = docs.mapInArrow(_sets(k, None), schema).join(ids, "set_id", "left_semi")
    return out.groupBy("set_id").agg(F.first("shingles").alias("shingles"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that a document reaches by links, itself included."""
    meta, links = jaccard_join(docs, k, hot)
    meta = meta.withColumn("set_id", F.when(F.col("n_shingles") > 0, F.col("set_id")))
    first = meta.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    comp = connected_components(links, "a", "b").withColumnRenamed("node", "set_id")
    first = first.join(comp, "set_id", "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("c"))
    low = first.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    first = first.join(low, "c").select("set_id", "component_id")
    return meta.join(first, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
