"""Set membership: overlaps, quality against ground truth, filters and near-duplicate removal of segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from fieldloom.operators.components import connected_components
from fieldloom.operators.shared import LEAST_TASKS, checkpoint, stored


def sizes(seg: DataFrame) -> DataFrame:
    return seg.groupBy("image_id", "segment_id").agg(F.count("*").alias("n"))


def members(seg: DataFrame) -> DataFrame:
    """One row a segment: image_id, segment_id, x (64-bit hashes of its elements, which are taken as exact). Sets stay as they are."""
    if "x" in seg.columns:
        return seg
    h = seg.select("image_id", "segment_id", F.xxhash64("pixel_id").alias("h"))
    return h.groupBy("image_id", "segment_id").agg(F.collect_set("h").alias("x"))


#: Segments of a block (about: they are dealt by hash), pairs that a cell holds at a time, common elements that it multiplies
#: at a time, and the share of a cell's pairs from which on an element is multiplied, not listed.
BLOCK, HELD, WIDTH, COMMON = 8_192, 1 << 21, 1_024, 0.005


def _leb(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes, seven bits each, and how many bytes each takes."""
    n = 1 + sum((v >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    start = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max()) if len(n) else 0):
        has = n > k
        out[start[has] + k] = (v[has] >> 7 * k & 127) | ((n[has] > k + 1) << 7)
    return out, n


def _unleb(x: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(x < 128)
    start = np.r_[0, last[:-1] + 1][: len(last)]
    place = np.arange(len(x)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((x & 127).astype(np.int64) << 7 * place, start) if len(x) else np.zeros(0, np.int64)


def packed(m: DataFrame) -> DataFrame:
    """Sets of blocks (image_id, block, segment_id, x and more columns) with x as bytes and a column words.

    The elements of a block are numbered by falling frequency, and a set is the gaps between its sorted numbers, most of
    them one byte instead of eight. One row of each block has its elements by number as words."""
    rest = [c for c in m.columns if c != "x"]

    def run(x: pa.Table) -> pa.Table:
        sets = x["x"].combine_chunks()
        length = np.diff(sets.offsets.to_numpy())
        words, code, many = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        by = np.argsort(-many, kind="stable")
        number = np.empty(len(words), np.int64)
        number[by] = np.arange(len(words))
        row = np.repeat(np.arange(len(x)), length)
        code = np.sort(row * max(1, len(words)) + number[code]) - row * len(words)
        gap = np.diff(code, prepend=0)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        gap[first] = code[first]
        data, n = _leb(gap)
        ends = np.r_[0, np.cumsum(np.bincount(row, n, minlength=len(x)))].astype(np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        return pa.table([*(x[c] for c in rest), out, pa.array([words[by].tobytes(), *[None] * (len(x) - 1)], pa.binary())], [*rest, "x", "words"])

    more = [T.StructField("x", T.BinaryType()), T.StructField("words", T.BinaryType())]
    return m.groupBy("image_id", "block").applyInArrow(run, T.StructType([*(m.schema[c] for c in rest), *more]))


def _elements(x: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of packed() that have a set, their sizes, and their elements row by row, numbered over all blocks."""
    words = x.filter(pc.is_valid(x["words"]))
    x = x.filter(pc.is_valid(x["x"]))
    own = [np.frombuffer(w, np.int64) for w in words["words"].to_pylist()]
    common = np.unique(np.concatenate(own), return_inverse=True)[1] if own else np.zeros(0, np.int64)
    start = dict(zip(words["block"].to_pylist(), np.cumsum([0, *map(len, own)]).tolist()))
    ends = np.r_[0, np.cumsum(pc.binary_length(x["x"]).to_numpy())]
    data = np.frombuffer(b"".join(x["x"].to_pylist()), np.uint8)
    size = np.diff(np.r_[0, np.cumsum(data < 128)][ends])
    total = np.r_[0, np.cumsum(_unleb(data))]
    first = np.cumsum(size) - size
    block, at = np.unique(x["block"].to_numpy(), return_inverse=True)
    shift = np.array([start.get(b, 0) for b in block.tolist()], np.int64)[at]
    return x, size, common[total[1:] - np.repeat(total[first] - shift, size)]


def blocks(m: DataFrame) -> DataFrame:
    """image_id, blocks: the blocks of an image for comparing all its pairs."""
    few = F.least(F.lit(4), F.ceil(F.count("*") / max(1, BLOCK // 4)))
    return m.groupBy("image_id").agg(F.greatest(few, F.ceil(F.count("*") / BLOCK)).alias("blocks"))


def in_blocks(m: DataFrame, many: DataFrame) -> DataFrame:
    # one row an image; a join by shuffle would leave an image in one partition, where its blocks and cells then stay
    return m.join(F.broadcast(many), "image_id").withColumn("block", F.pmod(F.xxhash64("segment_id", F.lit(3)), F.col("blocks")))


def cells(m: DataFrame) -> DataFrame:
    """Sets (image_id, segment_id, x and more columns), packed and dealt for comparing all pairs of an image: segments go to
    blocks, every two blocks make a cell (i, j), and a segment has a row in each cell of its block.

    An image of more than 4 BLOCK segments repeats each set once a BLOCK segments, a smaller one four times at most."""
    m = packed(in_blocks(m, blocks(m)))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o", "blocks")


def counts(block: np.ndarray, row: np.ndarray, code: np.ndarray, i: int, j: int):
    """(left, right, |A & B|) of a cell as matrices of some HELD pairs: segments of block i by those of block j, with their
    numbers. block: by segment; row and code: segment and element, one by one, in the order of rows. Where i = j, only pairs of left < right are sure to be right.

    Counts of elements that many of the pairs share are products of 0/1 matrices, those of all others are added up from
    the lists of their segments."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    n, m, words = len(left), len(right), int(code.max()) + 1 if len(code) else 0
    at = np.empty(len(block), np.int64)
    at[left] = np.arange(n)
    if i != j:
        at[right] = np.arange(m)
    own = block[row] == i
    lr, lc = at[row[own]], code[own]
    rr, rc = (lr, lc) if i == j else (at[row[~own]], code[~own])
    dl, dr = np.bincount(lc, minlength=words), np.bincount(rc, minlength=words)
    used = (dl > 0) & (dr > (i == j))
    common = used & (dl * dr > COMMON * n * m)
    number = np.cumsum(common) - 1
    by = np.argsort(lr, kind="stable")
    lr, lc = lr[by], lc[by]
    by = np.argsort(rc, kind="stable")
    listed, start = rr[by], np.r_[0, np.cumsum(dr)]
    pick = common[rc]
    wide_r, wide_c = rr[by][pick[by]], number[rc[by][pick[by]]]
    step = max(1, HELD // max(1, m))
    for s in range(0, n, step):
        h = min(step, n - s)
        lo, hi = np.searchsorted(lr, (s, s + h))
        r, c = lr[lo:hi] - s, lc[lo:hi]
        inter = np.zeros((h, m), np.float32)
        past = s if i == j else 0
        pick = common[c]
        r1, c1 = r[pick], number[c[pick]]
        for k in range(0, int(common.sum()), WIDTH):
            one, two = np.zeros((h, WIDTH), np.float32), np.zeros((m, WIDTH), np.float32)
            here = (c1 >= k) & (c1 < k + WIDTH)
            one[r1[here], c1[here] - k] = 1
            here = slice(*np.searchsorted(wide_c, (k, k + WIDTH)))  # the lists are in the order of elements
            two[wide_r[here], wide_c[here] - k] = 1
            inter[:, past:] += one @ two[past:].T
        pick = used[c] & ~common[c]
        r, c = r[pick], c[pick]
        ends = np.cumsum(dr[c])
        lo = 0
        while lo < len(c):  # some HELD entries of the lists at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD, "right")))
            many = dr[c[lo:hi]]
            first = np.repeat(start[c[lo:hi]] - np.cumsum(many) + many, many)
            meets = np.repeat(r[lo:hi] * m, many) + listed[first + np.arange(len(first))]
            inter += np.bincount(meets, minlength=h * m).reshape(h, m)
            lo = hi
        yield left[s : s + h], right, inter


def strips(block: np.ndarray, row: np.ndarray, code: np.ndarray, i: int, j: int):
    """(a, b, |A & B|) of a cell's overlapping pairs (a < b), some HELD at a time."""
    for left, right, inter in counts(block, row, code, i, j):
        a, b = np.nonzero(inter)
        both = inter[a, b].astype(np.int64)
        a, b = left[a], right[b]
        if i == j:
            keep = a < b
            a, b, both = a[keep], b[keep], both[keep]
        yield np.minimum(a, b), np.maximum(a, b), both


def _rounded(p: np.ndarray, q: np.ndarray, digits: int | None) -> np.ndarray:
    """p / q of whole numbers, to so many digits, half up."""
    return p / q if digits is None else (2 * p * 10**digits + q) // (2 * q) / 10.0**digits


def compared(m: DataFrame, run, schema: str) -> DataFrame:
    """run(image, cell's rows as a table in the order of ids, sizes, strips()) over all cells of the sets m; it yields
    record batches of the schema."""

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, size, code = _elements(pa.Table.from_batches(list(batches)))
        order = np.argsort(x["segment_id"].to_numpy(), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        x = x.drop_columns(["x", "words"]).take(pa.array(order))
        found = strips(x["block"].to_numpy(), np.repeat(place, size), code, key[1].as_py(), key[2].as_py())
        yield from run(key[0].as_py(), x, size[order], found)

    return cells(m).groupBy("image_id", "i", "j").applyInArrow(cell, schema)


def largest(new: DataFrame, left: DataFrame, own: DataFrame, many: DataFrame) -> DataFrame:
    """image_id, segment_id, now: the largest IoU of each of `left` (image_id, segment_id) with the sets `new` of its image
    (image_id, segment_id, x), where there is one above 0.

    own: packed() sets of the images, in the blocks that `many` tells (blocks()). Blocks of `new` meet all of them in cells;
    ids of `left` go to the cells too, which leave out all other rows."""
    parts = F.broadcast(new.groupBy("image_id").agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
    m = new.join(parts, "image_id").join(F.broadcast(many), "image_id")
    m = packed(m.withColumn("block", -1 - F.pmod(F.xxhash64("segment_id", F.lit(4)), F.col("parts"))))
    columns = ["image_id", "i", "j", "block", "segment_id", "x", "words"]
    m = m.withColumns({"i": F.col("block"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).select(*columns)
    none = F.lit(None).cast("binary")
    rows = own.select("image_id", "block", "segment_id", "x", "words").union(in_blocks(left.select("image_id", "segment_id"), many).select("image_id", "block", "segment_id", none, none))
    rows = rows.join(parts, "image_id").withColumns({"i": F.explode(F.sequence(-F.col("parts"), F.lit(-1))), "j": F.col("block")})

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = pa.Table.from_batches(list(batches))
        asked = x.filter(pc.is_null(x["x"]))["segment_id"].to_numpy()
        x, size, code = _elements(x)
        ids, block = x["segment_id"].to_numpy(), x["block"].to_numpy()
        keep = (block < 0) | np.isin(ids, asked)
        place, each = np.cumsum(keep) - 1, np.repeat(keep, size)
        row = np.repeat(place, size)[each]
        ids, block, size = ids[keep], block[keep], size[keep]
        most = np.zeros(len(ids))
        for a, b, inter in counts(block, row, code[each], key[1].as_py(), key[2].as_py()):
            both = inter.astype(float)
            if both.size:
                most[b] = np.maximum(most[b], (both / np.maximum(1, size[a][:, None] + size[b][None, :] - both)).max(0))
        has = most > 0
        yield pa.RecordBatch.from_arrays([pa.repeat(key[0], int(has.sum())), pa.array(ids[has]), pa.array(most[has])], ["image_id", "segment_id", "now"])

    found = m.union(rows.select(*columns)).groupBy("image_id", "i", "j").applyInArrow(cell, "image_id string, segment_id long, now double")
    return found.groupBy("image_id", "segment_id").agg(F.max("now").alias("now"))


def iou(seg: DataFrame, least: int = 1, most: int | None = None, digits: int | None = None, features: tuple[str, ...] = ()) -> DataFrame:
    """|A & B| and |A & B| / |A | B| of the overlapping pairs a < b of an image: image_id, a, b, inter, iou.

    Only pairs that share `least` to `most` elements are given, iou with `digits` if they are named. seg: image_id,
    segment_id, pixel_id, or sets as members() gives them. Their columns (double) named in `features` follow as <name>_a and <name>_b,
    after the sizes n_a and n_b.

    The output has a row for each pair, so the work is dealt by pairs too, in cells: sets are repeated once a BLOCK segments
    of the image, and pairs leave a cell without a further shuffle. No element, however common, and no image, however large,
    is joined or grouped as a whole.
    """
    more = "".join(f", {c}_{e} {t}" for c, t in (("n", "long"), *((f, "double") for f in features)) for e in "ab") if features else ""

    def run(image, x, size, found):
        ids = x["segment_id"].to_numpy()
        for a, b, inter in found:
            keep = inter >= least if most is None else (inter >= least) & (inter <= most)
            a, b, inter = a[keep], b[keep], inter[keep]
            for s in range(0, len(a), ROWS):
                p, q, n = a[s : s + ROWS], b[s : s + ROWS], inter[s : s + ROWS]
                out = [pa.repeat(pa.scalar(image, pa.string()), len(p)), pa.array(ids[p]), pa.array(ids[q]), pa.array(n), pa.array(_rounded(n, size[p] + size[q] - n, digits))]
                if features:
                    out += [pa.array(size[e].astype(np.int64)) for e in (p, q)]
                out += [x[f].combine_chunks().take(pa.array(e)) for f in features for e in (p, q)]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"image_id string, a long, b long, inter long, iou double{more}"
    names = [c.split()[0] for c in schema.split(", ")]
    return compared(members(seg).select("image_id", "segment_id", "x", *features), run, schema)


#: Pairs of a batch that a cell gives back.
ROWS = 1 << 18


def intersections(seg: DataFrame) -> DataFrame:
    """|A & B| of the overlapping pairs a < b of an image; the diagonal counts 1, whatever the size."""
    m = members(seg)
    one = m.where(F.size("x") > 0).select("image_id", F.col("segment_id").alias("a"), F.col("segment_id").alias("b"), F.lit(1).cast("long").alias("inter"))
    return iou(m).select("image_id", "a", "b", "inter").union(one)


def _bits(x: np.ndarray) -> list[bytes]:
    """Rows of a 0/1 matrix, packed."""
    return [r.tobytes() for r in np.packbits(x, axis=1)]


def _unpacked(rows: list[bytes], n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1, count=n).astype(bool)


def _meet(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the rows x[p] and y[q] of packed bits share one; most do early, so 64 bytes are looked at at a time."""
    hit = np.zeros(len(p), bool)
    for s in range(0, len(p), ROWS):
        open_ = np.arange(s, min(s + ROWS, len(p)))
        for c in range(0, x.shape[1], 64):
            found = (x[p[open_], c : c + 64] & y[q[open_], c : c + 64]).any(1)
            hit[open_[found]] = True
            open_ = open_[~found]
            if not len(open_):
                break
    return hit


def two_hops(seg: DataFrame, least: int, most: int) -> DataFrame:
    """image_id, a, b: the pairs a < b of an image that share no element, but have a common neighbour, where neighbours
    share `least` to `most` elements (least is 1 or more).

    Paths over the neighbours grow with the cube of an image and are never made: each cell of pairs gives its segments'
    neighbours and its open pairs (those without a common element) as bits, a row a segment and cell, an eighth of a byte
    a pair. Open pairs are then looked up in the neighbours of one block after the other, until none is left; a round brings
    each cell the bits of its two blocks' segments for one block of neighbours.
    """
    key_ = ["image_id", "i", "j"]
    names = [*key_, "segment_id", "near", "open"]
    schema = "image_id string, i long, j long, segment_id long, near binary, open binary"

    def table(image, i, j, ids, near, open_):
        n = len(ids)
        of = lambda v: pa.repeat(pa.scalar(v, pa.int64()), n)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(image, pa.string()), n), of(i), of(j), pa.array(ids), pa.array(near, pa.binary()), pa.array(open_, pa.binary())], names)

    def run(image, x, size, found):
        ids, block = x["segment_id"].to_numpy(), x["block"].to_numpy()
        i, j = x["i"][0].as_py(), x["j"][0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        at = np.empty(len(ids), np.int64)
        at[left] = np.arange(len(left))
        at[right] = np.arange(len(right))
        near, open_ = np.zeros((len(left), len(right)), bool), np.ones((len(left), len(right)), bool)
        for a, b, inter in found:
            turn = block[a] != i
            p, q = at[np.where(turn, b, a)], at[np.where(turn, a, b)]
            keep = (inter >= least) & (inter <= most)
            open_[p, q] = False
            near[p[keep], q[keep]] = True
            if i == j:
                near[q[keep], p[keep]] = True
        if i == j:
            open_ = np.triu(open_, 1)
        some = open_.any(1)
        zero = iter(_bits(open_[some]))
        yield table(image, i, j, ids[left], _bits(near), [next(zero) if s else None for s in some])
        if i != j:
            yield table(image, j, i, ids[right], _bits(near.T), [None] * len(right))

    def look(key: tuple[pa.Scalar, ...], x: pa.Table) -> pa.Table:
        image, i, j = (k.as_py() for k in key)
        x = x.sort_by("segment_id")
        todo, near = x.filter(pc.is_valid(x["open"])), x.filter(pc.is_valid(x["near"]))
        if not len(near):  # no segments in this block of neighbours
            return todo.append_column("b", pa.nulls(len(todo), pa.list_(pa.int64()))).select([*key_, "segment_id", "b", "open"])
        one, two = (near.filter(pc.equal(near["block"], k)) for k in (i, j))
        own, ids = todo["segment_id"].to_numpy(), two["segment_id"].to_numpy()
        place = np.searchsorted(one["segment_id"].to_numpy(), own)
        one, two = (np.frombuffer(b"".join(s["near"].to_pylist()), np.uint8).reshape(len(s), -1) for s in (one, two))
        has, found, rest = two.any(1), [], []
        step = max(1, HELD // len(ids))
        for s in range(0, len(todo), step):
            open_ = _unpacked(todo["open"].slice(s, step).to_pylist(), len(ids))
            p, q = np.nonzero(open_ & has)
            hit = _meet(one, two, place[s + p], q)
            open_[p[hit], q[hit]] = False
            ends = np.searchsorted(p[hit], np.arange(len(open_) + 1))
            found.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[q[hit]])))
            rest += [r if more else None for r, more in zip(_bits(open_), open_.any(1))]
        out = [todo[c] for c in (*key_, "segment_id")]
        return pa.table([*out, pa.chunked_array(found, pa.list_(pa.int64())), pa.array(rest, pa.binary())], [*key_, "segment_id", "b", "open"])

    t = stored(compared(members(seg).select("image_id", "segment_id", "x"), run, schema))
    todo = t.where("open is not null").select(*key_, "segment_id", "open")
    out = t.select("image_id", F.col("segment_id").alias("a"), F.col("segment_id").alias("b")).limit(0)
    for k in range((t.agg(F.max("j")).first()[0] or 0) + 1):
        if todo.isEmpty():
            break
        cell = todo.select(*key_).distinct().withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
        near = t.where(F.col("j") == k).select("image_id", F.col("i").alias("block"), "segment_id", "near").join(cell, ["image_id", "block"])
        none = F.lit(None)
        rows = near.select(*key_, "block", "segment_id", "near", none.cast("binary").alias("open")).union(todo.select(*key_, none.cast("long"), "segment_id", none.cast("binary"), "open"))
        seen = stored(rows.groupBy(*key_).applyInArrow(look, "image_id string, i long, j long, segment_id long, b array<long>, open binary"))
        todo = seen.where("open is not null").select(*key_, "segment_id", "open")
        pair = seen.select("image_id", "segment_id", F.explode("b").alias("b"))
        out = out.union(pair.select("image_id", F.least("segment_id", "b").alias("a"), F.greatest("segment_id", "b").alias("b")))
    return out


def _forest(a: np.ndarray, b: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The edges (their numbers) of the forest of the largest v over n nodes, by v falling, then a, b."""
    order = np.lexsort((a * n + b, -v))
    root, at, out = np.arange(n), np.arange(len(order)), []
    p, q = a[order], b[order]
    while True:
        u, w = root[p[at]], root[q[at]]
        keep = u != w
        at, u, w = at[keep], u[keep], w[keep]
        if not len(at):
            return order[np.unique(np.concatenate(out))] if out else order[:0]
        best = np.full(n, len(order))
        best[u[::-1]] = at[::-1]
        other = np.full(n, len(order))
        other[w[::-1]] = at[::-1]
        best = np.minimum(best, other)
        has = np.flatnonzero(best < len(order))
        edge = best[has]
        out.append(edge)
        up = np.arange(n)
        up[has] = np.where(root[p[edge]] == has, root[q[edge]], root[p[edge]])
        both = up[up] == np.arange(n)  # two components that chose the same edge
        up[both] = np.minimum(up[both], np.flatnonzero(both))
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def linkage_edges(seg: DataFrame) -> DataFrame:
    """Of all overlapping pairs (image_id, a, b, iou), those that can be in an image's forest of the largest overlaps (ties
    by a, b): the forests of its cells, so each cell gives fewer edges than it has segments."""

    def run(image, x, size, found):
        ids = x["segment_id"].to_numpy()
        p, q, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for a, b, inter in found:
            p, q, v = np.r_[p, a], np.r_[q, b], np.r_[v, inter / (size[a] + size[b] - inter)]
            keep = _forest(p, q, v, len(ids))
            p, q, v = p[keep], q[keep], v[keep]
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(image, pa.string()), len(p)), pa.array(ids[p]), pa.array(ids[q]), pa.array(v)], ["image_id", "a", "b", "iou"])

    return compared(members(seg).select("image_id", "segment_id", "x"), run, "image_id string, a long, b long, iou double")


def near_classes(seg: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(image_id, segment_id, class) and (image_id, a, b, iou): classes of equal segments of an image (named by their
    smallest id), and the pairs of classes with an IoU of at least `least`.

    Elements are ordered by rarity in their image; two segments that are alike enough share one of the first
    n - ceil(least n) + 1, and their sizes differ little. Such pairs are candidates and then compared whole.
    """
    h = members(seg).select("image_id", "segment_id", F.explode("x").alias("h"))
    rare = h.groupBy("image_id", "h").agg(F.count("*").alias("f"))
    x = h.join(rare, ["image_id", "h"]).groupBy("image_id", "segment_id").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("x"))
    x = x.withColumn("x", F.transform("x", lambda e: e["h"])).withColumn("key", F.xxhash64("x"))
    first = x.groupBy("image_id", "key").agg(F.min("segment_id").alias("class"))
    x = checkpoint(x.join(first, ["image_id", "key"]).select("image_id", "segment_id", "class", "x"))
    own = x.where("segment_id = class").select("image_id", "class", F.size("x").alias("n"), "x")
    need = F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int")
    post = own.select("image_id", "class", "n", F.explode(F.slice("x", F.lit(1), F.col("n") - need + 1)).alias("h"))
    a, b = post.toDF("image_id", "a", "na", "h"), post.toDF("image_id", "b", "nb", "h")
    ok = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least) - 1e-9)
    pairs = a.join(b, ["image_id", "h"]).where(ok).select("image_id", "a", "b").distinct()
    sets = own.select("image_id", "class", "x")
    pairs = pairs.join(sets.toDF("image_id", "a", "xa"), ["image_id", "a"]).join(sets.toDF("image_id", "b", "xb"), ["image_id", "b"])
    pairs = pairs.withColumn("inter", F.size(F.array_intersect("xa", "xb")))
    pairs = pairs.select("image_id", "a", "b", (F.col("inter") / (F.size("xa") + F.size("xb") - F.col("inter"))).alias("iou"))
    return x.drop("x"), pairs.where(F.col("iou") >= least)


def cross_counts(gt: DataFrame, seg: DataFrame, key: list[str]) -> DataFrame:
    """Per ground-truth object and segment of an image: inter, ng, nm (0 intersections included)."""
    ng = gt.groupBy("image_id", "object_id").agg(F.count("*").alias("ng"))
    nm = seg.groupBy("image_id", "segment_id").agg(F.count("*").alias("nm"))
    inter = gt.join(seg, ["image_id", *key]).groupBy("image_id", "object_id", "segment_id").agg(F.count("*").alias("inter"))
    return ng.join(nm, "image_id").join(inter, ["image_id", "object_id", "segment_id"], "left").fillna(0, ["inter"])


def quality_care(gt: DataFrame, seg: DataFrame, void: DataFrame, key: list[str]) -> DataFrame:
    """IoU of objects and segments outside the void pixels."""
    on = ["image_id", *key]
    n = cross_counts(gt.join(void, on, "left_anti"), seg.join(void, on, "left_anti"), key)
    return n.withColumn("q", F.col("inter") / (F.col("ng") + F.col("nm") - F.col("inter")))


def precision_recall(gt: DataFrame, seg: DataFrame, key: list[str]) -> DataFrame:
    n = cross_counts(gt, seg, key)
    r, p = F.col("inter") / F.col("ng"), F.col("inter") / F.col("nm")
    f = F.when(F.col("inter") == 0, 0.0).otherwise(r * p / (0.5 * (r + p)))
    return n.select("image_id", "object_id", "segment_id", p.alias("precision"), r.alias("recall"), f.alias("f"))


#: Boxes of each side that meet in a cell's block (about: they are dealt by hash), pairs that a task compares, and the tasks
#: that these give at most.
BOXES, COMPARED, MOST_TASKS = 4_096, 1 << 23, 10_000


def box_iou(a: DataFrame, b: DataFrame, digits: int | None = None) -> DataFrame:
    """IoU of the overlapping boxes of two tables, by image, with `digits` if they are named; a grid of cells, as wide and
    high as the mean box, makes it an equi-join.

    The output has a row for each pair, so the work is dealt by the pairs of the cells: the boxes of a full cell go to
    blocks of some BOXES, every two of which meet in a key of their own, and the tasks are as many as the pairs need. Sides
    are merged, not broadcast, as their files say little of their rows in cells.
    """
    key = ["image_id", "cx", "cy"]
    wide, high = (F.avg(F.greatest(F.lit(0.0), F.col(f"{c}2") - F.col(f"{c}1"))) for c in "xy")
    mean = a.select("x1", "x2", "y1", "y2").union(b.select("x1", "x2", "y1", "y2")).agg(wide, high).first()
    wide, high = (F.lit(float(side or 1.0)) for side in mean)

    def cells(df, p):
        e = df.select("image_id", *(F.col(c).cast("long" if c == "box_id" else "double").alias(f"{c}_{p}") for c in ("box_id", "x1", "y1", "x2", "y2")))
        e = e.withColumns({f"cx_{p}": F.floor(F.col(f"x1_{p}") / wide), f"cy_{p}": F.floor(F.col(f"y1_{p}") / high)})
        e = e.withColumn("cx", F.explode(F.sequence(F.col(f"cx_{p}"), F.floor(F.col(f"x2_{p}") / wide))))
        return e.withColumn("cy", F.explode(F.sequence(F.col(f"cy_{p}"), F.floor(F.col(f"y2_{p}") / high))))

    a, b = cells(a, "a"), cells(b, "b")
    many = a.groupBy(*key).agg(F.count("*").alias("na")).join(b.groupBy(*key).agg(F.count("*").alias("nb")), key)
    many = checkpoint(many.select(*key, "na", "nb", F.ceil(F.col("na") / BOXES).alias("ba"), F.ceil(F.col("nb") / BOXES).alias("bb")))
    pairs = many.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0.0
    tasks = min(MOST_TASKS, LEAST_TASKS + int(pairs / COMPARED))
    many = many.drop("na", "nb")

    def dealt(df, p, own, other):
        e = df.join(many, key).withColumn(own, F.pmod(F.xxhash64(f"box_id_{p}"), F.col(f"b{own}"))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"b{other}") - 1)))
        return e.drop("ba", "bb").repartition(tasks, *key, "a", "b")

    j = dealt(a, "a", "a", "b").join(dealt(b, "b", "b", "a").hint("merge"), [*key, "a", "b"])
    # the pair is reported from the cell of its intersection's corner alone
    j = j.where((F.col("cx") == F.greatest("cx_a", "cx_b")) & (F.col("cy") == F.greatest("cy_a", "cy_b")))
    w = F.least("x2_a", "x2_b") - F.greatest("x1_a", "x1_b")
    h = F.least("y2_a", "y2_b") - F.greatest("y1_a", "y1_b")
    j = j.where((w > 0) & (h > 0))
    area = lambda p: (F.col(f"x2_{p}") - F.col(f"x1_{p}")) * (F.col(f"y2_{p}") - F.col(f"y1_{p}"))
    iou = w * h / (area("a") + area("b") - w * h)
    if digits is not None:  # half up, without the decimals of round()
        iou = F.floor(iou * 10.0**digits + 0.5) / 10.0**digits
    return j.select("image_id", F.col("box_id_a").alias("a"), F.col("box_id_b").alias("b"), iou.alias("iou"))


def min_size(seg: DataFrame, least: int = 150) -> DataFrame:
    """Sizes of the segments with at least so many pixels."""
    return sizes(seg).where(F.col("n") >= least)


def max_energy(segs: DataFrame, most: float, least_n: int) -> DataFrame:
    """Segments of energy <= most; where fewer than least_n are left in an image, its least_n lowest."""
    w = W.partitionBy("image_id")
    s = segs.withColumn("rank", F.row_number().over(w.orderBy("energy", "segment_id")))
    s = s.withColumn("good", F.count(F.when(F.col("energy") <= most, 1)).over(w))
    return s.where((F.col("rank") <= least_n) | ((F.col("energy") <= most) & (F.col("good") >= least_n))).where(
        (F.col("good") >= least_n) & (F.col("energy") <= most) | (F.col("good") < least_n) & (F.col("rank") <= least_n)
    ).select("image_id", "segment_id", "energy")


def lowest_energy(members: DataFrame, by: list[str]) -> DataFrame:
    """The row of lowest energy of each group; the smallest id on ties."""
    w = W.partitionBy(*by).orderBy("energy", "segment_id")
    return members.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dissimilar(seg: DataFrame, segs: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """Near-duplicate removal: clusters of pairs with 1 - IoU < cutoff by single linkage; the lowest energy stays.

    segment_id is unique over all images."""
    classes, near = near_classes(seg, 1 - cutoff)
    near = checkpoint(near.where(1 - F.col("iou") < cutoff))
    comp = connected_components(near, "a", "b").toDF("class", "cluster")
    comp = classes.join(comp, "class", "left").select("segment_id", F.coalesce("cluster", "class").alias("cluster"))
    out = segs.join(comp, "segment_id", "left").withColumn("cluster", F.coalesce("cluster", "segment_id"))
    return lowest_energy(out, ["image_id", "cluster"])


def without_repeats(seg: DataFrame, segs: DataFrame, most: float = 0.98) -> DataFrame:
    """Drop segments that a later one of the image overlaps by more than `most`."""
    classes, near = near_classes(seg, most)
    last = classes.groupBy("image_id", "class").agg(F.max("segment_id").alias("last"))
    near = near.where(F.col("iou") > most)
    both = near.select("image_id", F.col("a").alias("class"), F.col("b").alias("o")).union(near.select("image_id", "b", "a"))
    other = both.join(last.toDF("image_id", "o", "last"), ["image_id", "o"]).select("image_id", "class", "last")
    last = last.union(other).groupBy("image_id", "class").agg(F.max("last").alias("last"))
    gone = classes.join(last, ["image_id", "class"]).where("segment_id < last").select("image_id", "segment_id")
    return segs.join(gone, ["image_id", "segment_id"], "left_anti")
