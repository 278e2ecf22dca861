"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is SIZE consecutive words of an item, or the whole of a shorter item. It must be contained whole, so the
necessary prefix of a window is one word: the rarest in the corpus (counted over all documents; ties by hash). A
document word that equals such a prefix gives a candidate; its offset in the window gives the only start that it can
have (positional bound), which must leave room for the window inside the document (length bound); all words of the
window are then compared in order. Hits never cross documents.

Items are taken in blocks of at most BLOCK_WORDS words; a longer item is cut into parts that share all but one word of a
window. One block, a proven bound of some 100 MB in the worst case, is on the driver and broadcast at a time (and the
next one read); more blocks are further passes over documents, each adding to what the earlier ones found.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T
from fieldloom.operators.shared import checkpoint

SIZE = 10
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_WORDS = 1_000_000
_STEP = 1 << 20


def item_windows(items: list[tuple], size: int) -> dict:
    """Distinct windows of (item_id, text) pairs: word hashes padded to size, lengths, and the items of each."""
    hashes = T.hash_words([t or "" for _, t in items], "alnum")
    rows: dict[bytes, list] = {}
    for (name, _), h in zip(items, hashes):
        for i in range(max(1, len(h) - size + 1) if len(h) else 0):
            rows.setdefault(h[i : i + size].tobytes(), []).append(None if name is None else str(name))
    words = np.zeros((len(rows), size), np.uint64)
    length = np.zeros(len(rows), np.int64)
    for r, key in enumerate(rows):
        w = np.frombuffer(key, np.uint64)
        words[r, : len(w)], length[r] = w, len(w)
    return {"words": words, "length": length, "items": [set(x) for x in rows.values()]}


def with_prefixes(win: dict, vocabulary: np.ndarray, freq: np.ndarray) -> dict:
    """Each window filed under its rarest word, with that word's offset."""
    w, n = win["words"], win["length"]
    f = freq[np.searchsorted(vocabulary, w).clip(0, max(0, len(vocabulary) - 1))].astype(np.float64)
    f[np.arange(w.shape[1])[None, :] >= n[:, None]] = np.inf
    low = f == f.min(1, keepdims=True)
    offset = np.where(low, w, np.uint64(0xFFFFFFFFFFFFFFFF)).argmin(1)
    prefix = w[np.arange(len(w)), offset]
    order = np.argsort(prefix, kind="stable")
    keys, first, many = np.unique(prefix[order], return_index=True, return_counts=True)
    return win | {"keys": keys, "first": first, "many": many, "order": order, "offset": offset}


def occurrences(h: np.ndarray, doc: np.ndarray, n_docs: int, win: dict) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of each occurrence in a block's words."""
    if not len(h) or not len(win["keys"]):
        z = np.zeros(0, np.int64)
        return z, z
    k = np.minimum(np.searchsorted(win["keys"], h), len(win["keys"]) - 1)
    at = np.flatnonzero(win["keys"][k] == h)
    k = k[at]
    per = T.counts(doc, n_docs)
    end = np.cumsum(per)
    begin = end - per
    starts, which = [], []
    many = win["many"][k]
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(many) // _STEP)) + 1, len(at)]
    for a, z in zip(cuts[:-1], cuts[1:]):  # at most about _STEP candidates at a time
        m = many[a:z]
        pos = np.repeat(at[a:z], m)
        turn = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        w = win["order"][np.repeat(win["first"][k[a:z]], m) + turn]
        s = pos - win["offset"][w]
        d = doc[pos]
        ok = (s >= begin[d]) & (s + win["length"][w] <= end[d])
        s, w = s[ok], w[ok]
        for j in range(win["words"].shape[1]):
            if not len(s):
                break
            ok = (win["length"][w] <= j) | (h[np.minimum(s + j, len(h) - 1)] == win["words"][w, j])
            s, w = s[ok], w[ok]
        starts.append(s)
        which.append(w)
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(starts), np.concatenate(which)


def _match(win, more: bool):
    def run(batches):
        known = win.value
        for b in batches:
            for i, j, data, offs in T.blocks(b):
                doc, h = T.words(data, offs, "alnum")
                n = j - i
                s, w = occurrences(h, doc, n, known)
                per = T.counts(doc, n)
                begin = np.cumsum(per) - per
                step = np.zeros(len(h) + 1, np.int64)
                np.add.at(step, s, 1)
                np.add.at(step, s + known["length"][w], -1)
                doc_id, old_spans, old_items = T.take(b, i, j, "doc_id", "spans", "items")
                names = [set(x) for x in old_items.to_pylist()]
                flat = old_spans.to_pylist()
                for d in [d for d, x in enumerate(flat) if x]:
                    x = np.array(flat[d], np.int64) + begin[d]
                    np.add.at(step, x[0::2], 1)
                    np.add.at(step, x[1::2], -1)
                for d, x in {(int(d), int(x)) for d, x in zip(doc[s], w)} if len(s) else ():
                    names[d].update(known["items"][x])
                hit = np.cumsum(step)[:-1] > 0
                edge = np.zeros(len(h) + 1, bool)
                edge[np.r_[begin, len(h)]] = True
                before, after = np.r_[False, hit[:-1]] if len(h) else hit, np.r_[hit[1:], False] if len(h) else hit
                first, last = np.flatnonzero(hit & (~before | edge[:-1])), np.flatnonzero(hit & (~after | edge[1:])) + 1
                owner = doc[first]
                spans = np.stack([first - begin[owner], last - begin[owner]], 1).ravel()
                cut = np.r_[0, np.cumsum(2 * np.bincount(owner, minlength=n))]
                out = {
                    "doc_id": doc_id.cast(pa.int64()),
                    "n_words": pa.array(per),
                    "spans": pa.LargeListArray.from_arrays(pa.array(cut), pa.array(spans.astype(np.int64))).cast(pa.list_(pa.int64())),
                    "items": pa.array([sorted(x - {None}) + [None] * (None in x) for x in names], pa.list_(pa.string())),
                }
                if more:
                    out["text"] = T.take(b, i, j, "text")[0]
                yield pa.record_batch(out)

    return run


def pieces(text: str, size: int, limit: int):
    """A text of more than `limit` words in parts of so many, which overlap so that every window is whole in one of them."""
    if len(text) < 2 * limit:
        yield text
        return
    at = [m.span() for m in re.finditer(WORD, text)]
    for i in range(0, max(1, len(at) - size + 1), max(1, limit - size + 1)):
        own = at[i : i + limit]
        yield text[own[0][0] : own[-1][1]] if own else ""


def _item_blocks(items: DataFrame, size: int, limit: int):
    """Lists of (item_id, text or a part of it), each of about `limit` words at most; only one is held at a time."""
    block: list[tuple] = []
    n = 0
    for name, text in items.select("item_id", F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        for part in pieces(text or "", size, max(limit, 2 * size)):
            m = len(part) // 2 + 1
            if block and n + m > limit:
                yield block
                block, n = [], 0
            block.append((name, part))
            n += m
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans, items of each row of docs.

    spans lists the hit word ranges [start, end) flat, start after end; items the ids (as strings, sorted) of the items
    with a window in the document, at their end null if an item without an id is among them (all those are one item).
    Null or empty texts have no words; items without words match nothing; repeated rows and ids get equal results;
    words that are equally rare are taken in the order of their hashes; texts and items of any length are read whole. An
    empty benchmark hits nothing. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    docs = T.texts(docs)
    state = docs.selectExpr("doc_id", "text", "cast(array() as array<long>) as spans", "cast(array() as array<string>) as items")
    schema = "doc_id long, n_words long, spans array<long>, items array<string>"
    out = None
    for block, more in _two(_item_blocks(benchmark, size, block_words)):
        win = item_windows(block, size)
        w = win["words"]
        vocabulary = np.unique(w[np.arange(size)[None, :] < win["length"][:, None]])
        win = with_prefixes(win, vocabulary, T.vocabulary_counts(docs, vocabulary, "alnum"))
        out = state.mapInArrow(_match(spark.sparkContext.broadcast(win), more), schema + (", text string" if more else ""))
        if more:
            state = checkpoint(out).select("doc_id", "text", "spans", "items")
    return out.select("doc_id", "n_words", "spans", "items")


def _two(blocks):
    """Each block with whether another follows; one empty block if there is none."""
    it = iter(blocks)
    now = next(it, [])
    while now is not None:
        after = next(it, None)
        yield now, after is not None
        now = after


def decontamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs."""
    hits = benchmark_hits(docs, benchmark, **options)
    n_hit = F.expr("aggregate(sequence(0, size(spans) div 2), 0L, (s, i) -> s + coalesce(get(spans, 2 * i + 1) - get(spans, 2 * i), 0))")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
