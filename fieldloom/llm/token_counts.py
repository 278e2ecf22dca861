"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made.

A text is cut at the vocabulary's special strings (one token each) and the rest by the byte-level pattern into pieces.
The symbols of a piece are its bytes, kept in a doubly linked list; a heap holds every adjacent pair that has a rank.
The lowest rank (leftmost on ties) is popped and merged until none is left: tokens = initial symbols - merges.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T

LIMIT = 512
#: Pieces that a worker remembers, in two generations of so many.
REMEMBERED = 400_000

#: Unicode white space, and the byte-level pattern written with it.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class Pieces(dict):
    """Token counts of pieces, remembered in two generations."""

    def __init__(self, pairs: dict, symbols: list[int]):
        super().__init__()
        self.pairs, self.symbols, self.old = pairs, symbols, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = tokens([self.symbols[b] for b in piece.encode()], self.pairs)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = n
        return n


def tokens(sym: list[int], pairs: dict) -> int:
    """Symbols left when no adjacent pair has a rank. pairs: (left, right) to (rank, merged symbol)."""
    n = len(sym)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        hit = pairs.get((sym[i], sym[i + 1]))
        if hit:
            heap.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        if sym[i] != a:
            continue
        j = after[i]
        if j >= n or sym[j] != b:
            continue
        merges += 1
        sym[i], sym[j] = made, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            hit = pairs.get((made, sym[k]))
            if hit:
                heapq.heappush(heap, (hit[0], i, made, sym[k], hit[1]))
        h = before[i]
        if h >= 0:
            hit = pairs.get((sym[h], made))
            if hit:
                heapq.heappush(heap, (hit[0], h, sym[h], made, hit[1]))
    return n - merges


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def check(spec: dict) -> None:
    """Refuse vocabulary files that count in another way than this module does."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        wrong.append("model, normalizer or pre_tokenizer")
    wrong += [f"added token {x['content']!r}" for x in spec.get("added_tokens", []) if any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if wrong:
        raise ValueError(f"not a plain byte-level vocabulary: {', '.join(wrong)}")


@lru_cache(maxsize=2)
def compiled(raw: str):
    """(pieces, splitter of special strings or None) of a vocabulary file's text."""
    spec = json.loads(raw)
    check(spec)
    ids = {x: i for i, x in enumerate(byte_letters())}
    pairs = {}
    for rank, m in enumerate(spec["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        made = ids.setdefault(a + b, len(ids))
        pairs.setdefault((ids.setdefault(a, len(ids)), ids.setdefault(b, len(ids))), (rank, made))
    special = sorted((x["content"] for x in spec.get("added_tokens", []) if x["content"]), key=len, reverse=True)
    return Pieces(pairs, list(range(256))), special


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(PATTERN)


def count(text: str, pieces: Pieces, special: list[str]) -> int:
    total = 0
    parts = [text]
    for x in special:
        if x in text:
            total += sum(p.count(x) for p in parts)
            parts = [q for p in parts for q in p.split(x)]
    find, known = _pattern().findall, pieces.__getitem__
    for p in parts:
        total += sum(map(known, find(p)))
    return total


def _run(raw, limit: int):
    def run(batches):
        pieces, special = compiled(raw.value)
        for b in batches:
            for i, j, _, offs in T.blocks(b):
                doc_id, text = T.take(b, i, j, "doc_id", "text")
                n = [count(t or "", pieces, special) for t in text.to_pylist()]
                yield pa.record_batch({"doc_id": doc_id.cast(pa.int64()), "n_bytes": pa.array(offs[1:] - offs[:-1]), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs, as the byte-level vocabulary file counts them.

    Null or empty texts have no bytes and tokens; repeated rows get equal counts; of pairs with one rank the leftmost
    is merged; texts of any length are counted whole; other columns, whatever their names, are ignored. The file
    is read on the driver and broadcast: its size is that of the vocabulary, whatever the input.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = T.texts(docs)
    return docs.mapInArrow(_run(raw, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
