"""Spelling variant grouping: words of a corpus, the frequent word that each is a variant of, and the last one of that
chain.

* Words are counted over all documents (partial counts first).
* Bloom filters of the vocabulary, one for each length of word, each of blocks of 256 bits in which a word sets one bit
  in each of eight lanes. They are built by an aggregation over blocks and have a size that is known from the counts
  before they are made; at most FILTER_BYTES of them are collected and broadcast at a time, more take further passes.
* Neighbourhoods: of each word all deletions, and all replacements by a greater letter, are generated by arithmetic on
  its code points and probed against the filter of their length. (Insertions are the longer word's deletions, other
  replacements the other word's.) Only the positives are sent on, to an exact join with the vocabulary, which drops the
  filters' errors.
* Forms point to words at least RATIO times as frequent, so chains are short and have no cycles; roots are found by
  pointer doubling.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T
from fieldloom.operators.shared import checkpoint, stored

#: Runs of letters, the letters that they hold once A to Z are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Code points and occurrences of a word at least; how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Bytes of filters that are collected and broadcast at a time, at most, and bits for each word.
FILTER_BYTES, BITS = 32 << 20, 16
#: Code points of generated words that a task holds at a time (about).
STEP = 1 << 21
#: Words whose neighbourhoods one task generates.
WORDS_A_TASK = 20_000
LANES, BLOCK_BITS = 8, 256
_U = np.uint64
_MUL = T.seeded(4, 301) | _U(1)
_LANE = T.seeded(LANES, 302) | _U(1)


def word_counts(docs: DataFrame, slip: int | None = None) -> DataFrame:
    """word, n of the distinct runs of letters in all texts, lower-cased where they are A to Z.

    slip: of a run for which it divides h = crc32("<doc_id>:<run>"), the code point h % length (from 0) is left out, which
    plants misspellings; runs of documents without an id stay whole.
    """
    run = F.translate(F.col("run"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = T.texts(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run")).select("doc_id", run.alias("word"))
    if slip:
        words = words.withColumn("h", F.expr("crc32(doc_id || ':' || word)"))
        at = "cast(h % length(word) as int)"
        cut = F.expr(f"substring(word, 1, {at}) || substring(word, {at} + 2)")
        words = words.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _points(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(_U)


def _weights(n: int) -> np.ndarray:
    return T.powers(n + 2)[0][: n + 2] * _MUL[0]


def hashes(points: np.ndarray) -> np.ndarray:
    """A hash of each row: the sum of mixed code points times a power for their place."""
    w = _weights(points.shape[1])
    return T.mix((T.mix(points) * w[: points.shape[1]]).sum(1, dtype=_U) + _MUL[1])


def edits(points: np.ndarray, letters: np.ndarray):
    """(kind, length, hashes) of all deletions (a column a place) and of all replacements by a greater letter (a column a
    place and letter; the others are masked): sums are changed, no word is built."""
    n = points.shape[1]
    w, m = _weights(n), T.mix(points)
    own = m * w[:n]
    before = np.cumsum(own, 1) - own
    moved = m[:, 1:] * w[: n - 1]  # each code point one place to the left
    after = np.zeros_like(own)
    after[:, :-1] = np.cumsum(moved[:, ::-1], 1)[:, ::-1]
    deleted = T.mix(before + after + _MUL[1])
    first = np.ones_like(points, bool)
    first[:, 1:] = points[:, 1:] != points[:, :-1]  # deleting any of equal neighbours gives one word
    yield "deletion", n - 1, deleted, first
    total = own.sum(1, dtype=_U)
    step = T.mix(letters)
    for i in range(n):
        changed = T.mix((total - own[:, i])[:, None] + step[None, :] * w[i] + _MUL[1])
        yield i, n, changed, letters[None, :] > points[:, i][:, None]


class Shards:
    """Where the filter of each length lies among all blocks: a size for each length, from the counts of its words."""

    def __init__(self, counted: dict[int, int], bits: int, limit: int):
        self.per = {n: max(1, -(-m * bits // BLOCK_BITS)) for n, m in counted.items()}
        self.start, at = {}, 0
        for n in sorted(self.per):
            self.start[n] = at
            at += self.per[n]
        self.blocks, self.a_pass = at, max(1, limit // (BLOCK_BITS // 8))
        self.passes = -(-at // self.a_pass)

    def block(self, length: int, h: np.ndarray) -> np.ndarray:
        return self.start[length] + ((h >> _U(32)) % _U(self.per[length])).astype(np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    """The bit (0 to 31) that a hash sets in each lane."""
    return ((h[..., None] * _LANE) >> _U(59)).astype(np.uint32)


def _groups(b: pa.RecordBatch, letters: int = 1):
    """(length, words) of a batch, by length, in parts that keep a task's memory bounded."""
    words = b.column("word").to_pylist()
    size = np.array([len(x) for x in words], np.int64)
    for n in np.unique(size):
        own = [words[i] for i in np.flatnonzero(size == n)]
        step = max(1, STEP // (int(n) * letters))
        for i in range(0, len(own), step):
            yield int(n), own[i : i + step]


def _build(shards: Shards, turn: int):
    """Rows (block, lanes) of the blocks of one pass, merged for each batch."""
    low, high = turn * shards.a_pass, (turn + 1) * shards.a_pass

    def run(batches):
        for b in batches:
            got = [(shards.block(n, h), _bits(h)) for n, words in _groups(b) for h in [hashes(_points(words))]]
            if not got:
                continue
            at, bits = (np.concatenate(x) for x in zip(*got))
            mine = (at >= low) & (at < high)
            block, group = np.unique(at[mine], return_inverse=True)
            lanes = np.zeros((len(block), LANES), np.uint32)
            for k in range(LANES):
                np.bitwise_or.at(lanes[:, k], group, np.uint32(1) << bits[mine, k])
            yield pa.record_batch({"block": pa.array(block), **{f"l{k}": pa.array(lanes[:, k].copy().view(np.int32)) for k in range(LANES)}})

    return run


def bloom_filters(vocabulary: DataFrame, shards: Shards, turn: int) -> np.ndarray:
    """The filters' blocks of one pass, as rows of lanes: FILTER_BYTES at most."""
    names = [f"l{k}" for k in range(LANES)]
    rows = vocabulary.select("word").mapInArrow(_build(shards, turn), "block long, " + ", ".join(f"{c} int" for c in names))
    rows = rows.groupBy("block").agg(*(F.bit_or(c).alias(c) for c in names)).toArrow()
    n = min(shards.a_pass, shards.blocks - turn * shards.a_pass)
    out = np.zeros((n, LANES), np.uint32)
    at = rows.column("block").to_numpy() - turn * shards.a_pass
    for k, c in enumerate(names):
        out[at, k] = rows.column(c).to_numpy().view(np.uint32)
    return out


def _probe(shards: Shards, turn: int, filters, letters: list[int]):
    """Rows (word, other) of the generated words that the filters of this pass may hold."""
    low, high = turn * shards.a_pass, (turn + 1) * shards.a_pass
    probes = np.array(letters, _U)

    def run(batches):
        table = filters.value
        for b in batches:
            for n, words in _groups(b, len(letters)):
                points = _points(words)
                for kind, length, h, ok in edits(points, probes):
                    if length not in shards.per:
                        continue
                    row, col = np.nonzero(ok)
                    h = h[row, col]
                    block = shards.block(length, h)
                    mine = np.flatnonzero((block >= low) & (block < high))
                    hit = ((table[block[mine] - low] >> _bits(h[mine])) & np.uint32(1)).all(1)
                    mine = mine[hit]
                    row, col = row[mine].tolist(), col[mine].tolist()
                    if kind == "deletion":
                        other = [words[r][:c] + words[r][c + 1 :] for r, c in zip(row, col)]
                    else:
                        other = [words[r][:kind] + chr(letters[c]) + words[r][kind + 1 :] for r, c in zip(row, col)]
                    yield pa.record_batch({"word": pa.array([words[r] for r in row], pa.string()), "other": pa.array(other, pa.string())})

    return run


def near_words(vocabulary: DataFrame, letters: list[int] = LETTERS, bits: int = BITS, limit: int = FILTER_BYTES) -> DataFrame:
    """Pairs (word, other) of the vocabulary's distinct words that differ by one inserted, deleted or replaced code point;
    each pair once: other is the shorter one, or has the greater letter. letters: all code points that the words hold."""
    words = vocabulary.select("word")
    counted = {n: m for n, m in words.groupBy(F.length("word").alias("k")).count().collect()}  # a row a length
    if not counted:
        return words.select("word", F.col("word").alias("other"))
    words = words.repartition(max(words.sparkSession.sparkContext.defaultParallelism, sum(counted.values()) // WORDS_A_TASK))
    shards = Shards(counted, bits, limit)
    found = None
    for turn in range(shards.passes):
        filters = words.sparkSession.sparkContext.broadcast(bloom_filters(words, shards, turn))
        part = words.mapInArrow(_probe(shards, turn, filters, letters), "word string, other string")
        found = part if found is None else found.union(part)
    return found.join(words.withColumnRenamed("word", "other"), "other").select("word", "other")


def spelling_variants(counts: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, ratio: int = RATIO, letters: list[int] = LETTERS, **filters) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words (word, n) with enough code points and occurrences.

    form: the near word of largest n (the smallest in code-point order on ties) if that n >= ratio * the word's, else null;
    root: what following forms leads to, the word itself without one. counts has a row for each distinct word; null words
    are left out; an empty table gives an empty one. Words of any length take part: a task holds some STEP code points of
    generated words, or those of one word. Columns beyond word and n, whatever their names, are ignored.
    """
    if ratio < 2:
        raise ValueError("forms are more frequent than their variants: ratio >= 2")
    words = counts.select("word", "n").where((F.length("word") >= least_length) & (F.col("n") >= least))
    words = stored(words)
    pairs = near_words(words, letters, **filters)
    pairs = pairs.union(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    near = pairs.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("b"))
    best = best.select("word", "n_near", F.col("b.other").alias("near"), (-F.col("b.less")).alias("m"))
    out = words.join(best, "word", "left").withColumn("ok", F.col("m") >= ratio * F.col("n"))
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), F.col("near")).alias("form"), F.when(F.col("ok"), F.col("m")).alias("form_n"))
    out = stored(out)
    most = out.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(most, ratio)) + 1  # forms that can follow each other, at most
    up = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        up = checkpoint(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("over")), "root", "left").select("word", F.coalesce("over", "root").alias("root")))
    return out.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
