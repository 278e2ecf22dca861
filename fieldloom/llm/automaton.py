"""Byte-pair encoding and decoding by a tokenization automaton.

The merges of a byte-level vocabulary are compiled, one merge gadget after the other, into a deterministic automaton
over tokens that accepts just the sequences which byte-pair merging makes. It starts as one state with an arc for every
byte. The gadget of a merge (u, v) -> uv

* gives the arcs of u a new target: a copy of their old one without the arc of v, as the two would be merged;
* adds an arc of uv beside every arc of u, to where the arcs of v lead.

So all arcs of one token lead to one state, each merge makes one state at most, and a state is stored as whose chain of
copies it is in and the arc it lacks: the table of transitions takes a few numbers a token. An arc's label is its token's
bytes. Every prefix of a word has exactly one path, so a place of a word has one state, and an encoder that follows the
labels meets each place once at most. Decoding writes the labels of the arcs.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T
from fieldloom.llm.token_counts import PATTERN, byte_letters, check

#: Words that a worker remembers, in two generations of so many, and the bytes of the longest one.
REMEMBERED, LONGEST = 400_000, 256


class Automaton:
    """States and arcs. Tokens are numbered: the 256 bytes, then one a merge; state 0 is the start, state j + 1 is made
    by merge j."""

    def __init__(self, merges: list[tuple[int, int]]):
        n = 256 + len(merges)
        self.left = list(range(n))  # the token whose arcs a token's arcs stand beside
        self.made = [0] * n  # the state up to which a token's arcs stand where those of `left` do
        self.target = [0] * n  # where a token's arcs lead; None if it has none
        self.owner = [0] * (len(merges) + 1)  # the token u whose target a state was made to be
        self.chain: list[list[int]] = [[] for _ in range(n)]  # all states made for u: each lacks one arc more
        self.base = [0] * n  # what the first of them was copied from
        self.lacks: dict[tuple[int, int], int] = {}  # (u, v) to the state of u's chain that lacks v first
        self.label = [bytes([b]) for b in range(256)]
        for j, (u, v) in enumerate(merges):
            self.gadget(256 + j, j + 1, u, v)
        self.next: dict[int, int] = {}  # a trie of the labels: node << 8 | byte to node
        self.token = [-1]
        for t, label in enumerate(self.label):
            if self.target[t] is not None:
                at = 0
                for b in label:
                    key = at << 8 | b
                    at = self.next.get(key, -1)
                    if at < 0:
                        at = self.next[key] = len(self.token)
                        self.token.append(-1)
                self.token[at] = t

    def gadget(self, t: int, state: int, u: int, v: int) -> None:
        self.label.append(self.label[u] + self.label[v])
        self.left[t], self.made[t] = u, state
        before = self.target[u]
        if before is None or self.target[v] is None or not self.arc(before, v):
            self.target[t] = None  # u is never followed by v here, so the merge never happens
            return
        self.target[t] = self.base[t] = self.target[v]
        self.owner[state], self.lacks[u, v] = u, state
        self.chain[u].append(state)
        self.target[u] = state

    def arc(self, state: int, t: int) -> bool:
        """Whether the state has an arc of token t (a token that has arcs at all): a few steps down the gadgets."""
        made, left = self.made, self.left
        while state:
            if state > made[t]:
                u = self.owner[state]
                if self.lacks.get((u, t), state + 1) <= state:
                    return False
                older = bisect_right(self.chain[u], made[t])
                state = self.chain[u][older - 1] if older else self.base[u]
            else:
                t = left[t]
        return True

    def matches(self, word: bytes, i: int) -> list[int]:
        """The tokens whose labels stand at i, the longest last."""
        follow, token, at, out = self.next.get, self.token, 0, []
        for j in range(i, len(word)):
            at = follow(at << 8 | word[j], -1)
            if at < 0:
                break
            if token[at] >= 0:
                out.append(token[at])
        return out

    def encode(self, word: bytes) -> list[int]:
        """The tokens of the only path that spells the word. A place has one state however it is reached, so one that
        leads nowhere is marked and met once: long labels first, the cost grows with the length."""
        n, i, state = len(word), 0, 0
        path: list[tuple] = []
        dead = bytearray(n + 1)
        ahead = self.matches(word, 0)
        while i < n:
            while ahead:
                t = ahead.pop()
                j = i + len(self.label[t])
                if not dead[j] and self.arc(state, t):
                    path.append((i, state, ahead, t))
                    i, state, ahead = j, self.target[t], self.matches(word, j)
                    break
            else:
                dead[i] = 1
                i, state, ahead, _ = path.pop()
        return [x[3] for x in path]


class Words(dict):
    """Encoded words (their ids as bytes), remembered in two generations; long ones are not kept."""

    def __init__(self, automaton: Automaton, ids: np.ndarray):
        super().__init__()
        self.automaton, self.ids, self.old = automaton, ids, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            raw = word.encode()
            out = self.ids[self.automaton.encode(raw)].tobytes()
            if len(raw) > LONGEST:
                return out
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class Codec:
    """What a vocabulary file says: the automaton, ids of its tokens, special strings, labels by id."""

    def __init__(self, raw: str):
        import regex

        spec = json.loads(raw)
        check(spec)
        if (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level decoder")
        vocab, number = spec["model"]["vocab"], {x: i for i, x in enumerate(byte_letters())}
        merges = []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            if a not in number or b not in number or a + b in number:
                raise ValueError(f"merge {a!r} {b!r}: a part that no earlier merge makes, or a token made twice")
            number[a + b] = len(number)
            merges.append((number[a], number[b]))
        if any(x not in vocab for x in number):
            raise ValueError("a byte or a merged token has no id")
        automaton = Automaton(merges)
        self.words = Words(automaton, np.array([vocab[x] for x in number], np.int32))
        added = [(x["content"], x["id"]) for x in spec.get("added_tokens", []) if x["content"]]
        self.special = [(x, np.array([i], np.int32).tobytes()) for x, i in sorted(added, key=lambda a: -len(a[0]))]
        bytes_of = {x: bytes([i]) for i, x in enumerate(byte_letters())}
        label = {i: b"".join(bytes_of[c] for c in x) if all(c in bytes_of for c in x) else x.encode() for x, i in [*vocab.items(), *added]}
        size = [len(label.get(i, b"")) for i in range(max(label, default=-1) + 1)]
        self.start = np.r_[0, np.cumsum(np.array(size, np.int64))]
        self.labels = np.frombuffer(b"".join(label[i] for i in sorted(label)), np.uint8)
        self.find = regex.compile(PATTERN).findall

    def encode(self, text: str) -> bytes:
        parts: list = [text]
        for x, ids in self.special:
            if x in text:
                parts = [q for p in parts for q in ([p] if isinstance(p, bytes) else _between(p.split(x), ids))]
        known, find = self.words.__getitem__, self.find
        return b"".join(p if isinstance(p, bytes) else b"".join(map(known, find(p))) for p in parts)

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> list[str]:
        """Texts of rows ids[cut[i]:cut[i+1]]: all labels are gathered at once; ids without a label write nothing."""
        ids = np.where((ids >= 0) & (ids < len(self.start) - 1), ids, len(self.start) - 1)
        start = self.start[ids]
        size = np.r_[self.start, self.start[-1]][ids + 1] - start
        end = np.cumsum(size)
        out = self.labels[np.repeat(start - (end - size), size) + np.arange(size.sum())].tobytes()
        at = np.r_[0, end][cut]
        return [out[a:z].decode(errors="replace") for a, z in zip(at[:-1], at[1:])]


def _between(parts: list[str], ids: bytes) -> list:
    return [q for i, p in enumerate(parts) for q in ([ids, p] if i else [p])]


@lru_cache(maxsize=2)
def codec(raw: str) -> Codec:
    return Codec(raw)


def _file(df: DataFrame, path: str):
    """The vocabulary file, broadcast: its size is that of the vocabulary, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids (array of int) of each row of docs, as the byte-level vocabulary file encodes its text.

    No begin, end or padding tokens; special strings in a text become their tokens. Null or empty texts have no ids;
    repeated rows get equal ones; texts and words of any length are encoded whole, at a cost that grows with the length;
    other columns, whatever their names, are ignored; an empty table gives an empty one. The path of a word is unique, so
    there are no ties. Files that encode in another way, or make a token in two ways, are refused.
    """
    raw = _file(docs, vocabulary_path)

    def run(batches):
        own = codec(raw.value)
        for b in batches:
            for i, j, _, _ in T.blocks(b):
                doc_id, text = T.take(b, i, j, "doc_id", "text")
                out = [own.encode(t or "") for t in text.to_pylist()]
                cut = np.r_[0, np.cumsum([len(x) // 4 for x in out])].astype(np.int64)
                ids = pa.LargeListArray.from_arrays(pa.array(cut), pa.array(np.frombuffer(b"".join(out), np.int32)))
                yield pa.record_batch({"doc_id": doc_id, "ids": ids.cast(pa.list_(pa.int32()))})

    return T.texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """encoded (doc_id, ids) with text: the labels of the ids, special tokens included, as UTF-8 (parts that are none
    become U+FFFD). A null list gives an empty text; unknown ids (and null ones) write nothing."""
    raw = _file(encoded, vocabulary_path)

    def run(batches):
        own = codec(raw.value)
        for b in batches:
            lists = b.column("ids").fill_null([])
            cut = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            i = 0
            while i < len(lists):  # runs of rows that have some BLOCK ids together, so that the gathered labels stay bounded
                j = max(i + 1, int(np.searchsorted(cut, cut[i] + T.BLOCK // 4, "right")) - 1)
                text = own.decode(ids[cut[i] : cut[j]], cut[i : j + 1] - cut[i])
                yield pa.record_batch({"doc_id": b.column("doc_id")[i:j], "ids": b.column("ids")[i:j], "text": pa.array(text, pa.string())})
                i = j

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs, encoded and then decoded."""
    both = bpe_decode(bpe_encode(docs, vocabulary_path), vocabulary_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
