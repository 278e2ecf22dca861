"""Spelling variants, periodic runs and the tokenization automaton against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fieldloom.llm import automaton, periodic, queries, spelling
from tests.conftest import SF
from tests.llm.test_llm import empty_docs, odd_docs, read

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11
def slipped(docs, slip):
    n = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if slip and i is not None and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return n


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(n, least_length=6, least=5, ratio=5):
    n = {w: m for w, m in n.items() if len(w) >= least_length and m >= least}
    near = {w: [x for x in n if abs(len(w) - len(x)) < 2 and one_apart(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def as_variants(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query(spark):
    got = as_variants(queries.op11_spelling_variants(spark, SF))
    assert got == variants(slipped([(r.doc_id, r.text) for r in read(spark, "documents").collect()], 199))
    assert any(r[0] for r in got.values())


@pytest.mark.parametrize("limit", [64, 1 << 25])
def test_spelling_dense_neighbourhoods(spark, limit):
    """Words that are nearly all near each other, chains of forms, ties, and filters of one block or many passes."""
    rng = random.Random(3)
    n = collections.Counter()
    for _ in range(300):
        n["".join(rng.choice("abé") for _ in range(rng.randint(5, 8)))] += rng.choice([1, 4, 5, 6, 30, 31, 160, 900])
    n.update({"colours": 5, "colour": 25, "colou": 900, "kolour": 125, "kolours": 25, "zebras": 5, "zebraz": 25, "zebrax": 25, "ÿ" * 40: 5, "ÿ" * 39: 50})
    df = spark.createDataFrame([(w, m, "x") for w, m in n.items()] + [(None, 50, "x")], "word string, n long, other string")
    got = as_variants(spelling.spelling_variants(df, bits=8, limit=limit))
    assert got == variants(n)
    assert got["colours"][1] == "kolour" and got["zebras"][0] == "zebrax"


def test_spelling_odd_rows(spark):
    docs = odd_docs(spark)
    got = {r.word: r.n for r in spelling.word_counts(docs, slip=3).collect()}
    assert got == slipped([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 3)
    assert spelling.spelling_variants(spelling.word_counts(empty_docs(spark))).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(spelling.word_counts(docs), ratio=1)


def test_bloom_filters_hold_every_edit():
    words = ["abcdef", "aabbcc", "éééééé"]
    points = spelling._points(words)
    seen = collections.defaultdict(set)
    for kind, _, h, ok in spelling.edits(points, np.array(spelling.LETTERS, np.uint64)):
        for r, c in zip(*np.nonzero(ok)):
            w = words[r]
            made = w[:c] + w[c + 1 :] if kind == "deletion" else w[:kind] + chr(spelling.LETTERS[c]) + w[kind + 1 :]
            assert spelling.hashes(spelling._points([made]))[0] == h[r, c] and one_apart(w, made) and made not in seen[w]
            seen[w].add(made)
    assert {len([x for x in seen[w] if len(x) == 5]) for w in words} == {6, 3, 1}


# 12
def plant(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def runs_brute(words):
    code = {}
    w = np.array([code.setdefault(x, len(code)) for x in words], np.int64)
    runs = {}
    for q in range(1, len(w) // 3 + 1):
        same = np.r_[False, w[q:] == w[:-q], False]
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s + q >= max(24, 3 * q):
                runs.setdefault((int(s), int(e - s + q)), q)  # the smallest period comes first
    return sorted((s, m, q) for (s, m), q in runs.items())


def digest_brute(doc_id, words):
    runs = runs_brute(words)
    keep = np.ones(len(words), bool)
    for s, m, q in runs:
        keep[s + q : s + m] = False
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    text = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *top, sha(text), sha(" ".join(w for w, k in zip(words, keep) if k)))


def test_periodic_query(spark):
    docs = [(r.doc_id, SPACE_WORD.findall(r.text or "")) for r in read(spark, "documents").collect()]
    want = sorted(digest_brute(i, plant(i, w)) for i, w in docs)
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, SF).collect()))
    assert got == want and sum(r[1] for r in got) > 5


def test_periodic_runs_in_repetitive_texts(spark):
    """Few words, nested and touching runs, powers of powers, near misses of both bounds."""
    rng = random.Random(8)
    texts = [" ".join("a" * 24), " ".join("a" * 23), " ".join("ab" * 12), " ".join("ab" * 11 + "a"), " ".join("abcdefghi" * 2 + "abcdefgh"), " ".join("abcdefghi" * 3), "", " \n "]
    texts += [" ".join(f"w{i % 700}" for i in range(2_100)), " ".join(f"w{i % 700}" for i in range(2_099)), " ".join("A" * 12 + "a" * 30)]
    for _ in range(150):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
            unit = unit * rng.randint(1, 5) + [rng.choice("abcd") for _ in range(rng.randint(0, 3))]
            w += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        texts.append(rng.choice(["\n", " ", "\t "]).join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, periodic.run_digest(periodic.periodic_runs(df)).collect()))
    assert got == [digest_brute(i, SPACE_WORD.findall(t)) for i, t in enumerate(texts)]


def test_periodic_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = {r.doc_id: r.text for r in periodic.planted(docs).collect() if r.doc_id is not None}
    assert all(SPACE_WORD.findall(kept[i] or "") == plant(i, SPACE_WORD.findall(t or "")) for i, t in rows if i is not None)
    got = [tuple(r) for r in periodic.run_digest(periodic.periodic_runs(docs)).collect()]
    order = lambda r: (r[0] is None, r[0], r[-1])
    assert sorted(got, key=order) == sorted((digest_brute(i, SPACE_WORD.findall(t or "")) for i, t in rows), key=order)
    assert periodic.periodic_runs(empty_docs(spark)).count() == 0
    huge = spark.createDataFrame([(1, "a " * 300_000 + "b " * 10 + " ".join(f"x{i % 50_000}" for i in range(200_000)))], "doc_id long, text string")
    r = periodic.periodic_runs(huge).first()
    assert [tuple(x) for x in r.runs] == [(0, 300_000, 1), (300_010, 200_000, 50_000)] and len(r.collapsed.split()) == 1 + 10 + 50_000
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, periods=2)


def test_frequency_splitting_is_recursive():
    """A word that is frequent in the text but rare in what another one leaves of it splits that too."""
    words = (["x"] + [f"u{i}" for i in range(40)] + ["x"] + ["p", "q"] * 20 + ["x", "y"]) * 1
    h = np.array([hash(w) & 0xFFFFFFFF for w in words], np.uint64)
    (s,), (e,) = periodic.split(np.zeros(len(h), np.int64), h)
    assert words[s:e] == ["p", "q"] * 20


# 13
def merge_brute(word, merges):
    """Byte-pair merging as it is defined: the lowest rank, its leftmost place, again and again."""
    rank = {m: i for i, m in enumerate(merges)}
    seq = [(b,) for b in word]
    while True:
        best = min(((rank.get((a, b), len(rank)), i) for i, (a, b) in enumerate(zip(seq, seq[1:]))), default=(len(rank), 0))
        if best[0] == len(rank):
            return seq
        i = best[1]
        seq[i : i + 2] = [seq[i] + seq[i + 1]]


def test_automaton_of_random_merges():
    rng = random.Random(5)
    for _ in range(300):
        letters = rng.choice([b"a", b"ab", b"abc"])
        made = [(b,) for b in letters]
        merges = []
        for _ in range(rng.randint(0, 25)):
            a, b = rng.choice(made), rng.choice(made)
            if a + b not in made:
                made.append(a + b)
                merges.append((a, b))
        number = {(b,): b for b in range(256)} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
        own = automaton.Automaton([(number[a], number[b]) for a, b in merges])
        for _ in range(20):
            word = bytes(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert own.encode(word) == [number[t] for t in merge_brute(word, merges)]
        for t, label in enumerate(own.label):  # arcs of one token lead to one state, and no token follows a path in two ways
            assert own.target[t] is None or own.encode(label) is not None


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_query(spark):
    lib = library()
    want = []
    for r in read(spark, "documents").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.op13_bpe_round_trip(spark, SF).collect())) == sorted(want)


def test_bpe_odd_texts(spark):
    lib, path, rng = library(), queries.tokenizer_path(), random.Random(2)
    texts = [r.text or "" for r in odd_docs(spark).collect()]
    texts += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "a" * 5_000, "你好 \U0001f600\U0001f468‍\U0001f469    x", "   \n\n  's 'LL don't"]
    texts += ["".join(rng.choice("abeist  é你\n19_'-") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, ids int")
    got = automaton.bpe_decode(automaton.bpe_encode(df, path), path).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else ""
        assert r.ids == lib.encode(text, add_special_tokens=False).ids and r.text == text
    assert automaton.bpe_encode(empty_docs(spark), path).count() == 0


def test_bpe_decodes_any_ids(spark):
    lib, path, rng = library(), queries.tokenizer_path(), random.Random(4)
    rows = [(i, [rng.randrange(50_257) for _ in range(rng.randint(0, 40))]) for i in range(100)]
    df = spark.createDataFrame([*rows, (100, None), (101, [None, 50_400, -3, 64])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in automaton.bpe_decode(df, path).collect()}
    assert all(got[i] == lib.decode(ids, skip_special_tokens=False) for i, ids in rows)
    assert got[100] == "" and got[101] == lib.decode([64])


def test_bpe_refuses_other_files():
    spec = '{"model": {"vocab": {"a": 0}, "merges": [["a", "b"], ["a", "b"]]}, "pre_tokenizer": {"type": "ByteLevel"}, "decoder": {"type": "ByteLevel"}}'
    with pytest.raises(ValueError):
        automaton.Codec(spec)
    with pytest.raises(ValueError):
        automaton.Codec(spec.replace('"decoder"', '"x"'))
