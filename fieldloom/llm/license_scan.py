"""License scans: an exact set-similarity join of text blocks with notice templates.

Base places are the runs of words of fixed phrases. Beyond those, a text block matches a template when it holds at
least THRESHOLD of the template's distinct words, its telling words (TELLING) among them. The blocks of a template of
L words are the 2 L words from every place on; those that begin with a template word hold what all others do. All template words are ordered by their
frequency over all documents; the |T| - ceil(c |T|) + 1 rarest ones form a template's prefix, one of which any matching
block must hold. The distinct template words are counted in the blocks that hold one.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import _text as T

THRESHOLD = Fraction(4, 5)

#: The phrases of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Opening words and whole texts of common notices, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-text",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-text",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-text",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program": "gpl-text",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib-text",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-text",
    "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost-text",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "you may not use this file except in compliance with the license": "apache-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
}

#: Words that tell a notice from those of other licenses; a block without one of them does not match.
TELLING = {
    "gpl-3.0-notice": "gnu general 3",
    "gpl-notice": "gnu general",
    "apache-2.0-notice": "apache 2",
    "mit-notice": "mit",
    "cc-by-nc-4.0-notice": "cc by nc 4",
    "mpl-2.0-notice": "mozilla 2",
    "gpl-text": "gnu general",
    "cc-by-4.0-text": "creative commons 4",
    "boost-text": "boost",
}


def compile_templates(templates: dict[str, str], threshold: Fraction, vocabulary: np.ndarray, freq: np.ndarray) -> list[dict]:
    out = []
    for (text, label), h in zip(templates.items(), T.hash_words(list(templates), "alnum")):
        tokens = np.searchsorted(vocabulary, np.unique(h))
        tokens = tokens[np.lexsort((tokens, freq[tokens]))]  # rarest first
        need = math.ceil(threshold * len(tokens))
        rank = np.full(len(vocabulary), -1)
        rank[tokens] = np.arange(len(tokens))
        (telling,) = T.hash_words([TELLING.get(label, "")], "alnum")
        telling = np.flatnonzero(np.isin(vocabulary[tokens], telling))  # those that this template has
        out.append({"label": label, "length": len(h), "size": len(tokens), "need": need, "prefix": len(tokens) - need + 1, "rank": rank, "telling": telling})
    return out


def best_blocks(pos: np.ndarray, doc: np.ndarray, tok: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """(text, distinct template words) of each matching block; pos counts words from the text's start, in order."""
    rank = t["rank"][tok]
    mine = rank >= 0
    pos, doc, rank = pos[mine], doc[mine], rank[mine]
    width = 2 * t["length"]
    place = doc * (int(pos.max(initial=0)) + width + 1) + pos  # blocks end before the next text
    holds = lambda begin, at: np.searchsorted(at, begin + width) > np.searchsorted(at, begin)
    ok = holds(place, place[rank < t["prefix"]])
    doc, begin = doc[ok], place[ok]
    has = [holds(begin, place[rank == r]) for r in range(t["size"])]
    n = np.sum(has, axis=0, dtype=np.int64)
    ok = n >= t["need"]
    for r in t["telling"]:
        ok &= has[r]
    return doc[ok], n[ok]


def _scan(shared):
    def run(batches):
        vocabulary, phrases, templates = shared.value
        for b in batches:
            for i, j, data, offs in T.blocks(b):
                n = j - i
                doc, h = T.words(data, offs, "alnum")
                per = T.counts(doc, n)
                begin = np.cumsum(per) - per
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                where = np.flatnonzero(vocabulary[at] == h)
                places, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base: list[set] = [set() for _ in range(n)]
                for words, label in phrases:
                    m = len(words)
                    s = where[h[where] == words[0]]
                    s = s[s + m <= len(h)]
                    for k in range(1, m):
                        s = s[(h[s + k] == words[k]) & (doc[s + k] == doc[s])]
                    d = doc[s]
                    np.add.at(places, d, 1)
                    np.minimum.at(first, d, s - begin[d])
                    np.maximum.at(last, d, s - begin[d])
                    for x in np.unique(d):
                        base[x].add(label)
                own = [set(x) for x in base]
                score = np.zeros(n)
                for t in templates:
                    d, k = best_blocks(where - begin[doc[where]], doc[where], at[where], t)
                    np.maximum.at(score, d, k / t["size"])
                    for x in np.unique(d):
                        own[x].add(t["label"])
                (doc_id,) = T.take(b, i, j, "doc_id")
                none = places == 0
                join = lambda x: pa.array([",".join(sorted(y)) for y in x], pa.string())
                yield pa.record_batch(
                    {
                        "doc_id": doc_id.cast(pa.int64()), "n_words": pa.array(per), "n_base": pa.array(places), "first_word": pa.array(first, mask=none),
                        "last_word": pa.array(last, mask=none), "base_labels": join(base), "labels": join(own), "score": pa.array(score),
                    }
                )

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: Fraction = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs.

    score is the largest share of a template's words in one block, of those that reach the threshold, else 0. Null or
    empty texts have no words, empty labels and score 0; repeated rows get equal results; template words that are
    equally frequent go by their hashes; texts of any length are read whole; other columns, whatever their names, are
    ignored.
    """
    templates = TEMPLATES if templates is None else templates
    docs = T.texts(docs)
    phrases = list(zip(T.hash_words(list(PHRASES), "alnum"), PHRASES.values()))
    vocabulary = np.unique(np.concatenate([*T.hash_words(list(templates), "alnum"), *(h for h, _ in phrases)]))
    freq = T.vocabulary_counts(docs, vocabulary, "alnum")
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, phrases, compile_templates(templates, threshold, vocabulary, freq)))
    return docs.mapInArrow(
        _scan(shared), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
