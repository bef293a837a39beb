"""Removed words against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import substring
from spanloom.llm.common import WORD_PATTERN, window_hashes, word_hashes


def slow_keep(rows, size):
    """Kept words of (id, text) rows; a null id is larger than all."""
    rank = [float("inf") if d is None else d for d, _ in rows]
    words = [re.findall(WORD_PATTERN, t or "") for _, t in rows]
    first = {}
    for r, w in zip(rank, words):
        for p in range(len(w) - size + 1):
            window = tuple(w[p : p + size])
            first[window] = min(r, first.get(window, r))
    out = []
    for r, w in zip(rank, words):
        gone = {p + o for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] < r for o in range(size)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return words, out


def check(docs, rows, size, chunk_bytes):
    got = substring.deduplicate(docs, size, chunk_bytes).collect()
    words, kept = slow_keep(rows, size)
    want = [
        (d, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
        for (d, _), w, k in zip(rows, words, kept)
    ]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)
    return got


def test_word_and_window_hashes():
    texts = ["a bb  ccc\x0bd", "", "  ", "é a bb", "one"]
    hashes, counts = word_hashes([t.encode() for t in texts])
    words = [w for t in texts for w in re.findall(WORD_PATTERN, t)]
    assert counts.tolist() == [len(re.findall(WORD_PATTERN, t)) for t in texts]
    for h in hashes:
        assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
        assert len({(a, b) for a, b in zip(h.tolist(), words)}) == len(set(words))
    many, _ = word_hashes([b"a b a b a"], 1)
    w = window_hashes(many[0], 2, 0).tolist()
    assert w[0] == w[2] and w[1] == w[3] and w[0] != w[1]


def test_against_a_dictionary(spark, documents):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(4, 30))] for _ in range(12)]
    rows = [(None, None), (4, ""), (4, " \n"), (None, " ".join(passages[0]))]
    for i in range(250):
        parts = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 20))] if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randrange(1, 6))]
        rows.append((rng.randrange(200), rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    rows += [(7, "same " * 100), (9, "same " * 100), (9, "same " * 100), (3, rows[10][1]), (500, rows[11][1])]
    for size, chunk in ((4, 2000), (4, 16 << 20), (13, 900)):
        check(documents(rows), rows, size, chunk)


def test_columns_are_kept(spark, documents):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, f"x  {passage}\ny"), (2, f"a {passage} b"), (3, "clean\n\ttext  here"), (4, None)]
    docs = documents(rows, clashing=True)
    got = substring.without_repeats(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars, r.row) for r in got.collect()} == {
        1: (rows[0][1], len(rows[0][1]), "own row"),
        2: ("a b", 3, "own row"),
        3: (rows[2][1], len(rows[2][1]), "own row"),
        4: (None, None, "own row"),
    }
    assert substring.without_repeats(docs.filter(F.lit(False))).count() == 0


def test_a_very_long_text(spark, documents):
    rng = np.random.default_rng(1)
    text = " ".join(f"v{i}" for i in rng.integers(0, 10**6, 300_000))
    rows = [(1, text), (2, text[1000:] + " tail")]
    got = {r.doc_id: r for r in substring.deduplicate(documents(rows), 13, 50_000).collect()}
    assert got[1].n_removed == 0 and got[2].kept.endswith("tail") and got[2].n_words - got[2].n_removed <= 2
