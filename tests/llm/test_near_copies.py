"""Near copies against the exact similarity of five-word shingles."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import near_copies as nc


def shingles(text):
    words = (text or "").lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def changed(rng, source, part):
    words = source.split()
    for at in rng.sample(range(len(words)), max(1, round(part * len(words)))):
        words[at] = text(rng, 1)
    return " ".join(words)


def test_recall_by_similarity(spark, documents):
    """Pairs at 0.8 or more are found, unrelated texts stay."""
    rng = random.Random(2)
    rows, pairs = [], []
    for n in range(500):
        source = text(rng, rng.randrange(100, 600))
        copy = changed(rng, source, rng.uniform(0.002, 0.03))
        rows += [(2 * n, source), (2 * n + 1, copy)]
        pairs.append(jaccard(source, copy))
    rows += [(5000 + i, text(rng, 200)) for i in range(1500)]
    kept = {r.doc_id for r in nc.one_per_group(documents(rows)).collect()}
    assert all(2 * n in kept for n in range(500)) and all(5000 + i in kept for i in range(1500))
    for low, high, least in ((0.8, 0.85, 0.9), (0.85, 0.9, 0.95), (0.9, 1.0, 0.99)):
        at = [n for n, j in enumerate(pairs) if low <= j < high]
        caught = [n for n in at if 2 * n + 1 not in kept]
        assert len(at) > 20 and len(caught) >= least * len(at)
    assert [n for n, j in enumerate(pairs) if j < 0.6 and 2 * n + 1 not in kept] == []


@pytest.mark.parametrize("part", [50_000, 40])
def test_groups_of_many_copies(spark, documents, part):
    rng = random.Random(3)
    source = text(rng, 300)
    rows = [(i, source) for i in range(300)] + [(1000 + i, changed(rng, source, 0.01)) for i in range(300)]
    rows += [(5000 + i, text(rng, 50)) for i in range(50)]
    kept = sorted(r.doc_id for r in nc.one_per_group(documents(rows), part=part).collect())
    assert kept == [0, *range(5000, 5050)]


def test_odd_rows(spark, documents):
    rows = [(3, None), (1, ""), (2, " \n"), (9, "a b"), (8, "A b"), (8, "A b"), (None, "a b"), (None, "only one without an id"), (7, "x " * 300_000), (6, "x " * 300_000)]
    got = nc.one_per_group(documents(rows, clashing=True))
    assert got.columns == documents(rows, clashing=True).columns
    assert sorted(((r.doc_id, (r.text or "")[:9]) for r in got.collect()), key=str) == [(1, ""), (6, "x x x x x"), (8, "A b"), (None, "only one ")]
    assert nc.one_per_group(documents(rows).filter(F.lit(False))).count() == 0


def test_pairs_that_the_trees_miss_are_found(spark, documents, monkeypatch):
    """Every pair at the threshold is linked, also where the trees find nothing and a passage is common."""
    rng = random.Random(5)
    passage, rows, near = text(rng, 40), [], []
    for n in range(150):
        source = text(rng, rng.randrange(1, 8) if n % 10 == 0 else rng.randrange(60, 300))
        near.append(changed(rng, source, rng.uniform(0.002, 0.05)))
        rows += [(2 * n, f"{passage} {source}"), (2 * n + 1, f"{passage} {near[-1]}")]
    # Exactly at the threshold: 4 of 5 shingles in common, 8 words against 9.
    at = text(rng, 9).split()
    rows += [(9000, " ".join(at[:8])), (9001, " ".join(at))]
    assert jaccard(rows[-1][1], rows[-2][1]) == 0.8
    root = {i: i for i, _ in rows}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
    monkeypatch.setattr(nc, "links", lambda fps, *_: fps.selectExpr("node a", "node b").limit(0))
    for common, pairs in ((32, 1000), (1 << 30, 0)):  # common ones by cells; by groups
        monkeypatch.setattr(nc, "COMMON", common)
        monkeypatch.setattr(nc, "PAIRS", pairs)
        monkeypatch.setattr(nc, "GROUP", 4)
        kept = sorted(r.doc_id for r in nc.one_per_group(documents(rows)).collect())
        assert kept == sorted(i for i in root if root[i] == i) and 9001 not in kept


def test_trees_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, (30, 4), dtype=np.int64).view(np.uint64)
    values = np.repeat(base, 20, axis=0)
    for row in values:
        for bit in rng.integers(0, 256, rng.integers(0, 30)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    tree = nc.Tree(values, leaf=5)
    assert any(not isinstance(n, np.ndarray) for n in tree.nodes)
    for radius in (0, 10, 50):
        q, m = tree.within(np.arange(len(values)), radius)
        want = np.argwhere(nc._distances(values[:, None], values[None]) <= radius)
        assert sorted(zip(q.tolist(), m.tolist())) == sorted(map(tuple, want.tolist()))


def test_shards_keep_their_size():
    for n in (1, 1000, 10**6, 10**9):
        bits = nc.choices(n)
        assert n / 2 ** len(bits[0]) <= nc.SHARD
        agree = (1 - np.arccos(2 * 0.8 / 1.8) / np.pi) ** len(bits[0])
        assert (1 - agree) ** len(bits) <= nc.MISSED
