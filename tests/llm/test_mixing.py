"""Targets, rounding and the mixed table."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing
from spanloom.llm.queries import QUERIES


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Reshare the excess until none is above its bound. ``sizes``: by source, None last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def check(rows, slack):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = slow_targets(sizes)
    for source in sizes:
        own = [r for r in rows if r.source == source]
        assert own[0].target == pytest.approx(want[source], abs=1e-6)
        assert all(r.source_size == sizes[source] and r.copies <= 2 for r in own)
        assert abs(sum(r.copies * r.size for r in own) - want[source]) <= slack


def test_settling_keeps_words_and_expectation():
    rng = np.random.default_rng(1)
    mass = rng.integers(1, 100, 200).astype(float)
    sums = np.zeros(200)
    for _ in range(2000):
        x = np.full(200, 0.3)
        left = mixing._settle(x, mass, rng.random(201))
        assert ((x == 0) | (x == 1) | (np.arange(200) == left)).all()
        assert x @ mass == pytest.approx(0.3 * mass.sum())
        sums += x
    assert np.abs(sums / 2000 - 0.3).max() < 0.06


def test_targets_with_capped_and_empty_sources(spark, documents):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "a", "b", "é", "Z", "\U0001f600", None, "empty"])
        n = 0 if source == "empty" else rng.randrange(1, 30) if source != "b" else 1
        rows.append((i, " ".join(["w"] * n) if n else rng.choice([None, "", " \n"]), source))
    for block in (20_000, 40):  # one block and a tree of blocks
        check(mixing.mix(documents(rows, clashing=True), block_rows=block).collect(), 30)


def test_reruns_agree_and_repeated_rows_are_their_own(spark, documents):
    rows = [(i % 50, "x " * (i % 7), "ab"[i % 2]) for i in range(300)]
    first = [sorted(map(tuple, mixing.mix(documents(rows).repartition(n)).collect())) for n in (1, 5)]
    assert first[0] == first[1]
    taken = mixing.mixed_documents(documents(rows, clashing=True))
    words = Counter()
    for r in first[0]:
        words[r[2]] += r[6]
    assert Counter(r.source for r in taken.collect()) == words
    assert taken.columns == documents(rows, clashing=True).columns
    copies = Counter((r.doc_id, r.text, r.source) for r in taken.collect())
    many = Counter((d, t, s) for d, t, s in rows)
    assert all(n <= 2 * many[k] for k, n in copies.items())


def test_empty_table_and_one_source(spark, documents):
    empty = documents([(1, "a")]).filter(F.lit(False))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    only = mixing.mix(documents([(1, None, None), (2, "", None)])).collect()
    assert [(r.size, r.target) for r in only] == [(0, 0.0), (0, 0.0)]


def test_query(spark, small_dir):
    rows = QUERIES["op3_mix_sources"](spark, small_dir).collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[docs[r.doc_id]] += r.size
        taken[docs[r.doc_id]] += r.taken
        target[docs[r.doc_id]] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    want = slow_targets(sizes)
    longest = {s: max(r.size for r in rows if docs[r.doc_id] == s) for s in sizes}
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= longest[s]
