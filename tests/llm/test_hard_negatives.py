"""Hard negatives against plain loops over all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import hard_negatives as hn


def slow(rows):
    """rows: (vec_id, label, list)"""
    one = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * x) for x in v]
        if sum(x * x for x in v) >= 2**62:
            continue
        entry = ((label + 1) % 10 if i % 7 == 0 else label, v)
        one[i] = min(one.get(i, entry), entry)
    out = []
    for a, (label, v) in one.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, m == label) for b, (m, w) in one.items() if b != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2]][:5]:
            hard = [(-ns, b) for ns, b, same in scored if not same and 50 * -ps <= 100 * -ns <= 95 * -ps][:3]
            out += [(a, p, n + 1, b, -ps, ns) for n, (ns, b) in enumerate(hard)]
    return sorted(out)


def check(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    df = df.withColumns({c: F.lit("own") for c in ("v", "norm2", "rank", "shard", "region", "score")})
    got = hn.mine(df, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == slow(rows)
    return found


def clustered(seed, n=900, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, dim))
    x[: n // 3] = centres[0] + 0.01 * rng.normal(size=(n // 3, dim))  # a hot place
    x[n // 3 : n // 2] = x[n // 3]  # copies
    label = rng.integers(0, 4, n)
    label[: n // 4] = 3
    return [(int(i) - 100, int(c), v) for i, (c, v) in enumerate(zip(label, x.astype(np.float32).tolist()))]


@pytest.mark.parametrize("shard_rows", [10_000, 150, 40])
def test_equals_loops(spark, shard_rows):
    assert len(check(spark, clustered(1), shard_rows=shard_rows)) > 100


def test_random_directions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    check(spark, [(i, i % 3, v) for i, v in enumerate(x.tolist())], kind="double", shard_rows=100)


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.2]), (3, 2, None), (4, None, [1.0, 1.0]), (5, 2, [nan, 1.0]),
        (6, 2, [0.5, inf]), (8, 2, [None, 1.0]), (None, 2, [0.5, 0.5]), (7, 9, [0.6, 0.0]), (9, 2, []), (10, 2, [0.5]), (50, 3, [0.0, 0.0]),
        (51, 3, [0.0, 0.0]), (52, 4, [0.0, 7.0]), (100, 5, [1e5, 2e5]), (101, 5, [1e5, 1e5]), (102, 6, [6e4, 1e5]), (150, 6, [1e18, 1.0]),
        (200, 7, [-1.0, 0.0]), (201, 7, [1.0, 0.0]), (2, 1, [0.5, 0.2]),
    ]
    check(spark, rows, kind="double")
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hn.mine(empty).collect() == []


def test_scores_beyond_exact_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, (rng.uniform(0.5, 1.0, 3) * 2**21).tolist()) for i in range(120)]
    check(spark, rows, kind="double", shard_rows=50)


def test_tree_covers_and_parts():
    rng = np.random.default_rng(4)
    x = np.rint(100 * np.concatenate([rng.normal(size=(300, 4)), rng.normal(size=4) + 0.01 * rng.normal(size=(200, 4))])).astype(np.int64)
    most = float((x * x).sum(1).max())
    tree = hn.CoverTree(np.arange(500), np.zeros(500, int), x, most)

    def rows_below(at):
        node = tree.nodes[at]
        return [*node.rows.tolist(), *[r for c in node.children if c >= 0 for r in rows_below(c)]]

    assert sorted(rows_below(0)) == list(range(500))
    nested = 0
    for node in tree.nodes:
        centres, radii = node.centres, node.radii
        for n, (centre, radius, child) in enumerate(zip(centres, radii, node.children)):
            below = np.array(rows_below(child) if child >= 0 else node.rows[node.leaf == n])
            assert hn.spread(tree.x, tree.rest, np.array([centre]), below).max() <= radius + 1e-6
            nested += 1
        if len(centres) > 1:  # centres of one level are farther apart than any of them covers
            gaps = hn.spread(tree.x, tree.rest, centres, centres) + np.eye(len(centres)) * 1e9
            assert gaps.min() >= radii.max() - 1e-6
    assert nested > 10 and len(tree.nodes) > 1


def test_far_nodes_are_left_out():
    rng = np.random.default_rng(6)
    centres = 3000 * rng.normal(size=(40, 8))
    x = np.rint(np.repeat(centres, 100, 0) + rng.normal(size=(4000, 8))).astype(np.int64)
    tree = hn.CoverTree(np.arange(4000), np.arange(4000) % 2, x, float((x * x).sum(1).max()))
    opened = []
    nodes = tree.nodes

    class Watched(list):
        def __getitem__(self, at):
            opened.append(at)
            return nodes[at]

    tree.nodes = Watched(nodes)
    ((found,),) = tree.search(x[:1], [([(-(1 << 62), 1 << 62)], 0, 0)], 5, True)
    scores = x @ x[0]
    want = sorted((-int(s), i) for i, s in enumerate(scores) if i % 2 == 0 and i)[:5]
    assert found == want and len(opened) < len(nodes) / 4
