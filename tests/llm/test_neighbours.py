"""Neighbours against a full scan: exact at factor one, recall at the default."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import neighbours as nn
from spanloom.llm.queries import QUERIES


def slow(rows, k, every=nn.QUERY_EVERY):
    """rows: (id, vector) that take part, one per id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in zip(ids.tolist(), x):
        if i % every == 0:
            scores = (x * v).sum(axis=1)
            order = np.lexsort((ids, -scores))
            out[i] = [(int(ids[j]), scores[j]) for j in order if ids[j] != i][:k]
    return out


def check(df, rows, k=5, **options):
    got = {}
    for r in nn.nearest(df, k=k, factor=1.0, **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = slow(rows, k)
    assert set(got) == {q for q, w in want.items() if w}
    for q, found in got.items():
        assert [found[n + 1][0] for n in range(len(found))] == [w[0] for w in want[q]]
        assert [found[n + 1][1] for n in range(len(found))] == [w[1] for w in want[q]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("own")).withColumn("rank", F.lit(1))


def test_exact_with_any_norms_ties_and_shards(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)) * rng.exponential(2, (900, 1))
    x[100:400] = x[100]  # copies
    x = x.astype(np.float32)
    rows = [(int(i) - 50, v.tolist()) for i, v in enumerate(x)]
    for shard_rows in (10_000, 70):
        check(frame(spark, rows), [(i, v) for i, v in rows], shard_rows=shard_rows)


@pytest.mark.parametrize("size", [1e-7, 1e150, 1e-160])
def test_any_scale_is_ranked(spark, size):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 6)) * size
    x[50:80] = x[50]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nn.nearest(df, k=5, factor=1.0, shard_rows=100).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    unit = x / size
    for q, found in got.items():
        scores = unit @ unit[q]
        scores[q] = -np.inf
        order = np.lexsort((np.arange(500), -np.round(scores, 10)))[:5]
        assert np.allclose(scores[[found[n + 1] for n in range(5)]], scores[order], rtol=1e-9)
    assert len(got) == 25


@pytest.mark.parametrize("sigma", [0.5, 1.0, 2.0])
def test_recall_with_skewed_norms(spark, sigma):
    rng = np.random.default_rng(int(10 * sigma))
    x = rng.normal(size=(3000, 32)) * np.exp(sigma * rng.normal(size=(3000, 1)))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    want = slow(rows, 20)
    got = {}
    for r in nn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=700).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_queries_skip_shards_far_away():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(16, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, 200, 0) + 0.02 * rng.normal(size=(3200, 8))
    upper = nn.UpperTree(np.arange(3200), x, float((x * x).sum(1).max()), 16)
    homes = upper.home(x)
    places = {at: set(rows.tolist()) for at, rows in upper.near(np.arange(3200), x, 5, 1.0)}
    assert len(np.unique(homes)) == 16
    assert sum(map(len, places.values())) < 0.5 * 16 * 3200
    best = np.argsort(-(x @ x.T), axis=1)[:, :6]
    assert all(q in places[homes[m]] for q in range(0, 3200, 100) for m in best[q])


def test_rows_that_take_no_part(spark):
    nan, inf = math.nan, math.inf
    good = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, [0.0, 2.0])]
    bad = [(5, None), (40, [0.0, 0.0]), (6, [nan, 1.0]), (60, [inf, 1.0]), (7, [1.0, None]), (None, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0])]
    repeated = [(4, [0.0, 2.0]), (4, [1.0, 2.0])]
    check(frame(spark, good + bad + repeated), good)
    empty = frame(spark, good).filter(F.lit(False))
    assert nn.nearest(empty).count() == 0
    assert nn.nearest(frame(spark, bad[:2])).count() == 0
    assert nn.nearest(frame(spark, good[:1])).count() == 0


def test_query_recall(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = slow(rows, 20)
    got = {}
    for r in QUERIES["op9_nearest_neighbours"](spark, small_dir).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    hits = sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_pruning_leaves_work_out():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 100, 0) + 0.05 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = nn.VantageTree(np.arange(4000), x)
    exact_scores = np.sort(x[:50] @ x.T, axis=1)[:, ::-1][:, 1:21]
    scores, _ = tree.search(np.arange(50), x[:50], 20, 1.0)
    assert np.allclose(scores, exact_scores)
    relaxed, _ = tree.search(np.arange(50), x[:50], 20, nn.FACTOR)
    assert (relaxed[:, 0] >= exact_scores[:, 9]).all()
