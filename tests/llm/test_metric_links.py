"""Range join by angle against all pairs: clusters, hot cells cut into blocks, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import metric_links as ml


def slow(rows, threshold):
    """rows: (vec_id, list or None) -> sorted (vec_id, n_links, component_id, kept)."""

    def good(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    ok = [good(v) for _, v in rows]
    units = [None if not g else np.ldexp(np.array(v, float), -math.frexp(max(map(abs, v)))[1]) for g, (_, v) in zip(ok, rows)]
    link = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(units[i]) == len(units[j]):
                x, y = units[i], units[j]
                if (x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())) >= threshold:
                    link[i].append(j)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = [], [i]
        seen.add(i)
        while todo:
            at = todo.pop()
            group.append(at)
            for j in link[at]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        least = min(ids) if ids else None
        for j in group:
            out[j] = (rows[j][0], len(link[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=str)


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumns({c: F.lit(f"own {c}") for c in ("node", "v", "cell", "kept", "copies", "n_links")})


def check(spark, rows, threshold=ml.LINK, kind="float", **options):
    got = ml.near_duplicates(frame(spark, rows, kind), threshold, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(rows, threshold)


def mixed(seed, dim=8, spread=0.08):
    """A hot group of near copies, smaller ones, chains and single vectors."""
    rng = np.random.default_rng(seed)
    hot = rng.normal(size=dim)
    x = [hot + spread * rng.normal(size=dim) for _ in range(120)]
    x += [hot + 4 * spread * rng.normal(size=dim) for _ in range(60)]
    for _ in range(15):
        centre = rng.normal(size=dim)
        x += [centre + spread * rng.normal(size=dim) for _ in range(6)]
    chain = rng.normal(size=(2, dim))
    x += [math.cos(a) * chain[0] + math.sin(a) * chain[1] for a in np.linspace(0, 1.5, 20)]
    x += list(rng.normal(size=(60, dim)))
    x = np.array(x) * rng.exponential(3, (len(x), 1))
    return x[rng.permutation(len(x))].astype(np.float32)


@pytest.mark.parametrize("cell_rows", [10_000, 60, 17])
def test_all_links_whatever_the_cells(spark, cell_rows):
    x = mixed(1)
    rows = [(int(i) - 30, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # exact copies
    check(spark, rows, cell_rows=cell_rows)


def test_threshold_and_doubles(spark):
    rows = [(int(i), v.tolist()) for i, v in enumerate(mixed(2, dim=5).astype(float))]
    check(spark, rows, threshold=0.7, kind="double", cell_rows=50)
    exact = [(1, [1.0, 0.0, 0.0, 0.0, 0.0]), (2, [19.0, 5.0, 3.0, 2.0, 1.0]), (3, [0.0, 0.0, 0.0, 0.0, 7.0]), (4, [18.99, 5.0, 3.0, 2.0, 1.0])]
    got = {r.vec_id: r.n_links for r in ml.near_duplicates(frame(spark, exact, "double")).collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 1}  # 19 / 20 is just enough


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1e-150, 0.0]), (3, [1e150, 1e140]), (None, [2.0, 0.0]), (4, None), (5, []),
        (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [1.0, None]), (None, None), (10, [1.0, 0.0, 0.0]), (11, [1.0]), (12, [-3.0]),
        (13, [5.0]), (None, [0.0, 1.0]), (14, [-0.0, 1.0]), (-5, [1.0, 0.1]),
    ]
    check(spark, rows, kind="double")
    assert ml.near_duplicates(frame(spark, rows).filter(F.lit(False))).collect() == []
    assert [tuple(r) for r in ml.near_duplicates(frame(spark, rows[5:6])).collect()] == [(4, 0, 4, True)]
    bare = spark.range(3).withColumnRenamed("id", "vec_id")
    assert sorted(tuple(r) for r in ml.near_duplicates(bare).collect()) == [(i, 0, i, True) for i in range(3)]


def test_a_hot_cell_makes_no_list_of_pairs(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=16)
    x = np.concatenate([hot + 0.05 * rng.normal(size=(4000, 16)), rng.normal(size=(2000, 16))])
    distinct = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "node long, v array<double>, copies long")
    found = ml.links(distinct, cell_rows=500).collect()
    assert len(found) < 6 * len(x)
    assert sum(r.links for r in found) >= 4000 * 3999


def test_core_members_stay_home():
    cell = ml.Cell(0, 4, 0.0, 0.2, 1, 4, 7)
    rows = {"node": np.arange(7, 11), "copies": np.ones(4, np.int64), "far": np.zeros(4)}
    block = ml.Block(cell, 0.95, rows, np.ones((4, 3)))
    assert block.links.tolist() == [3] * 4 and block.label.tolist() == [0, 1, 2, 3]
