"""Fingerprints and components against plain loops."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import near_dedup as nd
from spanloom.llm.queries import QUERIES


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=2):
    """rows: (id, fingerprint); smallest id that is not null per connected group of rows."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {}
    for (name, _), g in zip(rows, group):
        if name is not None:
            least[g] = min(name, least.get(g, name))
    return [least.get(g) for g in group]


def test_fingerprint():
    for text in (None, "", " \n", "one", "Two wörds", "a b c", "A\x0bB\x0cc d\re\tf É É x", "to be or not to be " * 40, "a b c d"):
        assert nd.fingerprint(text) % 2**64 == slow_fingerprint(text)
    assert nd.fingerprint("x y z " * 50_000) % 2**64 == slow_fingerprint("x y z " * 50_000)


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (2000, 3)).astype(np.uint64)
    values = np.unique(rng.choice(centres, 2000) ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    tree = nd.Tree(values)
    for radius in (0, 2, 5):
        q, m = tree.within(values, radius)
        want = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
        assert sorted(zip(q.tolist(), m.tolist())) == sorted(map(tuple, want.tolist()))


def flipped(value, *bits):
    for b in bits:
        value ^= 1 << b
    return value - (1 << 64) if value >= 1 << 63 else value


def test_components_of_chains_and_clusters(spark):
    rng = random.Random(3)
    values = set()
    chain = rng.getrandbits(64)
    for step in range(25):  # neighbours two bits apart, ends far apart
        values.add(flipped(chain % 2**64, *range(2 * step)))
    centre = rng.getrandbits(64)
    for _ in range(300):
        values.add(flipped(centre, *rng.sample(range(64), rng.randrange(4))))
    values.update(flipped(rng.getrandbits(64)) for _ in range(100))
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    fps = spark.createDataFrame([(v,) for _, v in rows], "fp long")
    for shard in (7, 30_000):  # large shards are asked by several tasks
        roots = dict(map(tuple, nd.components(nd.links(fps, shard_rows=shard)).collect()))
        mine = [roots.get(v, v) for _, v in rows]
        want = slow_components([(i, v % 2**64) for i, v in rows])
        pairs = set(zip(mine, want))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_query_against_loops(spark, small_dir):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, small_dir).collect()}
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d.doc_id, slow_fingerprint(d.text)) for d in docs]
    want = {d[0]: (f"{d[1]:016x}", c) for d, c in zip(rows, slow_components(rows))}
    assert got == want


def test_nulls_copies_and_clashing_columns(spark, documents):
    rows = [(3, "a b c d"), (2, "A B C D"), (2, "A B C D"), (None, "a b c d"), (9, None), (8, ""), (7, "some thing else entirely"), (None, "lonely words here now")]
    docs = documents(rows, clashing=True)
    found = nd.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(3, 2), (2, 2), (2, 2), (None, 2), (9, 8), (8, 8), (7, 7), (None, None)], key=str
    )
    kept = nd.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(2, "A B C D"), (8, ""), (7, "some thing else entirely"), (None, "lonely words here now")], key=str
    )
    empty = docs.filter(F.lit(False))
    assert nd.near_duplicates(empty).count() == 0 and nd.one_per_group(empty).count() == 0


def test_hot_shards_are_cut_into_parts_that_meet(spark):
    """200,000 fingerprints that share a piece: no task gets more than two parts, every pair meets."""
    fps = spark.range(200_000).select(F.expr("id * 8388608 + 12345").alias("fp"))
    sent = nd.dealt(fps, shard_rows=30_000).groupBy("key", "low", "high").count()
    assert sent.agg(F.max("count")).first()[0] < 2 * 30_000 * 1.1
    few = spark.range(300).select(F.expr("id * 8388608 + 12345").alias("fp"))
    met = nd.dealt(few, shard_rows=40).withColumn("place", F.struct("key", "low", "high"))
    both = met.alias("a").join(met.alias("b"), "place").select(F.col("a.fp").alias("x"), F.col("b.fp").alias("y")).distinct()
    assert both.count() == 300 * 300


def test_trees_have_edges():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    values[250:] = values[:250] ^ np.uint64(5)
    tree = nd.Tree(values)
    assert sum(len(n[1]) for n in tree.nodes if not isinstance(n, np.ndarray)) > 400
    q, m = tree.within(values, 2)
    want = np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2)
    assert sorted(zip(q.tolist(), m.tolist())) == sorted(map(tuple, want.tolist()))
