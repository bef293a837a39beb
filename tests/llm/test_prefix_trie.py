"""Trie nodes against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import prefix_trie as pt


def slow(rows):
    """rows: (conv_id, turn, role, text); equal turns of a conversation do not occur unless equal."""
    whole = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            whole[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    turns = {c: [t for _, t in sorted(own)] for c, own in whole.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        full[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in sorted(full.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = len([w for w in (node[-1][1] if node else "").encode().split()])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * own + sum(saved[k] for k in children[node])
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(full[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("own") for c in ("path", "words", "shard", "base", "digest", "kind")})
    got = pt.prefix_trie(df, **options)
    assert got.columns == list(pt.NODE_COLUMNS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(rows)


def talks(seed, n=400, vocabulary=3, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.3:  # copies of one conversation
            own = [("user", "hot first words"), ("assistant", "and an answer"), ("user", "bye")]
        else:
            own = [(rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randrange(vocabulary))) for _ in range(rng.randrange(1, longest))]
        rows += [(c, t, *turn) for t, turn in enumerate(own)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [100_000, 100, 11])
def test_equals_dictionary(spark, shard_turns):
    check(spark, talks(1), shard_turns=shard_turns)


def test_hot_copies_fill_many_shards_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_IDS", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4)] + [(300, t, "user", f"turn {t}") for t in range(9)]
    check(spark, rows, shard_turns=60)


def test_deep_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(pt, "KEY_TURNS", 5)
    rows = [(c, t, "user", f"turn {t if t < 30 - c % 3 else c}") for c in range(40) for t in range(30)]
    rows += [(41, 0, "user", "long " * 200_000), (42, 0, "user", "long " * 200_000)]
    check(spark, rows, shard_turns=50)


def test_odd_rows(spark):
    rows = [
        (5, 1, None, "a"), (5, None, "user", None), (5, 2, "", ""), (None, 0, "user", "a"), (20, 0, "user", "a b c"), (21, 0, "user", "x"),
        (21, 1, "user", "y"), (-3, 0, "user", "x"), (-20, 0, "user", "x"), (41, 0, "user", "only"), (40, 0, "user", "head"), (7, 3, "user", "a"),
        (7, 3, "user", "a"), (2**62, 0, "user", "x"), (9, 0, "1:", "a"), (10, 0, "1", ":a"),
    ]
    check(spark, rows)
    check(spark, rows, shard_turns=3)
    assert pt.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert pt.prefix_trie(spark.createDataFrame([(None, 0, "u", "t")], "conv_id long, turn long, role string, text string")).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    # 21 and others take their first turns from 20, which is not there.
    rows = [(c, 0, "user", f"t{c}") for c in range(21, 40)]
    check(spark, rows)


def test_query_equals_dictionary(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows, shard_turns=40)
