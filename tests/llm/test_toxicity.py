"""Models against direct sums, held-out accuracy, and what is never learnt from."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import toxicity as tx
from spanloom.llm.queries import QUERIES


def slow_ratio(counts, gram, discount=tx.DISCOUNT):
    """Log ratio of a letter after four others by the textbook formula. ``counts``: gram -> (ordinary, toxic)."""

    def shared(tail):
        if not tail:
            return 1 / len({g[-1] for g in counts})
        below = {g[-len(tail) - 1 :] for g in counts}
        kinds = lambda t: len({b for b in below if b[1:] == t})
        same = {b[1:] for b in below if b[1:-1] == tail[:-1]}
        total = sum(kinds(t) for t in same)
        return (max(kinds(tail) - discount, 0) + discount * len(same) * shared(tail[1:])) / total

    logs = []
    for c in (0, 1):
        after = {g: n[c] for g, n in counts.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            logs.append(math.log(shared(gram[1:])))
            continue
        left = discount * sum(n > 0 for n in after.values()) / total
        logs.append(math.log(max(after.get(gram, 0) - discount, 0) / total + left * shared(gram[1:])))
    return logs[1] - logs[0]


def test_log_ratios_follow_the_formula():
    rng = random.Random(1)
    counts = defaultdict(lambda: [0, 0])
    for _ in range(60):
        word = "\x02" * 4 + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + "\x03"
        for i in range(len(word) - 4):
            counts[word[i : i + 5]][rng.random() < 0.3] += rng.randrange(1, 4)
    grams = sorted(counts)
    letters = np.array([[ord(c) for c in g] for g in grams], np.uint32)
    ratio, _ = tx.log_ratios(letters, np.array([counts[g] for g in grams]))
    for g, r in zip(grams, ratio):
        assert r == pytest.approx(slow_ratio(counts, g), abs=1e-9)


def test_joined_ratios_follow_the_formula(spark):
    rng = random.Random(2)
    counts = defaultdict(lambda: [0, 0])
    for _ in range(60):
        word = "\x02" * 4 + "".join(rng.choice("ab\U0010ffff") for _ in range(rng.randrange(1, 5))) + "\x03"
        for i in range(len(word) - 4):
            counts[word[i : i + 5]][rng.random() < 0.3] += rng.randrange(1, 4)
    grams = sorted(counts)
    letters = np.array([[ord(c) for c in g] for g in grams], np.uint32)
    x, y = tx.packed(letters)
    assert (tx.unpacked(x, y) == letters).all()
    rows = [(*map(int, p), *counts[g]) for *p, g in zip(x, y, grams)]
    ratios, contexts = tx.ratio_tables(spark.createDataFrame(rows, "x long, y long, ordinary long, toxic long"))
    want, other = tx.log_ratios(letters, np.array([counts[g] for g in grams]))
    got = {(r.x, r.y): r.ratio for r in ratios.collect()}
    assert [got[r[:2]] for r in rows] == pytest.approx(list(want), abs=1e-9)
    got = {(r.x, r.cy): r.other for r in contexts.collect()}
    assert [got[r[0], r[1] >> 21] for r in rows] == pytest.approx(list(other), abs=1e-9)


def test_every_sequence_is_counted_by_itself(spark):
    # So many sequences that thousands would share one of 2^20 hashed places.
    words = [a + b + c + d + e for a in "bcdfghjklmnpqrst" for b in "aeiouyäö" for c in "bcdfghjklmnpqrst" for d in "aeiouyäö" for e in "bcdfg"]
    rows = spark.createDataFrame([(" ".join(words), 0), ("badeg", 1)], "text string, toxic int")
    want = {"\x02" * 4 + w + "\x03" for w in words}
    want = {w[i : i + 5] for w in want for i in range(len(w) - 4)}
    got = tx.gram_counts(rows).collect()
    assert len(got) == len(want)
    assert {"".join(map(chr, g)) for g in tx.unpacked(*(np.array([r[k] for r in got]) for k in (0, 1)))} == want


def test_joined_models_score_like_broadcast_ones(spark, documents, monkeypatch):
    docs, labels, _ = corpus(documents, spark, 300)
    docs = docs.unionByName(documents([(None, None), (5_000, None), (5_001, ""), (5_001, "zlorg " * 2_000), (3, "x y"), (4, "x y")], clashing=True))
    want = sorted((r.doc_id or -1, r.score) for r in tx.classify(docs, labels).collect())
    kept = sorted(map(str, tx.without_toxic(docs, labels).collect()))
    monkeypatch.setattr(tx, "BROADCAST_GRAMS", 10)
    monkeypatch.setattr(tx, "JOINED_BYTES", 10_000)
    got = sorted((r.doc_id or -1, r.score) for r in tx.classify(docs, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-4)
    again = tx.without_toxic(docs, labels)
    assert again.columns == docs.columns and sorted(map(str, again.collect())) == kept


def test_letter_grams():
    grams, word = tx.letter_grams(["ab", "", "é"])
    assert ["".join(map(chr, g)) for g in grams] == ["\x02\x02\x02\x02a", "\x02\x02\x02ab", "\x02\x02ab\x03", "\x02\x02\x02\x02\x03", "\x02\x02\x02\x02é", "\x02\x02\x02é\x03"]
    assert word.tolist() == [0, 0, 0, 1, 2, 2]


def corpus(documents, spark, n=900, shift=0):
    rng = random.Random(11)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["zlorg", "VEKU" + rng.choice(syllables), "zlorg!"])
        rows.append((i + shift, " ".join(words)))
        labels.append((i + shift, int(toxic)))
    return documents(rows, clashing=True), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_filter(spark, documents):
    docs, labels, truth = corpus(documents, spark)
    odd = documents([(None, None), (5_000, None), (5_001, ""), (5_001, "zlorg " * 20_000)], clashing=True)
    rows = tx.classify(docs.unionByName(odd), labels).collect()
    assert len(rows) == 904
    by_id = {r.doc_id: r for r in rows}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    right = [by_id[i].predicted == t for i, t in truth.items() if by_id[i].held_out]
    assert sum(right) / len(right) > 0.97
    kept = tx.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in truth if by_id[i].predicted == 0}


def test_held_out_labels_do_not_matter(spark, documents):
    docs, labels, _ = corpus(documents, spark, 300)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, tx.classify(docs, x).collect())) for x in (labels, turned))
    assert [r[:2] + r[3:] for r in a] == [r[:2] + r[3:] for r in b]
    assert [r[2] for r in a] == pytest.approx([r[2] for r in b])


def test_without_labels_or_rows(spark, documents):
    docs, labels, _ = corpus(documents, spark, 40)
    nulls = labels.withColumn("toxic", F.lit(None).cast("int"))
    for none in (labels.filter(F.lit(False)), nulls, labels.withColumn("toxic", F.lit(0))):
        assert {r.score for r in tx.classify(docs, none).collect()} == {0.0}
    assert tx.classify(docs.filter(F.lit(False)), labels).count() == 0


def test_query_runs(spark, small_dir):
    rows = QUERIES["op8_toxicity"](spark, small_dir).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 for r in rows)


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.mark.parametrize("folds", [(1, 2, 3), (4,), (2,)])
def test_toxic_rows_outside_some_folds(spark, documents, folds):
    docs, labels, truth = corpus(documents, spark)
    inside = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).isin(*folds)
    scores = {r.doc_id: r.predicted for r in tx.classify(docs, labels.filter((F.col("toxic") == 0) | inside)).collect()}
    held = [i for i in truth if fold(i) == 0]
    assert sum(scores[i] == truth[i] for i in held) / len(held) > 0.9
    assert sum(scores[i] for i in held if truth[i]) > 0.6 * sum(truth[i] for i in held)


def test_one_toxic_row(spark, documents):
    docs, labels, truth = corpus(documents, spark)
    only = next(i for i, t in truth.items() if t and fold(i))
    found = {r.doc_id for r in tx.classify(docs, labels.filter((F.col("toxic") == 0) | (F.col("doc_id") == only))).collect() if r.predicted}
    assert only in found and sum(not truth[i] for i in found) < 0.05 * len(truth)


def test_a_small_sample_keeps_the_rare_class(spark, documents, monkeypatch):
    monkeypatch.setattr(tx, "CURVE_ROWS", 20)
    docs, labels, truth = corpus(documents, spark, 2000)
    rare = {i for i, t in truth.items() if t and fold(i) and i % 20 == 0}
    some = labels.filter((F.col("toxic") == 0) | F.col("doc_id").isin(*rare))
    found = {r.doc_id for r in tx.classify(docs, some).collect() if r.predicted}
    toxic = {i for i, t in truth.items() if t and fold(i) == 0}
    assert len(found & toxic) > 0.8 * len(toxic)
    assert sum(not truth[i] for i in found) < 0.05 * len(truth)
