from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from spanloom.functions.pairs import common_length, greedy_match, ngram_overlaps
from spanloom.functions.stemming import porter_stem
from spanloom.operators.textmetrics import (
    bleu4,
    embed_tokens,
    greedy_match_score,
    hashed_embedder,
    rouge_l,
    stemmed_tokens,
    tokenize_13a,
)


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"),
        ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"),
        ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"),
        ("triplicate", "triplic"), ("hopefulness", "hope"), ("goodness", "good"), ("revival", "reviv"),
        ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"),
        ("controll", "control"), ("roll", "roll"), ("dying", "die"), ("skies", "sky"), ("news", "news"),
        ("by", "by"), ("enjoy", "enjoy"), ("walking", "walk"), ("parking", "park"), ("geology", "geolog"),
    ],
)
def test_porter(word, stem):
    assert porter_stem(word) == stem


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_common_length_against_table():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        assert common_length(a, b) == brute_lcs(a, b)


def test_rouge_l(spark):
    rows = [
        ("the dog sat the mat big", "the cat sat on the mat"),
        ("", "a b"),
        ("A man is WALKING!", "a man walks"),
        (None, "x"),
    ]
    df = spark.createDataFrame(rows, "p string, r string")
    got = [r[0] for r in rouge_l(df, "p", "r").select("rouge_l").collect()]
    assert got == pytest.approx([2 / 3, 0.0, 2 * (3 / 4) * 1 / (3 / 4 + 1), 0.0])
    unstemmed = [r[0] for r in rouge_l(df, "p", "r", stem=False).select("rouge_l").collect()]
    assert unstemmed[2] == pytest.approx(2 * (2 / 4) * (2 / 3) / (2 / 4 + 2 / 3))


def brute_bleu(pred, ref):
    logs, misses = 0.0, 0
    for n in range(1, 5):
        grams = lambda words: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        have, want = grams(pred), grams(ref)
        if not have:
            return 0.0
        hit = sum(min(have.count(g), want.count(g)) for g in set(have))
        if n == 1 and hit == 0:
            return 0.0
        if hit == 0:
            misses += 1
            logs += math.log(1 / (2**misses * len(have)))
        else:
            logs += math.log(hit / len(have))
    brevity = math.exp(1 - len(ref) / len(pred)) if len(pred) < len(ref) else 1.0
    return brevity * math.exp(logs / 4)


def test_bleu_against_counting(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        ref = [rng.choice("abcdef") for _ in range(rng.randint(1, 15))]
        pred = [w for w in ref if rng.random() > 0.2] + [rng.choice("abz") for _ in range(rng.randint(0, 3))]
        pairs.append((" ".join(pred), " ".join(ref)))
    df = spark.createDataFrame(pairs, "p string, r string")
    for row in bleu4(df, "p", "r").collect():
        assert row["bleu4"] == pytest.approx(brute_bleu(row["p"].split(), row["r"].split()), abs=1e-12)


def test_batches_are_counted_in_packs(spark, monkeypatch):
    from spanloom.functions import pairs as module

    monkeypatch.setattr(module, "WORDS_PER_PACK", 3)
    rows = [(" ".join("ab" * i), "a b a b") for i in range(6)]
    frame = module._overlap_udf.func(*(module.pd.Series(side) for side in zip(*rows)))
    assert [int(m[0]) for m in frame["matches"]] == [0, 2, 4, 4, 4, 4]
    assert [int(t[0]) for t in frame["totals"]] == list(range(0, 12, 2))


def test_bleu_edges(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("", "a"), ("w x y z", "a b c d"), ("a b c d", "a b c d")], "p string, r string")
    assert [r["bleu4"] for r in bleu4(df, "p", "r").collect()] == pytest.approx([0.0, 0.0, 0.0, 1.0])


def test_tokens_13a(spark):
    text = 'He said, "It\'s 3.5-4 &amp; 1,000."\nEnd-\nless (yes)!'
    df = spark.createDataFrame([(text,)], "t string")
    assert tokenize_13a(df, "t").first()["tokens"] == (
        "He said , \" It's 3.5 - 4 & 1,000 . \" Endless ( yes ) !".split()
    )


def test_stemmed_tokens(spark):
    df = spark.createDataFrame([("Walking, the dogs RAN quickly.",)], "t string")
    assert stemmed_tokens(df, "t").first()["tokens"] == ["walk", "the", "dog", "ran", "quickli"]


def test_ngram_overlap_clips():
    matches, totals = ngram_overlaps(["a a a b".split(), [], ["x"]], ["a a c".split(), ["a"], []])
    assert matches.tolist() == [[2, 1, 0, 0], [0] * 4, [0] * 4]
    assert totals.tolist() == [[4, 3, 2, 1], [0] * 4, [1, 0, 0, 0]]
    assert ngram_overlaps([], [])[0].shape == (0, 4)


def test_greedy_match(spark):
    cand, ref = np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([[1.0, 1.0]])
    p, r, f = greedy_match(cand, ref)
    assert (p, r) == pytest.approx((math.sqrt(0.5), math.sqrt(0.5)))
    df = spark.createDataFrame([("a b", "a b"), ("a", "")], "x string, y string")
    rows = greedy_match_score(embed_tokens(df, hashed_embedder(), ["x", "y"]), "x_emb", "y_emb").collect()
    assert rows[0]["bertscore_f1"] == pytest.approx(1.0, abs=1e-6)
    assert rows[1]["bertscore_f1"] == 0.0


def test_rows_matched_together_equal_single_ones():
    from spanloom.functions import pairs

    rng = np.random.default_rng(3)
    side = lambda n: [None if k < 0 else rng.standard_normal((k, 4)).tolist() for k in rng.integers(-1, 40, n)]
    cand, ref = side(200), side(200)
    cand[0], ref[0] = rng.standard_normal((3, 4)), np.zeros((2, 4))
    want = [pairs.greedy_match(pairs._matrix(c), pairs._matrix(r)) for c, r in zip(cand, ref)]
    calls = []
    unit, pairs._unit = pairs._unit, lambda rows: calls.append(1) or unit(rows)
    try:
        for most in (1 << 20, 500):
            pairs.MOST_COSINES, calls[:] = most, []
            np.testing.assert_allclose(pairs.match_rows(cand, ref), want, atol=1e-12)
            assert most == 500 or len(calls) == 2  # once a side, not once a row
    finally:
        pairs._unit, pairs.MOST_COSINES = unit, 1 << 20


def test_overlap_memory_does_not_follow_the_batch():
    import tracemalloc

    from spanloom.functions import pairs

    rng = random.Random(4)
    texts = pd.Series([" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(3000)])
    tracemalloc.start()
    got = pairs._overlap_udf.func(texts, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["matches"].tolist() == [[400, 399, 398, 397]] * 3000
    assert peak < 80e6  # 2,400,000 words as strings take 150 MB
