"""Licence matches against an alignment over whole texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from spanloom.llm import licenses as lc
from spanloom.llm.common import word_hashes
from spanloom.llm.queries import QUERIES


def hashes(text):
    return word_hashes([lc.plain_words(text.encode())], 1)[0][0]


def slow_best(text, least=lc.LEAST_COVERAGE):
    """Matches by alignment over the whole text, without band or index."""
    words, out = hashes(text), []
    for n, template in enumerate(lc.index_of().words):
        parts = [(0, len(words))]
        while parts:
            a, b = parts.pop()
            matched, first, last = lc.align(template, words[a:b], 0, b - a + len(template))
            if matched >= least * len(template):
                out.append((n, matched, a + first, a + last))
                parts += [(a, a + first), (a + last + 1, b)]
    return lc.resolved(out, lc.index_of())


def best(text):
    return lc.matches_in(hashes(text), lc.index_of())


def test_winnowing_guarantee():
    rng = random.Random(1)
    import numpy as np

    for _ in range(300):
        h = np.array([rng.randrange(5) for _ in range(rng.randrange(0, 12))], np.uint64)
        for w in (1, 2, 4):
            kept = set(lc.winnow(h, w).tolist())
            assert all(kept & set(range(i, i + w)) for i in range(len(h) - w + 1))
            assert bool(kept) == bool(len(h))


def test_whole_and_altered_notices():
    rng = random.Random(2)
    filler = [f"f{i}" for i in range(200)]
    for n, (_, notice) in enumerate(lc.TEMPLATES):
        words = notice.split()
        for _ in range(3):
            own = words[:]
            if len(own) > 12:
                for _ in range(len(own) // 12):
                    at = rng.randrange(len(own))
                    rng.choice([lambda: own.__setitem__(at, "changed"), lambda: own.pop(at), lambda: own.insert(at, "added")])()
            text = " ".join([*rng.sample(filler, 30), *own, *rng.sample(filler, 30)])
            want = slow_best(text)
            assert best(text) == want
            assert n in {m[0] for m in want} or len(own) > 12
        assert [m[0] for m in best(f"x {notice.upper()} y")] == [n]


def test_clean_texts_and_parts_have_no_match():
    assert best("The work of the public and the license of a free man") == []
    assert best("Permission is hereby granted to go home") == []
    assert best("") == [] and best("all rights") == []


def test_spans_and_odd_rows(spark, documents):
    rows = [(1, "é Héllo.\nReleased under the MIT License.\nBye"), (1, "All rights reserved. x All  rights\nreserved!"), (None, "Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "word " * 50_000)]
    docs = documents(rows, clashing=True)
    got = lc.scan(docs).collect()
    spans = sorted(((r.doc_id, r.license, next(t[r.start_char : r.end_char] for d, t in rows if d == r.doc_id and (r.license == "All-rights-reserved") == ("rights" in t))) for r in got if r.coverage == 1), key=str)
    assert spans == sorted(
        [
            (1, "MIT", "Released under the MIT License"),
            (1, "All-rights-reserved", "All rights reserved"),
            (1, "All-rights-reserved", "All  rights\nreserved"),
            (None, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
        ],
        key=str,
    )
    assert lc.scan(docs.filter(F.lit(False))).count() == 0


def test_query_against_whole_alignment(spark, small_dir):
    got = {}
    for r in QUERIES["op10_license_scan"](spark, small_dir).collect():
        got.setdefault(r.doc_id, []).append((r.template, r.n_matched))
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    short = [d for d in docs if len(d.text) < 500]
    for d in short:
        assert sorted(got.get(d.doc_id, [])) == sorted(m[:2] for m in slow_best(d.text))
    assert got
