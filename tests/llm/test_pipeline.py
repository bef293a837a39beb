"""Stages on a small corpus, each against what it promises."""

from __future__ import annotations

import corpus_pipeline
from spanloom.llm import substring
from spanloom.shared import stash

from .test_near_copies import jaccard
from .test_substring import slow_keep
from .test_tokens import check_packing


def groups(rows, least):
    """Components of documents by the exact similarity of their shingles."""
    label = {r.doc_id: r.doc_id for r in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if jaccard(a.text, b.text) >= least:
                label[max(top(a.doc_id), top(b.doc_id))] = min(top(a.doc_id), top(b.doc_id))
    out = {}
    for i in label:
        out.setdefault(top(i), []).append(i)
    return out


def check_near_copies(rows, kept):
    """One document of each group at 0.8 stays, and one at least of what is alike at 0.6."""
    assert len(kept) == len(set(kept))
    assert all(len(set(kept).intersection(group)) <= 1 for group in groups(rows, 0.8).values())
    assert all(least in kept for least in groups(rows, 0.6))


ODD = [
    (1, None, "a"), (2, "", "a"), (3, "same words in two rows of the table", "b"), (3, "same words in two rows of the table", "b"),
    (None, "a row without an id " * 20, None), (4, "word " * 30_000, "b"), (5, "same words in two rows of the table", None),
]


def test_stages_of_odd_rows(spark, documents, small_dir):
    """Nulls, repeats, a long text, clashing names and no rows at all pass through every stage."""
    for rows in (ODD, []):
        docs = documents(ODD, clashing=True)
        docs = docs if rows else docs.limit(0)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stash(stage(spark, docs, small_dir), "test-odd")
            if name != "packing":
                assert docs.columns == columns
        found = docs.collect()
        assert bool(found) == bool(rows)
        check_packing(found, 2048)


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = tables[name] = stash(stage(spark, docs, small_dir), "test-stage")
        if name != "packing":
            assert docs.columns == columns
    clean = tables["toxicity"].collect()
    assert 0 < len(clean) <= 200
    check_near_copies(clean, [r.doc_id for r in tables["near_dedup"].collect()])
    single = [(r.doc_id, r.text) for r in tables["near_dedup"].collect()]
    words, kept = slow_keep(single, substring.SIZE)
    want = {d: " ".join(k) if len(k) < len(w) else t for (d, t), w, k in zip(single, words, kept)}
    assert {r.doc_id: r.text for r in tables["substring_dedup"].collect()} == want
    mixed = [r.doc_id for r in tables["mixing"].collect()]
    assert set(mixed) <= set(want) and max(map(mixed.count, mixed)) <= 2
    pieces = tables["packing"].collect()
    check_packing(pieces, 2048)
    assert sorted(r.doc_id for r in pieces if r.start == 0) == sorted(mixed)


def test_run(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
