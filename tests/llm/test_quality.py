"""Measures against plain loops; the SQL of the query covers the whole table."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from spanloom.llm import quality
from spanloom.llm.common import WORD_PATTERN
from spanloom.llm.queries import ORACLES, QUERIES


def slow(text):
    words = re.findall(WORD_PATTERN, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD_PATTERN, x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if counts[w] > 1 for o in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a b c a b", "x " * 60, "a b a b a b a b", "#*$%&|<> \U0001f600 é",
    "l\nl\n l\n\n\nl", "\x0bv\x0cw\x1cx\x85y\xa0z", "The cat and the dog of it " * 10, " ".join(f"w{i}" for i in range(80)) + " the of and",
    " ".join(f"w{i % 977}" for i in range(30_000)),
]


def test_against_loops(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b c a b c"), (3, "one")]
    got = quality.judge(documents(rows, clashing=True)).collect()
    want = [(d, *slow(t)) for d, t in rows]
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (not r.base_failed and not r.failed) for r in got)
    assert quality.judge(documents(rows).filter(F.lit(False))).count() == 0


def test_thresholds(spark, documents):
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} the" for i in range(60))
    cases = {1: words, 2: words.upper(), 3: words.replace(" the", " | the"), 4: words.replace(" the", " b"), 5: "\n".join(w + " the..." for w in words.split())}
    got = {r.doc_id: list(r.failed) for r in quality.judge(documents(list(cases.items()))).collect()}
    assert got[1] == [] and got[2] == ["upper_case_ratio"] and "symbols_per_word" in got[3]
    assert got[4] == ["stop_word_ratio"] and "ellipsis_line_ratio" in got[5]


def test_no_python_runs(spark, documents):
    plan = quality.judge(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_query_against_sql(spark, small_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small_dir}/documents.parquet'")
    got = QUERIES["op6_quality_rules"](spark, small_dir)
    want = con.execute(ORACLES["op6_quality_rules"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
