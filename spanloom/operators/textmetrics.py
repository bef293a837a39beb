"""Text metrics over a table of (prediction, reference) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pairs import (
    bleu_counts,
    bleu_score,
    greedy_match_udf,
    lcs_counts,
    match_rows,
    rouge_f,
    rouge_words,
    stem_tokens,
    tokens_13a,
)

from .workers import once_per_worker

# Texts whose vectors are held at a time.
EMBED_ROWS = 64

Embedder = Callable[[list[str]], list[np.ndarray]]


def rouge_l(df: DataFrame, pred: str, ref: str, stem: bool = True, out: str = "rouge_l") -> DataFrame:
    counted = df.withColumn("lcs_counts", lcs_counts(F.col(pred), F.col(ref), stem))
    return counted.withColumn(out, rouge_f(F.col("lcs_counts"))).drop("lcs_counts")


def bleu4(df: DataFrame, pred: str, ref: str, out: str = "bleu4") -> DataFrame:
    counted = df.withColumn("bleu_counts", bleu_counts(F.col(pred), F.col(ref)))
    return counted.withColumn(out, bleu_score(F.col("bleu_counts"))).drop("bleu_counts")


def tokenize_13a(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, F.filter(F.split(tokens_13a(F.col(text)), " "), lambda t: t != ""))


def stemmed_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """ROUGE tokens of a text, stemmed."""
    words = F.split(stem_tokens(rouge_words(F.col(text))), " ")
    return df.withColumn(out, F.filter(words, lambda t: t != ""))


def embed_tokens(
    df: DataFrame, embedder_factory: Callable[[], Embedder], columns: list[str], suffix: str = "_emb"
) -> DataFrame:
    """Add token embeddings (``array<array<float>>``) of text columns, one model per worker."""
    load = once_per_worker(embedder_factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for batch in batches:
            added = {}
            for name in columns:
                rows = embed(batch[name].fillna("").tolist())
                added[name + suffix] = [[v.tolist() for v in row] for row in rows]
            yield batch.assign(**added)

    vectors = T.ArrayType(T.ArrayType(T.FloatType()))
    added = [T.StructField(name + suffix, vectors) for name in columns]
    return df.mapInPandas(run, T.StructType([*df.schema.fields, *added]))


def embed_and_match(
    df: DataFrame, embedder_factory: Callable[[], Embedder], cand: str, ref: str, prefix: str = "bertscore"
) -> DataFrame:
    """Precision, recall and F1 of greedy matching between two texts of a row.

    Embedding and matching happen in one step, so vectors never leave the worker.
    """
    load = once_per_worker(embedder_factory)
    names = [f"{prefix}_{part}" for part in ("precision", "recall", "f1")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for batch in batches:
            texts, rows = [batch[c].fillna("").tolist() for c in (cand, ref)], []
            for at in range(0, len(batch), EMBED_ROWS):
                rows += match_rows(*(embed(side[at : at + EMBED_ROWS]) for side in texts))
            if rows:
                yield batch.assign(**dict(zip(names, map(list, zip(*rows)))))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def hashed_embedder(width: int = 16) -> Callable[[], Embedder]:
    """Stand-in embedder for tests: each word's vector is drawn from its digest."""

    def factory() -> Embedder:
        import hashlib
        from functools import lru_cache

        @lru_cache(maxsize=1 << 16)
        def vector(word: str) -> np.ndarray:
            seed = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
            return np.random.default_rng(seed).standard_normal(width).astype("float32")

        return lambda texts: [np.asarray([vector(w) for w in t.split()]) for t in texts]

    return factory


def greedy_match_score(df: DataFrame, cand_emb: str, ref_emb: str, prefix: str = "bertscore") -> DataFrame:
    """Precision, recall and F1 of greedy cosine matching between two embedding arrays of a row.

    Both arrays are bounded by the embedder's text length, and the cosines stay inside the task.
    """
    scored = df.withColumn("match", greedy_match_udf(F.col(cand_emb), F.col(ref_emb)))
    for part in ("precision", "recall", "f1"):
        scored = scored.withColumn(f"{prefix}_{part}", F.col("match")[part])
    return scored.drop("match")
