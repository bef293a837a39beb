"""Token rows, training batches and padding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import attention_mask, mask_labels, pad_ids, truncate_ids
from ..shared import stash
from .hotkeys import dealt
from .workers import once_per_worker

# Rows that one task ranks, about; bins are cut finer above.
BIN_ROWS = 50_000

Tokenizer = Callable[[list[str]], list[list[int]]]


def tokenize(
    df: DataFrame, tokenizer_factory: Callable[[], Tokenizer], text: str = "text", out: str = "input_ids"
) -> DataFrame:
    """Add token ids. The factory runs once per worker, the tokenizer once per batch."""
    load = once_per_worker(tokenizer_factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for batch in batches:
            yield batch.assign(**{out: encode(batch[text].fillna("").tolist())})

    ids = T.StructField(out, T.ArrayType(T.IntegerType()))
    return df.mapInPandas(run, T.StructType([*df.schema.fields, ids]))


def hashed_tokenizer(vocabulary: int = 32_000, reserved: int = 16) -> Callable[[], Tokenizer]:
    """Stand-in tokenizer for tests: blank-separated words, each numbered by its digest."""

    def factory() -> Tokenizer:
        import hashlib
        import re
        from functools import lru_cache

        @lru_cache(maxsize=1 << 16)
        def word_id(word: str) -> int:
            return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % vocabulary + reserved

        def encode(texts: list[str]) -> list[list[int]]:
            return [[word_id(w) for w in re.split(r"[ \t\r\n\f\v]+", t) if w] for t in texts]

        return encode

    return factory


def assign_batches(df: DataFrame, size: int, seed: int, key: Sequence[str], bin_digits: int | None = None) -> DataFrame:
    """Number rows in seeded hash order (``row_no``) and cut them into batches of ``size``.

    Rows are ranked inside bins of their digest's leading digits, whose number follows from the row
    count (one more pass) unless given; bin offsets come from counts that are combined map-side. The
    only unpartitioned window is over the bin counts. Every batch but the last is full.
    """
    rows = 0
    if bin_digits is None:
        bin_digits, rows = 1, df.count()
        while rows > BIN_ROWS * 16**bin_digits:
            bin_digits += 1
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))
    hashed = df.withColumn("batch_hash", digest).withColumn("bin", F.substring("batch_hash", 1, bin_digits))
    counts = hashed.groupBy("bin").agg(F.count(F.lit(1)).alias("n_bin"))
    offsets = counts.select("bin", (F.sum("n_bin").over(W.orderBy("bin")) - F.col("n_bin")).alias("offset"))
    rank = F.row_number().over(W.partitionBy("bin").orderBy("batch_hash", *key))
    return (
        dealt(hashed, rows, "bin", task_rows=BIN_ROWS)
        .withColumn("rank", rank - 1)
        .join(offsets, "bin")
        .withColumn("row_no", F.col("offset") + F.col("rank"))
        .withColumn("batch", F.floor(F.col("row_no") / F.lit(size)).cast("bigint"))
        .drop("batch_hash", "bin", "offset", "rank")
    )


def pad_batch(df: DataFrame, batch: str, pad_id: int, side: str = "right", ids: str = "input_ids") -> DataFrame:
    """Pad ids to the longest row of their batch and add ``attention_mask``.

    The widths are an aggregate joined back, so that a large batch is never gathered in one task.
    The input, often a tokenizer's output, runs once and is written.
    """
    df = stash(df, "unpadded")
    widths = df.groupBy(batch).agg(F.max(F.size(ids)).alias("batch_width"))
    return (
        dealt(df, df.count(), batch, task_rows=BIN_ROWS)
        .join(widths, batch)
        .withColumn("attention_mask", attention_mask(F.col(ids), F.col("batch_width"), side))
        .withColumn(ids, pad_ids(F.col(ids), F.col("batch_width"), pad_id, side))
        .drop("batch_width")
    )


def training_rows(
    df: DataFrame, marker: Sequence[int], pad_id: int, max_length: int, ids: str = "input_ids"
) -> DataFrame:
    """Cut ids to ``max_length`` and add ``labels``; ``is_masked_out`` marks rows that train on nothing."""
    cut = df.withColumn(ids, truncate_ids(F.col(ids), max_length))
    labelled = cut.withColumn("labels", mask_labels(F.col(ids), marker, pad_id))
    return labelled.withColumn("is_masked_out", ~F.exists("labels", lambda v: v != F.lit(-100)))
