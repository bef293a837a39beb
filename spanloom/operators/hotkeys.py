"""Ordered per-key work when one key may hold a large part of all rows.

A window over a key sorts the key's rows in one task. That is fine for ordinary keys. Keys above
``limit`` rows are instead range-partitioned by (key, order), which spreads one key over many even
chunks; windows then run per (key, chunk), and what crosses a chunk border is carried over by the
caller on one summary row per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stash

ROW_LIMIT = 1_000_000
# Rows that one task sorts, about.
TASK_ROWS = 200_000


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key. Reads the key column only and is combined map-side."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def dealt(df: DataFrame, n_rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many tasks as its ``n_rows`` need, so that a task's memory does not follow them.

    Few rows are left to the planner.
    """
    if n_rows <= task_rows:
        return df
    return df.repartition(max(-(-n_rows // task_rows), df.sparkSession.sparkContext.defaultParallelism), *keys)


def split_hot(
    df: DataFrame, key: str, limit: int | None, counts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of ordinary keys, rows of hot keys (None when there is no hot key), and how many these are.

    ``counts`` (key, n_rows) may be given where it is cheaper to get than from ``df`` itself.
    """
    if limit is None:
        return df, None, 0
    sizes = key_counts(df, key) if counts is None else counts
    hot = stash(sizes.filter(F.col("n_rows") > limit), "hot-keys")
    n_hot = hot.agg(F.sum("n_rows")).first()[0]
    if not n_hot:
        return df, None, 0
    # No broadcast hint: the planner sees the written list's size and chooses.
    hot = hot.select(key)
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi"), n_hot


def cut_chunks(df: DataFrame, key: str, order: Sequence[Column], n_rows: int, chunk_rows: int) -> DataFrame:
    """Add ``chunk``: even pieces of the (key, order) sequence, numbered in sequence order.

    Their number follows from the row count, so a chunk stays of one size whatever the data's. The
    cut is written down because range bounds come from sampling and several branches read it.
    """
    pieces = -(-n_rows // chunk_rows)
    ranged = df.repartitionByRange(pieces, F.col(key), *order)
    return stash(ranged.withColumn("chunk", F.spark_partition_id()), "chunks")


def chunked(
    df: DataFrame,
    key: str,
    order: Sequence[Column],
    limit: int | None = ROW_LIMIT,
    chunk_rows: int = ROW_LIMIT,
    counts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """All rows with ``chunk`` (0 for ordinary keys), and the rows of hot keys alone for carrying."""
    cool, hot, n_hot = split_hot(df, key, limit, counts)
    cool = cool.withColumn("chunk", F.lit(0))
    if hot is None:
        return cool, None
    hot = cut_chunks(hot, key, order, n_hot, chunk_rows)
    return cool.unionByName(hot), hot
