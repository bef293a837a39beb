"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents the same expected number of copies. The whole part is
taken outright; the fraction is a copy probability. Probabilities are settled in pairs: words are
moved at random from one document to the other until one of the two probabilities is 0 or 1, so that
every document keeps its expectation and the words of the pair stay the same. Blocks of documents
are settled in parallel; each leaves one open document at most, and these meet in a tree of further
rounds until one is left per source, which is drawn.

Nulls: a null text has size 0, a null source is one source (the last), a null id is kept. Documents
without words are settled among themselves, each counting one. Empty tables give empty results,
repeated rows are documents of their own, and equal seeds give equal results. Texts of any length count
by their words; columns of clashing names are carried along by the mixed documents, else not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stash
from .common import column_or_null, n_words

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 20_000
FAN_IN = 256
# Sources with their targets are broadcast up to this number, about 16 MB.
BROADCAST_SOURCES = 200_000

_ITEM = (
    "doc_id long, row_hash long, source string, size long, source_size long, target double, base long, "
    "fraction double, empty boolean, blocks long, block long"
)


def items_of(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, hash of the text, source and size in words."""
    text = column_or_null(docs, "text", "string")
    return docs.select(
        column_or_null(docs, "doc_id", "long").alias("doc_id"),
        F.xxhash64(text).alias("row_hash"),
        column_or_null(docs, "source", "string").alias("source"),
        n_words(text).alias("size"),
    )


def source_targets(
    items: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Per source: documents, size, and its target in words.

    Targets are ``weight * level`` with one level for all, cut at ``most`` times the source's size.
    In order of the level at which a source is cut, the first source that is not cut at the level
    left over by those before it fixes the level. Windows run over one row per source.
    """
    sources = items.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("size") > 0).alias("n_full")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    by_cut = Window.orderBy("cut_at", "source")
    before = by_cut.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("cut_at", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        sources.withColumn("weight", weight)
        .withColumn("bound", most * F.col("source_size"))
        .withColumn("cut_at", F.col("bound") / F.col("weight"))
        .withColumn("wanted", share * F.sum("source_size").over(everything))
        .withColumn(
            "level",
            (F.col("wanted") - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        )
        .withColumn("uncut", F.col("level") <= F.col("cut_at"))
        .withColumn("level", F.min(F.when(F.col("uncut"), F.struct("cut_at", "source", "level"))).over(everything)["level"])
    )
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("bound")), F.col("bound"))
    return leveled.select("source", "n_docs", "n_full", "source_size", target.cast("double").alias("target"))


def _settle(x: np.ndarray, mass: np.ndarray, draws: np.ndarray) -> int:
    """Settle fractions in place; the position of the one left open, or -1."""
    open_at = -1
    for j in range(len(x)):
        if not 0.0 < x[j] < 1.0:
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        ratio = mass[i] / mass[j]
        to_i, to_j = min(1.0 - x[i], x[j] / ratio), min(x[i], (1.0 - x[j]) / ratio)
        if draws[j] * (to_i + to_j) < to_j:
            full = 1.0 - x[i] <= x[j] / ratio
            x[j] = max(0.0, x[j] - to_i * ratio)
            x[i] += to_i
            if full:
                x[i], open_at = 1.0, j
            else:
                x[j] = 0.0
        else:
            none = x[i] <= (1.0 - x[j]) / ratio
            x[j] = min(1.0, x[j] + to_j * ratio)
            x[i] -= to_j
            if none:
                x[i], open_at = 0.0, j
            else:
                x[j] = 1.0
        if not 0.0 < x[open_at] < 1.0:
            open_at = -1
    return open_at


def _rounding(seed: int, level: int):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: what stays open is small. Equal rows may change places.
        rows = rows.sort_values(["size", "row_hash", "doc_id"], ascending=[False, True, True], kind="stable")
        first = rows.iloc[0]
        name = 0 if first["source"] is None else 1 + int.from_bytes(hashlib.blake2b(str(first["source"]).encode(), digest_size=16).digest())
        entropy = [seed, level, name, int(first["block"]), int(first["empty"])]
        draws = np.random.Generator(np.random.PCG64(entropy)).random(len(rows) + 1)
        x = rows["fraction"].to_numpy(dtype=np.float64, copy=True)
        left = _settle(x, np.maximum(rows["size"].to_numpy(np.float64), 1.0), draws)
        if left >= 0 and first["blocks"] <= 1:
            x[left] = float(draws[-1] < x[left])
        return rows.assign(fraction=x)

    return settle


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """doc_id, row_hash, source, size, source_size, target, copies: one row per document."""
    items = stash(items_of(docs), "mix-items")
    targets = stash(source_targets(items, weights, share, most), "mix-targets")
    n_sources, largest = targets.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    rates = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    if n_sources <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    empty = F.col("size") == 0
    rows = F.when(empty, F.col("n_docs") - F.col("n_full")).otherwise(F.col("n_full"))
    whole = F.least(F.floor("rate"), F.lit(int(most)))
    joined = (
        items.withColumnRenamed("source", "own")
        .join(rates, F.col("own").eqNullSafe(F.col("source")))
        .withColumn("empty", empty)
        .withColumn("base", whole)
        .withColumn("fraction", F.greatest(F.col("rate") - whole, F.lit(0.0)))
        .withColumn("blocks", F.ceil(rows / F.lit(block_rows)))
        .withColumn("block", F.pmod(F.xxhash64("row_hash", "doc_id", "size"), F.col("blocks")))
        .select([c.strip().split(" ")[0] for c in _ITEM.split(",")])
    )
    level, blocks, settled = 0, -(-int(largest or 0) // block_rows), None
    open_rows = joined
    while True:
        done = stash(
            open_rows.groupBy("source", "empty", "block").applyInPandas(_rounding(seed, level), _ITEM), f"mix-level-{level}"
        )
        is_open = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        closed = done.filter(~is_open)
        settled = closed if settled is None else settled.unionByName(closed)
        if blocks <= 1:
            break
        blocks, level = -(-blocks // FAN_IN), level + 1
        open_rows = (
            done.filter(is_open)
            .withColumn("block", F.floor(F.col("block") / FAN_IN))
            .withColumn("blocks", F.ceil(F.col("blocks") / F.lit(FAN_IN)))
        )
    return settled.select(
        "doc_id", "row_hash", "source", "size", "source_size", "target",
        (F.col("base") + F.col("fraction").cast("long")).alias("copies"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    # Rows that agree in id, text and source share a key and are told apart by their number.
    text = F.xxhash64(column_or_null(docs, "text", "string"))
    key = F.xxhash64(column_or_null(docs, "doc_id", "long"), text, column_or_null(docs, "source", "string"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    number = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    taken = (
        mix(docs, **options)
        .groupBy(F.xxhash64("doc_id", "row_hash", "source").alias("key"))
        .agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    )
    return (
        named.withColumn("number", number)
        .join(taken, "key")
        .select("row", F.element_at("copies", F.col("number")).cast("int").alias("copies"))
        .filter(F.col("copies") > 0)
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("row.*")
    )
