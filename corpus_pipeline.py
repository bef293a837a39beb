"""From raw documents to packed training sequences: filter, de-duplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
one's documents. All stages but the last return the columns of ``documents``.

Odd rows: a null text counts as an empty one, which is never toxic, is a copy of all other empty ones, has no
words to remove, has size 0 in the mix and packs as its end id alone. Rows that repeat id and text
leave one row at the near-copies stage. A null source is a source. Texts of any length are read whole, further
columns are carried along whatever their names, and no documents give no pieces.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import mixing, near_copies, packing, substring, toxicity
from spanloom.llm.tokens import vocabulary_path
from spanloom.shared import stash
from spanloom.shipping import ship

_PACKAGE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "spanloom")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic by models learnt from the labelled ones among them."""
    ship(spark, _PACKAGE)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship(spark, _PACKAGE)
    return near_copies.one_per_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that earlier ones have, too."""
    ship(spark, _PACKAGE)
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ship(spark, _PACKAGE)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in training sequences."""
    ship(spark, _PACKAGE)
    return packing.pack(docs, vocabulary_path(packing.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Models, random rounding and byte-pair merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
