"""Batch text generation behind a replaceable captioner."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import once_per_worker

# A captioner gets a batch of rows and returns one text per row.
Captioner = Callable[[pd.DataFrame, int], list[str]]
CaptionerFactory = Callable[[], Captioner]

CLIP_NEW_TOKENS = 128
DENSE_NEW_TOKENS = 512


def generate(
    df: DataFrame,
    captioner_factory: CaptionerFactory,
    max_new_tokens: int = CLIP_NEW_TOKENS,
    out: str = "pred",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add one generated text per row, stripped. The model is loaded once per worker.

    The captioner gets whole rows; ``keep`` names the columns that are returned, if not all.
    """
    load = once_per_worker(captioner_factory)
    kept = list(df.columns if keep is None else keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caption = load()
        for batch in batches:
            yield batch[kept].assign(**{out: [t.strip() for t in caption(batch, max_new_tokens)]})

    return df.mapInPandas(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.StringType())]))


def generate_models(
    df: DataFrame, factories: dict[str, CaptionerFactory], max_new_tokens: int = CLIP_NEW_TOKENS
) -> DataFrame:
    """Long (row, model, text): each model runs over all rows, in as many tasks as there are input splits."""
    parts = [
        generate(df, factory, max_new_tokens, "text").withColumn("model", F.lit(name))
        for name, factory in factories.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def generate_side_by_side(
    df: DataFrame, factories: dict[str, CaptionerFactory], max_new_tokens: int = CLIP_NEW_TOKENS
) -> DataFrame:
    """One row per clip with a text column per model: the models follow one another on the row, without a shuffle."""
    taken = set(factories) & set(df.columns)
    if taken:
        raise ValueError(f"columns with the names of models: {sorted(taken)}")
    for name, factory in factories.items():
        df = generate(df, factory, max_new_tokens, name)
    return df


def resolve_model(tuned: str | None, base: str, available: Sequence[str] | Callable[[str], bool]) -> tuple[str, bool]:
    """The tuned model if it is there, else the base model; and whether it is the tuned one."""
    there = available(tuned) if callable(available) and tuned else bool(tuned) and tuned in available
    return (tuned, True) if there else (base, False)
