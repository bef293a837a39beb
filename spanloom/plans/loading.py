"""Samples for training and inference straight from records and the videos on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.intervals import DEFAULT_DURATION, DURATION_CAP
from ..operators.samples import (
    MAX_ANNOTATIONS,
    existing_only,
    explode_annotations,
    keep_valid,
    sample_n,
    video_samples,
)


def clip_samples(
    records: DataFrame,
    inventory: DataFrame,
    n: int | None,
    seed: int,
    key: Sequence[str] = ("split", "video_id", "ann_pos"),
) -> DataFrame:
    """``n`` valid (span, sentence) pairs of videos that are on disk; None or -1 for all."""
    return sample_n(keep_valid(explode_annotations(existing_only(records, inventory))), n, seed, key)


def dense_samples(
    records: DataFrame,
    inventory: DataFrame,
    n: int | None,
    seed: int,
    default_duration: float = DEFAULT_DURATION,
    cap: float = DURATION_CAP,
    k: int | None = MAX_ANNOTATIONS,
    clip: bool = True,
    key: Sequence[str] = ("split", "video_id"),
) -> DataFrame:
    """``n`` videos on disk with their annotations; ``clip=False, k=None`` gives the test form."""
    videos = video_samples(existing_only(records, inventory), default_duration, cap, k, clip)
    return sample_n(videos, n, seed, key)
