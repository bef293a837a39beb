"""Fine-tuning rows for clips and for whole videos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import (
    ChatTemplate,
    clip_prompt,
    clip_response,
    dense_prompt,
    dense_response,
    messages,
    render_chat,
    video_metadata,
)
from ..functions.labels import truncate_ids
from ..operators.batching import assign_batches, pad_batch, tokenize, training_rows
from ..operators.frames import frame_refs

CLIP_FRAMES, DENSE_FRAMES = 8, 16
CLIP_MAX_LENGTH, DENSE_MAX_LENGTH = 2048, 4096


def with_frames(rows: DataFrame, frames: DataFrame, n_frames: int, key: str, start: Column, end: Column) -> DataFrame:
    """Add ``frame_refs``, the frames to show for ``start`` to ``end`` of each row's video; ``key`` identifies a row."""
    length = ["duration"] if "duration" in rows.columns else []
    clips = rows.select(F.col(key).alias("clip_id"), "video_id", start.alias("start"), end.alias("end"), *length)
    return rows.join(frame_refs(clips, frames, n_frames).withColumnRenamed("clip_id", key), key)


def clip_frames_of(samples: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Clip samples with their frames."""
    return with_frames(samples, frames, CLIP_FRAMES, key, F.col("start"), F.col("end"))


def video_frames_of(samples: DataFrame, frames: DataFrame, key: str = "video_id") -> DataFrame:
    """Video samples with frames of their first seconds, up to ``effective_end``."""
    return with_frames(samples, frames, DENSE_FRAMES, key, F.lit(0.0), F.col("effective_end"))


def clip_texts(samples: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``start, end, sentence`` rows with planned frame times and the chat text."""
    response = clip_response(F.col("sentence"), F.col("start"), F.col("end"))
    return samples.withColumn(
        "metadata", video_metadata(F.col("start"), F.col("end"), CLIP_FRAMES)
    ).withColumn("text", render_chat(messages(clip_prompt(), response), template))


def video_texts(samples: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``effective_end, annotations`` rows with planned frame times and the chat text."""
    response = dense_response(F.col("annotations"))
    return samples.withColumn(
        "metadata", video_metadata(F.lit(0.0), F.col("effective_end"), DENSE_FRAMES)
    ).withColumn("text", render_chat(messages(dense_prompt(), response), template))


def token_table(
    texts: DataFrame,
    tokenizer_factory,
    marker: Sequence[int],
    pad_id: int,
    max_length: int,
    batch_size: int,
    seed: int,
    key: Sequence[str],
    side: str = "right",
) -> DataFrame:
    """Chat texts as padded, masked training rows with their batch number.

    Rows are numbered before they are tokenized; padding writes the ids, so the tokenizer runs once.
    """
    batched = assign_batches(texts, batch_size, seed, key)
    ids = tokenize(batched, tokenizer_factory).withColumn("input_ids", truncate_ids(F.col("input_ids"), max_length))
    padded = pad_batch(ids, "batch", pad_id, side)
    return training_rows(padded, marker, pad_id, max_length)
