"""Detection of all activities in whole videos, in one pass or in sliding windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binding import each
from ..functions.chat import dense_prompt, messages, render_chat, video_metadata, window_prompt
from ..functions.intervals import DURATION_CAP, effective_end
from ..functions.parse import parse_activities, shift_activities
from ..operators.dedup import THRESHOLD, dedup_activities
from ..operators.frames import frame_refs
from ..operators.generate import DENSE_NEW_TOKENS, CaptionerFactory, generate
from ..operators.windows import WINDOW_SIZE, WINDOW_STRIDE, video_windows
from ..shared import stash

DENSE_FRAMES = 16

_ANNOTATIONS = "array<struct<start: double, end: double, sentence: string>>"


@dataclass(frozen=True)
class Detection:
    activities: DataFrame
    windows: DataFrame


def dense_records(videos: DataFrame, found: Detection, mode: str) -> DataFrame:
    """One record per video: ``video_id, duration, gt, predicted, raw_output, mode``.

    ``gt`` are the video's ``annotations`` where the table has them. ``predicted`` is empty for a
    video without activities. Only a single pass has one ``raw_output``; that of windows is in
    ``found.windows``.
    """
    if mode not in ("single_pass", "sliding_window"):
        raise ValueError("mode is 'single_pass' or 'sliding_window'")
    lines = F.array_sort(F.collect_list(F.struct("kept_no", "start", "end", "description")))
    plain = F.transform(
        "kept",
        lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["description"].alias("description")),
    )
    lists = found.activities.groupBy("video_id").agg(lines.alias("kept")).select("video_id", plain.alias("predicted"))
    nothing = F.array().cast(lists.schema["predicted"].dataType)
    gt = F.col("annotations") if "annotations" in videos.columns else F.lit(None).cast(_ANNOTATIONS)
    out = videos.select("video_id", "duration", gt.alias("gt")).join(lists, "video_id", "left")
    if mode == "single_pass":
        out = out.join(found.windows.select("video_id", "raw_output"), "video_id", "left")
    else:
        out = out.withColumn("raw_output", F.lit(None).cast("string"))
    return out.select(
        "video_id",
        "duration",
        "gt",
        F.coalesce("predicted", nothing).alias("predicted"),
        "raw_output",
        F.lit(mode).alias("mode"),
    )


def run_record(records: DataFrame, n: str = "n_videos", **settings: str | int | float | None) -> DataFrame:
    """One row for a whole run: its settings as given and the number of its records."""
    count = records.agg(F.count(F.lit(1)).alias(n))
    return count.select(*[F.lit(value).alias(name) for name, value in settings.items()], n)


def _captioned(spans: DataFrame, frames: DataFrame, captioner: CaptionerFactory, n_frames: int) -> DataFrame:
    """Spans ``clip_id, video_id, start, end, prompt_text`` with frames and the generated text."""
    refs = frame_refs(spans.select("clip_id", "video_id", "start", "end", "duration"), frames, n_frames)
    ready = (
        spans.join(refs, "clip_id")
        .withColumn("metadata", video_metadata(F.col("start"), F.col("end"), n_frames))
        .withColumn("prompt", render_chat(messages(F.col("prompt_text")), add_generation_prompt=True))
    )
    # Written once: activities and window records must not each run the model.
    return stash(generate(ready, captioner, DENSE_NEW_TOKENS, "raw_output"), "captions")


def detect_single_pass(
    videos: DataFrame, frames: DataFrame, captioner: CaptionerFactory, n_frames: int = DENSE_FRAMES
) -> Detection:
    """One text per video over its first seconds, parsed into activities in text order."""
    spans = videos.select(
        F.col("video_id").alias("clip_id"),
        "video_id",
        "duration",
        F.lit(0.0).alias("start"),
        effective_end(F.col("duration"), DURATION_CAP, nonpositive_to_cap=True).alias("end"),
        dense_prompt().alias("prompt_text"),
    )
    texts = _captioned(spans, frames, captioner, n_frames)
    parsed = each(texts.select("video_id", "raw_output"), parse_activities(F.col("raw_output")), "a", "kept_no")
    activities = parsed.select("video_id", F.col("kept_no").cast("bigint").alias("kept_no"), "a.*")
    return Detection(activities, texts.select("video_id", "duration", "raw_output"))


def union_windows(records: DataFrame) -> DataFrame:
    """Activities of all windows of a video in long form, ``pos`` giving window and line order."""
    return each(records.select("video_id", "window_idx", "activities"), F.col("activities"), "a", "line").select(
        "video_id",
        F.struct(F.col("window_idx").cast("bigint").alias("window_idx"), F.col("line").cast("bigint").alias("line")).alias("pos"),
        "a.start",
        "a.end",
        "a.description",
    )


def window_activities(texts: DataFrame, offset_mode: str = "add") -> DataFrame:
    """Window records: parsed activities of ``raw_output``, moved to video time.

    ``offset_mode="none"`` is for captioners that already answer in video time.
    """
    if offset_mode not in ("add", "none"):
        raise ValueError("offset_mode is 'add' or 'none'")
    parsed = parse_activities(F.col("raw_output"))
    offset = F.col("window_start") if offset_mode == "add" else F.lit(0.0)
    return texts.withColumn("activities", shift_activities(parsed, offset))


def detect_sliding(
    videos: DataFrame,
    frames: DataFrame,
    captioner: CaptionerFactory,
    size: float = WINDOW_SIZE,
    stride: float = WINDOW_STRIDE,
    threshold: float = THRESHOLD,
    offset_mode: str = "add",
    n_frames: int = DENSE_FRAMES,
) -> Detection:
    """All windows of all videos at once; only de-duplication brings a video together.

    A video of unknown duration is described in one pass instead: no de-duplication, no records.
    """
    windows = video_windows(videos.select("video_id", "duration"), size, stride)
    spans = windows.select(
        F.concat_ws("#", "video_id", "window_idx").alias("clip_id"),
        "video_id",
        "duration",
        "window_idx",
        "window_start",
        "window_end",
        "mode",
        F.col("window_start").alias("start"),
        F.col("window_end").alias("end"),
        F.when(F.col("mode") == "single_pass", dense_prompt())
        .otherwise(window_prompt(F.col("window_start")))
        .alias("prompt_text"),
    )
    records = window_activities(_captioned(spans, frames, captioner, n_frames), offset_mode)
    sliding = records.filter(F.col("mode") == "sliding_window")
    single = union_windows(records.filter(F.col("mode") == "single_pass"))
    kept = dedup_activities(union_windows(sliding), "video_id", threshold)
    activities = kept.unionByName(
        single.select("video_id", F.col("pos.line").alias("kept_no"), "start", "end", "description")
    )
    shown = sliding.select("video_id", "window_idx", "window_start", "window_end", "raw_output", "activities")
    return Detection(activities, shown)
