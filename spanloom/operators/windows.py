"""Sliding windows over the length of a video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import DURATION_CAP

WINDOW_SIZE = 120.0
WINDOW_STRIDE = 60.0


def video_windows(videos: DataFrame, size: float = WINDOW_SIZE, stride: float = WINDOW_STRIDE) -> DataFrame:
    """Windows at 0, stride, 2 stride, ..., each ``size`` long and cut at the duration.

    The window that reaches the end of the video is the last. A video of unknown (not positive)
    duration gets one window up to the duration cap, with ``mode`` ``single_pass``.
    """
    length = F.coalesce(F.col("duration"), F.lit(0.0))
    reach = F.when(length <= size, F.lit(0)).otherwise(F.ceil((length - F.lit(size)) / F.lit(stride)))
    # With a stride beyond the size, windows must still start inside the video.
    inside = F.greatest(F.ceil(length / F.lit(stride)) - 1, F.lit(0))
    last = F.when(length > 0, F.least(reach, inside)).otherwise(F.lit(0)).cast("bigint")
    at = F.col("window_idx").cast("double") * F.lit(stride)
    return (
        videos.withColumn("window_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("window_start", F.when(length > 0, at).otherwise(F.lit(0.0)))
        .withColumn(
            "window_end", F.when(length > 0, F.least(at + F.lit(size), length)).otherwise(F.lit(DURATION_CAP))
        )
        .withColumn("is_last", F.col("window_idx") == last)
        .withColumn("mode", F.when(length > 0, F.lit("sliding_window")).otherwise(F.lit("single_pass")))
    )
