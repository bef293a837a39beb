"""Frame index on disk: frames in buckets by video, in order of time, and the bounds of each video.

All frames of a video stand in one file of ``buckets``, so lookups by video read them where they are
instead of shuffling them; a video's length and number of frames come from its row of bounds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_COLUMNS = ("video_id", "pts", "is_keyframe", "frame_ref")
BUCKETS = 200
# The columns as they are written.
_FRAME_DDL = "video_id STRING, pts DOUBLE, is_keyframe BOOLEAN, frame_ref STRING"


@dataclass(frozen=True)
class FrameIndex:
    """An index that was opened: ``frames``, ``bounds`` (video_id, last_pts, n_frames), number of buckets."""

    frames: DataFrame
    bounds: DataFrame
    buckets: int


def write_frame_index(frames: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write frames (``video_id, pts, is_keyframe, frame_ref``) as an index; frames are shuffled once, here."""
    typed = frames.select(
        F.col("video_id").cast("string").alias("video_id"),
        F.col("pts").cast("double").alias("pts"),
        F.col("is_keyframe").cast("boolean").alias("is_keyframe"),
        F.col("frame_ref").cast("string").alias("frame_ref"),
    )
    spark = frames.sparkSession
    name = _name()
    writer = typed.repartition(buckets, "video_id").write.format("parquet").option("path", f"{path}/frames")
    writer.bucketBy(buckets, "video_id").sortBy("video_id", "pts").saveAsTable(name)
    written = spark.table(name)
    written.groupBy("video_id").agg(F.max("pts").alias("last_pts"), F.count(F.lit(1)).alias("n_frames")).write.parquet(f"{path}/bounds")
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(f"{path}/buckets")
    spark.sql(f"DROP TABLE {name}")  # only the name; the files have a place of their own


def open_frame_index(spark: SparkSession, path: str) -> FrameIndex:
    """The index at a path, also of another session."""
    buckets = spark.read.schema("buckets int").json(f"{path}/buckets").first()[0]
    name = _name()
    spark.sql(
        f"CREATE TABLE {name} ({_FRAME_DDL}) USING parquet CLUSTERED BY (video_id) SORTED BY (video_id, pts) "
        f"INTO {buckets} BUCKETS LOCATION '{path}/frames'"
    )
    return FrameIndex(spark.table(name), spark.read.parquet(f"{path}/bounds"), buckets)


def _name() -> str:
    return f"frame_index_{uuid.uuid4().hex}"
