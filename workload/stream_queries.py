"""Streaming forms, run to the end of their input; the SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators.runlog import stream_points
from spanloom.shared import new_folder
from spanloom.streaming.dedup import dedup_stream
from spanloom.streaming.scoring import append_scores, publish_summary, read_predictions, read_summary

from .evaluation_queries import _POINTS_SQL, _SUMMARY, _shown, run_logs
from .registry import query
from .sample_queries import DEDUP_SQL
from .views import ctes, predictions, valid_annotations


def _landed_predictions(spark, sf):
    path = new_folder(spark, "landed")
    rows = predictions(spark, sf).select(F.col("event_type").alias("model"), "sample_id", "start", "end", "pred")
    rows.repartition(4).write.json(path)
    return read_predictions(spark, path, files_per_trigger=2)


def _finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_scores",
    ctes("ann", "valid", "pred", "scored")
    + "\nSELECT event_type AS model, sample_id, pred_start, pred_end, round(tiou, 6) AS tiou FROM scored",
)
def q_stream_scores(spark, sf):
    out = new_folder(spark, "scores")
    _finish(append_scores(_landed_predictions(spark, sf), out, new_folder(spark, "progress")))
    return spark.read.parquet(out).select("model", "sample_id", "pred_start", "pred_end", F.round("tiou", 6).alias("tiou"))


@query(
    "stream_summary",
    ctes("ann", "valid", "pred", "scored") + f"\nSELECT event_type AS model, {_SUMMARY} FROM scored GROUP BY event_type",
)
def q_stream_summary(spark, sf):
    out = new_folder(spark, "summary")
    _finish(publish_summary(_landed_predictions(spark, sf), out, new_folder(spark, "progress")))
    return _shown(read_summary(spark, out), "model")


def window_feed(spark, sf):
    """All one-minute windows of every video, empty ones too, with the activities starting in them."""
    rows = valid_annotations(spark, sf).withColumn("window_idx", F.floor(F.col("start") / 60).cast("bigint"))
    last = rows.groupBy("video_id").agg(F.max("window_idx").alias("last"))
    every = last.select("video_id", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("window_idx"))
    item = F.struct("start", "ann_pos", "end", F.col("sentence").alias("description"))
    # What starts in one minute of one video.
    held = rows.groupBy("video_id", "window_idx").agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = every.join(held, ["video_id", "window_idx"], "left")
    plain = F.transform("items", lambda a: F.struct(a["start"], a["end"], a["description"]))
    empty = F.array().cast("array<struct<start: double, end: double, description: string>>")
    return joined.select(
        "video_id",
        "window_idx",
        (F.col("window_idx").cast("double") * 60.0).alias("window_start"),
        (F.col("window_idx") == F.col("last")).alias("is_last"),
        F.coalesce(plain, empty).cast(
            "array<struct<start: double, end: double, description: string>>"
        ).alias("activities"),
    )


@query("stream_dedup", DEDUP_SQL)
def q_stream_dedup(spark, sf):
    feed, out = new_folder(spark, "windows"), new_folder(spark, "kept")
    windows = window_feed(spark, sf)
    windows.repartition(6, F.xxhash64("video_id", "window_idx")).write.parquet(feed)
    stream = spark.readStream.schema(windows.schema).option("maxFilesPerTrigger", 3).parquet(feed)
    _finish(
        dedup_stream(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", new_folder(spark, "progress"))
    )
    return spark.read.parquet(out)


@query("stream_metric_points", _POINTS_SQL)
def q_stream_metric_points(spark, sf):
    """A log of which every file is delivered twice."""
    feed, out = new_folder(spark, "logs"), new_folder(spark, "points")
    logs = run_logs(spark, sf)
    for _ in range(2):
        logs.repartition(4, "step").write.mode("append").parquet(feed)
    stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 3).parquet(feed)
    _finish(stream_points(stream, out, new_folder(spark, "progress"), "at", "1000 days"))
    return spark.read.parquet(out).drop("at")
