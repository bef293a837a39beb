"""Frame selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators.frames import clamp_clips, clip_frames, video_durations
from spanloom.operators.samples import sample_n
from spanloom.shared import new_folder
from spanloom.sources import open_frame_index, write_frame_index

from .registry import query
from .views import ctes, frames, table, valid_annotations, video_name


def _clips(spark, sf):
    clips = valid_annotations(spark, sf).select(F.col("ann_pos").alias("clip_id"), "video_id", "start", "end")
    return video_durations(clips, frames(spark, sf))


_CLIPS_SQL = ctes("ann", "valid", "fr") + """
, dur AS (SELECT video_id, max(pts) AS duration FROM fr GROUP BY 1)
, span AS (SELECT ann_pos AS clip_id, v.video_id, start, "end", duration FROM valid v LEFT JOIN dur d ON v.video_id = d.video_id)
"""
CLAMP_SQL = """
, c0 AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(start, coalesce(nullif(duration, 0), "end"))) AS t_start FROM span)
, cl AS (SELECT *, greatest(t_start + CAST(0.1 AS DOUBLE), least("end", coalesce(nullif(duration, 0), "end"))) AS t_end FROM c0)
"""


@query("clamp_clips", _CLIPS_SQL + CLAMP_SQL + "SELECT clip_id, duration, t_start, t_end FROM cl")
def q_clamp(spark, sf):
    return clamp_clips(_clips(spark, sf)).select("clip_id", "duration", "t_start", "t_end")


def decoded_sql(n: int) -> str:
    """Frames decoded per clip of ``span`` and slot, found by joining each clip with its whole range."""
    return CLAMP_SQL + f"""
, seek AS (SELECT clip_id, max(pts) AS seek_pts FROM cl JOIN fr ON cl.video_id = fr.video_id AND is_keyframe
             AND pts <= floor(t_start * CAST(1e6 AS DOUBLE)) / CAST(1e6 AS DOUBLE) GROUP BY 1)
, hit AS (SELECT cl.clip_id, fr.pts, fr.frame_ref,
            greatest(0, least({n - 1}, CAST(trunc((pts - t_start) / (t_end - t_start + CAST(1e-9 AS DOUBLE)) * CAST({n} AS DOUBLE)) AS BIGINT))) AS slot
          FROM cl LEFT JOIN seek USING (clip_id) JOIN fr ON fr.video_id = cl.video_id AND pts <= t_end + 1 AND pts >= coalesce(seek_pts, -1))
, filled AS (SELECT clip_id, slot, min(pts) AS pts, arg_min(frame_ref, pts) AS frame_ref FROM hit GROUP BY ALL)
"""


def _frames_sql(n: int, clips: str = _CLIPS_SQL) -> str:
    return clips + decoded_sql(n) + f"""
, grid AS (SELECT clip_id, unnest(range({n})) AS i FROM cl)
, near AS (SELECT g.clip_id, g.i, max(f.slot) FILTER (f.slot <= g.i) AS p, min(f.slot) FILTER (f.slot >= g.i) AS q
           FROM grid g LEFT JOIN filled f ON f.clip_id = g.clip_id GROUP BY ALL)
, src AS (SELECT clip_id, i, CASE WHEN p = i THEN i WHEN p IS NULL THEN q WHEN q = i + 1 AND p <> i - 1 THEN q ELSE p END AS s FROM near)
SELECT src.clip_id, CAST(i AS BIGINT) AS slot, pts, frame_ref, pts IS NULL AS is_blank
FROM src LEFT JOIN filled f ON f.clip_id = src.clip_id AND f.slot = src.s"""


def _index(spark, sf):
    path = new_folder(spark, "frame-index")
    write_frame_index(frames(spark, sf), path, buckets=16)
    return open_frame_index(spark, path)


@query("clip_frames_by_index", _frames_sql(4))
def q_clip_frames_by_index(spark, sf):
    """Lengths from the bounds of a written index, frames from its buckets."""
    index = _index(spark, sf)
    clips = valid_annotations(spark, sf).select(F.col("ann_pos").alias("clip_id"), "video_id", "start", "end")
    return clip_frames(video_durations(clips, index), index, 4).withColumn("slot", F.col("slot").cast("bigint"))


@query("clip_frames", _frames_sql(4))
def q_clip_frames(spark, sf):
    shown = clip_frames(_clips(spark, sf), frames(spark, sf), 4)
    return shown.withColumn("slot", F.col("slot").cast("bigint"))


@query("dense_clip_frames", _frames_sql(16))
def q_dense_frames(spark, sf):
    shown = clip_frames(_clips(spark, sf), frames(spark, sf), 16)
    return shown.withColumn("slot", F.col("slot").cast("bigint"))


_SAMPLED_SQL = _CLIPS_SQL.replace("FROM valid v LEFT", """FROM (SELECT * FROM valid
  ORDER BY md5('42|' || CAST(ann_pos AS VARCHAR)), ann_pos LIMIT 50) v LEFT""")


@query("sampled_clip_frames", _frames_sql(8, _SAMPLED_SQL))
def q_sampled_frames(spark, sf):
    shown = clip_frames(sample_n(_clips(spark, sf), 50, 42, ["clip_id"]), frames(spark, sf), 8)
    return shown.withColumn("slot", F.col("slot").cast("bigint"))


@query(
    "video_durations",
    ctes("ann", "fr")
    + """
, v AS (SELECT ['Lobby','Yard','Gate','Dock','Hall'][CAST(c_custkey % 5 AS INTEGER) + 1] || CAST(c_custkey AS VARCHAR) || '_x264' AS video_id FROM customer)
SELECT v.video_id, coalesce(max(pts), CAST(0 AS DOUBLE)) AS duration FROM v LEFT JOIN fr ON fr.video_id = v.video_id GROUP BY v.video_id""",
)
def q_durations(spark, sf):
    videos = table(spark, sf, "customer").select(video_name(F.col("c_custkey")).alias("video_id"))
    return video_durations(videos, frames(spark, sf))
