"""Frame selection for clips from a frame index.

The index has one row per frame: ``video_id, pts, is_keyframe, frame_ref``. A clip needs one frame
per slot. Instead of joining a clip with every frame in its range, each slot looks up the first
frame at or after its lower border (an as-of join), so the work is clips x slots + frames however
many clips overlap.

Where the index is a ``FrameIndex``, clips are dealt to its buckets and the frames stay in place: only
videos too large for one task are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binding import each, let
from ..shared import stash
from ..sources.frame_index import FRAME_COLUMNS, FrameIndex
from .hotkeys import ROW_LIMIT, chunked, dealt

TAIL_SECONDS = 1.0
MIN_SPAN = 0.1
SPAN_EPSILON = 1e-9

_SLOT_PROBE, _FRAME, _SEEK_PROBE = 0, 1, 2


def clamp_clips(clips: DataFrame) -> DataFrame:
    """Add ``t_start`` and ``t_end``: the clip inside its video, at least 0.1 s long."""
    known = F.nullif(F.col("duration"), F.lit(0.0)) if "duration" in clips.columns else F.lit(None)
    length = F.coalesce(known.cast("double"), F.col("end"))
    t_start = F.greatest(F.lit(0.0), F.least(F.col("start"), length))
    with_start = clips.withColumn("t_start", t_start)
    t_end = F.greatest(F.col("t_start") + F.lit(MIN_SPAN), F.least(F.col("end"), length))
    return with_start.withColumn("t_end", t_end)


def _position(t: Column, t_start: Column, t_end: Column, n: int) -> Column:
    return (t - t_start) / (t_end - t_start + F.lit(SPAN_EPSILON)) * F.lit(float(n))


def slot_of(t: Column, t_start: Column, t_end: Column, n: int) -> Column:
    """Slot of a frame time: cut towards zero, then held inside 0..n-1."""
    return F.greatest(F.lit(0), F.least(_position(t, t_start, t_end, n).cast("bigint"), F.lit(n - 1)))


def _with_border(df: DataFrame, n: int) -> DataFrame:
    """Add ``border``: the smallest double whose slot position reaches ``slot``.

    Rounding moves the computed border by less than 2^-50 of its value. Halving a gap of twice that
    on either side (at most 32 neighbouring doubles) ends at the exact border, so that a lookup by
    time agrees with the slot formula. The steps are plain columns, which compile.
    """
    t_start, t_end, slot = F.col("t_start"), F.col("t_end"), F.col("slot").cast("double")
    about = t_start + slot * (t_end - t_start + F.lit(SPAN_EPSILON)) / F.lit(float(n))
    rest = df.columns
    gap = df.withColumn("about", about).select(
        *rest,
        (F.col("about") - F.col("about") * F.lit(2.0**-49)).alias("low"),
        (F.col("about") + F.col("about") * F.lit(2.0**-49)).alias("border"),
    )
    for _ in range(6):
        gap = gap.withColumn("middle", F.col("low") + (F.col("border") - F.col("low")) / F.lit(2.0))
        gap = gap.withColumn("reached", _position(F.col("middle"), t_start, t_end, n) >= slot)
        gap = gap.select(
            *rest,
            F.when(F.col("reached"), F.col("low")).otherwise(F.col("middle")).alias("low"),
            F.when(F.col("reached"), F.col("middle")).otherwise(F.col("border")).alias("border"),
        )
    return gap.drop("low")


def _probes(clips: DataFrame, n: int) -> DataFrame:
    """Per clip: one look back for the keyframe to start from, one look ahead per slot."""
    slots = clips.select(
        "video_id", "clip_id", "t_start", "t_end", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))).alias("slot")
    )
    is_seek = F.col("slot") == -1
    micros = F.floor(F.col("t_start") * F.lit(1e6)) / F.lit(1e6)
    # Slot 0 looks from the very beginning: without a keyframe the first frame starts.
    t = F.when(is_seek, micros).when(F.col("slot") == 0, F.lit(float("-inf"))).otherwise(F.col("border"))
    side = F.when(is_seek, F.lit(_SEEK_PROBE)).otherwise(F.lit(_SLOT_PROBE))
    return _with_border(slots, n).select(
        "video_id", t.alias("t"), side.alias("side"), "slot", "clip_id", "t_start", "t_end"
    )


def _needed(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of the clips' videos up to the last time that a clip of the video can show.

    One row per video meets the index ahead of its shuffle, so a few clips of a large index move
    few frames. The planner broadcasts that side only where its size allows.
    """
    reach = clips.groupBy("video_id").agg((F.max("t_end") + F.lit(TAIL_SECONDS)).alias("reach"))
    return (
        frames.select(*FRAME_COLUMNS)
        .join(reach, "video_id")
        .filter(F.col("pts") <= F.col("reach"))
        .drop("reach")
    )


def _as_of(clips: DataFrame, frames: DataFrame | FrameIndex, n: int, limit: int | None, chunk_rows: int) -> DataFrame:
    """Each probe with the frame it finds: the last keyframe at or before, or the next frame."""
    stored = frames if isinstance(frames, FrameIndex) else None
    frames = _needed(clips, stored.frames if stored else frames)
    index = frames.select(
        "video_id",
        F.col("pts").alias("t"),
        F.lit(_FRAME).alias("side"),
        F.col("is_keyframe").alias("is_key"),
        F.col("frame_ref"),
    )
    probes = _probes(clips, n)
    if stored:
        probes = probes.repartition(stored.buckets, "video_id")
        own = stored.bounds.select("video_id", F.col("n_frames").alias("w")).join(clips.select("video_id"), "video_id", "left_semi")
    else:
        own = frames.select("video_id", F.lit(1).alias("w"))
    both = probes.unionByName(index, allowMissingColumns=True)
    weights = own.unionByName(clips.select("video_id", F.lit(n + 1).alias("w")))
    counts = stash(weights.groupBy("video_id").agg(F.sum("w").alias("n_rows")), "video-rows")
    order = [F.col("t"), F.col("side"), F.col("clip_id")]
    if not stored:  # an index keeps its buckets
        both = dealt(both, counts.agg(F.sum("n_rows")).first()[0] or 0, "video_id")
    rows, hot = chunked(both, "video_id", order, limit, chunk_rows, counts)
    is_frame = F.col("side") == _FRAME
    # Both lookups are running minima, so they carry over a chunk border as plain minima as well.
    back = F.when(is_frame & F.col("is_key"), F.struct((-F.col("t")).alias("neg"), "frame_ref"))
    ahead = F.when(is_frame, F.struct("t", "frame_ref"))
    key = W.partitionBy("video_id", "chunk")
    upto = key.orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    from_here = key.orderBy(F.desc("t"), F.desc("side")).rowsBetween(W.unboundedPreceding, 0)
    found = (
        rows.withColumn("back", F.min(back).over(upto))
        .withColumn("ahead", F.min(ahead).over(from_here))
        .filter(~is_frame)
    )
    if hot is not None:
        per_chunk = hot.groupBy("video_id", "chunk").agg(F.min(back).alias("b"), F.min(ahead).alias("a"))
        video = W.partitionBy("video_id")
        before = video.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        behind = video.orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)
        carried = per_chunk.select(
            "video_id",
            "chunk",
            F.min("b").over(before).alias("carry_back"),
            F.min("a").over(behind).alias("carry_ahead"),
        )
        found = (
            found.join(carried, ["video_id", "chunk"], "left")
            .withColumn("back", F.coalesce("back", "carry_back"))
            .withColumn("ahead", F.coalesce("ahead", "carry_ahead"))
        )
    hit = F.when(
        F.col("side") == _SEEK_PROBE,
        F.struct((-F.col("back.neg")).alias("pts"), F.col("back.frame_ref").alias("frame_ref")),
    ).otherwise(F.struct(F.col("ahead.t").alias("pts"), F.col("ahead.frame_ref").alias("frame_ref")))
    return found.select("clip_id", "t_start", "t_end", F.struct("slot", hit.alias("hit")).alias("look"))


def source_slots(filled: Column, n: int) -> Column:
    """For every slot the slot whose frame it shows, given the ascending list of decoded slots.

    A gap at the front takes the first decoded slot. Any other gap takes the decoded slot before
    it, but the slot right before a decoded one takes that one unless its other neighbour is
    decoded as well.
    """

    def source(i: Column) -> Column:
        before = F.array_max(F.filter(filled, lambda j: j <= i))
        return let(
            before,
            lambda b: F.when(b == i, i)
            .when(b.isNull(), F.get(filled, F.lit(0)))
            .when((b != i - 1) & F.array_contains(filled, i + 1), i + 1)
            .otherwise(b),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), source)


def shown_frames(
    clips: DataFrame,
    frames: DataFrame | FrameIndex,
    n_frames: int,
    limit: int | None = ROW_LIMIT,
    chunk_rows: int = ROW_LIMIT,
) -> DataFrame:
    """``clip_id, shown``: the frame to show in each of ``n_frames`` slots as one array.

    Clips carry ``clip_id, video_id, start, end`` and optionally ``duration``. Decoding starts at
    the last keyframe at or before the start (or at the first frame) and ends 1 s after the end.
    A clip without any frame gets blank slots.
    """
    n = n_frames
    looks = _as_of(clamp_clips(clips), frames, n, limit, chunk_rows)
    # Every clip has exactly n + 1 lookups.
    per_clip = looks.groupBy("clip_id").agg(
        F.first("t_start").alias("t_start"),
        F.first("t_end").alias("t_end"),
        F.array_sort(F.collect_list("look")).alias("looks"),
    )
    t_start, t_end = F.col("t_start"), F.col("t_end")
    every = F.sequence(F.lit(0), F.lit(n - 1))

    def decoded(found: Column) -> Column:
        seek = F.get(found, F.lit(0))["hit"]

        def slot(i: Column) -> Column:
            ahead = F.get(found, i + 1)["hit"]
            on_time = (ahead["pts"] <= t_end + F.lit(TAIL_SECONDS)) & (
                slot_of(ahead["pts"], t_start, t_end, n) == i
            )
            return F.when((i == 0) & seek["pts"].isNotNull(), seek).when(on_time, ahead)

        return F.transform(every, slot)

    def shown(slots: Column) -> Column:
        filled = F.filter(every, lambda i: F.get(slots, i)["pts"].isNotNull())
        return let(filled, lambda f: F.transform(source_slots(f, n), lambda k: F.get(slots, k)))

    return per_clip.select("clip_id", let(let(F.col("looks"), decoded), shown).alias("shown"))


def clip_frames(
    clips: DataFrame,
    frames: DataFrame | FrameIndex,
    n_frames: int,
    limit: int | None = ROW_LIMIT,
    chunk_rows: int = ROW_LIMIT,
) -> DataFrame:
    """``shown_frames`` as ``n_frames`` rows per clip."""
    return (
        each(shown_frames(clips, frames, n_frames, limit, chunk_rows), F.col("shown"), "frame", "slot")
        .select(
            "clip_id",
            "slot",
            F.col("frame.pts").alias("pts"),
            F.col("frame.frame_ref").alias("frame_ref"),
            F.col("frame.pts").isNull().alias("is_blank"),
        )
    )


def frame_refs(clips: DataFrame, frames: DataFrame | FrameIndex, n_frames: int) -> DataFrame:
    """``clip_id`` with the references of its ``n_frames`` slots in one array."""
    refs = F.transform("shown", lambda s: s["frame_ref"])
    return shown_frames(clips, frames, n_frames).select("clip_id", refs.alias("frame_refs"))


def video_durations(videos: DataFrame, frames: DataFrame | FrameIndex) -> DataFrame:
    """Duration of every video by its last frame; 0 where the index has none."""
    if isinstance(frames, FrameIndex):
        last = frames.bounds.select("video_id", F.col("last_pts").alias("duration"))
    else:
        last = frames.groupBy("video_id").agg(F.max("pts").alias("duration"))
    return videos.join(last, "video_id", "left").withColumn("duration", F.coalesce("duration", F.lit(0.0)))
