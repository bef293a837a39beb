from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import frames as frames_module
from spanloom.operators import samples as samples_module
from spanloom.operators.dedup import dedup_activities
from spanloom.operators.frames import clip_frames, clamp_clips, source_slots, video_durations
from spanloom.operators.samples import (
    cap_annotations,
    clip_intervals,
    existing_only,
    explode_annotations,
    group_by_video,
    keep_valid,
    sample_n,
    sample_totals,
    union_splits,
    video_samples,
    with_duration,
)
from spanloom.operators.windows import video_windows
from spanloom.sources import open_frame_index, write_frame_index

RECORD = "video_id string, duration double, timestamps array<array<double>>, sentences array<string>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_stop_at_the_shorter_side(spark):
    df = spark.createDataFrame([("v", None, [[0.0, 1.0], [1.0, 2.0]], ["a", "b", "c"])], RECORD)
    assert [r["sentence"] for r in explode_annotations(df).collect()] == ["a", "b"]


def test_clip_keeps_zero_length_at_the_cut(spark):
    spans = [[100.0, 130.0], [120.0, 130.0], [121.0, 130.0], [5.0, 5.0]]
    df = spark.createDataFrame([("v", 500.0, spans, [" a ", "b", "c", "d"])], RECORD)
    rows = clip_intervals(keep_valid(explode_annotations(with_duration(df)))).collect()
    assert [(r["start"], r["end"], r["sentence"]) for r in rows] == [(100, 120, "a"), (120, 120, "b")]
    nested = video_samples(df).first()
    assert [(a["start"], a["end"], a["sentence"]) for a in nested["annotations"]] == [(100, 120, "a"), (120, 120, "b")]
    assert nested["effective_end"] == 120.0


def test_default_duration(spark):
    df = spark.createDataFrame([("v", None, [[0.0, 1.0]], ["a"])], RECORD)
    assert with_duration(df).first()["duration"] == 120.0


def test_video_samples_is_stable_capped_and_shuffle_free(spark):
    spans = [[2.0, 3.0], [1.0, 9.0], [1.0, 9.0], [1.0, 2.0], [4.0, 4.0]]
    df = spark.createDataFrame(
        [("v", 50.0, spans, ["e", "b", "c", "a", "x"]), ("gone", 50.0, [[3.0, 3.0]], ["y"])], RECORD
    )
    got = video_samples(df, k=3)
    assert [a["sentence"] for a in got.first()["annotations"]] == ["a", "b", "c"]
    assert got.count() == 1
    assert "Exchange" not in plan_of(got)
    test = video_samples(df, k=None, clip=False).first()
    assert [a["sentence"] for a in test["annotations"]] == ["e", "b", "c", "a"]
    assert tuple(sample_totals(got).first()) == (1, 3)


def flat(spark, rows):
    return spark.createDataFrame(rows, "video_id string, ann_pos bigint, start double, end double, sentence string")


def test_cap_and_group(spark):
    df = flat(spark, [("v", i, float(20 - i), 30.0, f"s{i}") for i in range(20)] + [("w", 0, 1.0, 2.0, "only")])
    rows = {r["video_id"]: r["annotations"] for r in group_by_video(df).collect()}
    assert [a["sentence"] for a in rows["v"]] == [f"s{i}" for i in range(19, 7, -1)]
    assert len(rows["w"]) == 1
    assert "WindowGroupLimit" in plan_of(cap_annotations(df))


def test_existing_and_splits(spark):
    df = flat(spark, [("v", 0, 1.0, 2.0, "a"), ("w", 0, 1.0, 2.0, "b")])
    inventory = spark.createDataFrame([("w", "w"), ("v", "Elsewhere")], "video_id string, category string")
    kept = existing_only(df, inventory)
    assert [r["video_id"] for r in kept.collect()] == ["w"]
    both = union_splits({"Train": df, "Test": kept})
    assert sorted((r["split"], r["video_id"]) for r in both.collect()) == [("Test", "w"), ("Train", "v"), ("Train", "w")]


def test_sample_does_not_depend_on_partitions_or_path(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "k")
    def sampled(rows, n=700, seed=99):
        return sorted(r["k"] for r in sample_n(rows, n, seed, ["k"]).collect())

    small = sampled(df)
    assert len(set(small)) == 700
    assert sampled(df.repartition(7)) == small
    assert sampled(df, seed=42) != small
    monkeypatch.setattr(samples_module, "SMALL_SAMPLE", 10)
    for digits in (1, 2):
        # One digit a round: the bin of the cut is counted again until it is small.
        monkeypatch.setattr(samples_module, "SAMPLE_BIN_DIGITS", digits)
        assert sampled(df) == small
    # Rows of one key have one digest: the last bin stays large and its ties are cut there.
    assert len(sampled(spark.range(50).select(F.lit(7).alias("k")), 20)) == 20
    assert sample_n(df, -1, 99, ["k"]).count() == sample_n(df, None, 99, ["k"]).count() == 3000
    assert sample_n(df, 5000, 99, ["k"]).count() == 3000
    assert sample_n(df, 0, 99, ["k"]).count() == 0
    with pytest.raises(ValueError):
        sample_n(df, -2, 99, ["k"])


@pytest.mark.parametrize("duration, n", [(0.5, 1), (120.0, 1), (120.1, 2), (180.0, 2), (181.0, 3), (300.0, 4)])
def test_window_counts(spark, duration, n):
    df = spark.createDataFrame([("v", duration)], "video_id string, duration double")
    rows = video_windows(df).orderBy("window_idx").collect()
    assert len(rows) == n and rows[-1]["window_end"] == duration and rows[-1]["is_last"]


def test_window_spans_and_unknown_duration(spark):
    df = spark.createDataFrame([("v", 181.0), ("w", 0.0), ("x", None)], "video_id string, duration double")
    spans = [(r["video_id"], r["window_start"], r["window_end"], r["mode"]) for r in video_windows(df).collect()]
    slide = "sliding_window"
    assert spans == [
        ("v", 0, 120, slide), ("v", 60, 180, slide), ("v", 120, 181, slide),
        ("w", 0, 120, "single_pass"), ("x", 0, 120, "single_pass"),
    ]
    wide = video_windows(df.filter("video_id = 'v'"), size=10.0, stride=100.0).collect()
    assert [(r["window_start"], r["window_end"]) for r in wide] == [(0, 10), (100, 110)]


# --- de-duplication ----------------------------------------------------------------------------


def activity_rows(spark, videos):
    rows = [(v, p, s, e, d) for v, acts in videos.items() for s, p, e, d in acts]
    return spark.createDataFrame(rows, "video_id string, pos bigint, start double, end double, description string")


def kept_by_video(df):
    out = {}
    for r in df.orderBy("video_id", "kept_no").collect():
        acts = out.setdefault(r["video_id"], [])
        assert r["kept_no"] == len(acts)
        acts.append((r["start"], r["end"], r["description"]))
    return out


HAND = {
    "exact half": (
        [(0, 0, 10, "aa"), (4, 1, 12, "bbbb"), (5, 2, 15, "c"), (20, 3, 30, "z"), (0, 4, 10, "a")],
        [(0, 10, "aa"), (4, 12, "bbbb"), (20, 30, "z")],
    ),
    "replaced span": ([(0, 0, 10, "a"), (1, 1, 11, "longer"), (5, 2, 11, "x")], [(1, 11, "longer")]),
    "inverted": ([(5, 0, 1, "a"), (5, 1, 1, "bb")], [(5, 1, "a"), (5, 1, "bb")]),
}


def test_dedup_by_hand(spark):
    videos = {name: [(float(s), p, float(e), d) for s, p, e, d in acts] for name, (acts, _) in HAND.items()}
    got = kept_by_video(dedup_activities(activity_rows(spark, videos)))
    assert got == {name: [(float(s), float(e), d) for s, e, d in want] for name, (_, want) in HAND.items()}


def random_activities(rng, n, length):
    acts = []
    for pos in range(n):
        start = round(rng.uniform(0, length), 1)
        acts.append((start, pos, round(start + rng.choice([1, 5, 20, 60]) * rng.random(), 1), "d" * rng.randint(1, 30)))
    return acts


@pytest.mark.parametrize("length", [40.0, 600.0])
def test_dedup_of_hot_videos_equals_the_single_scan(spark, length):
    rng = random.Random(int(length))
    videos = {"hot": random_activities(rng, 1500, length), "hot2": random_activities(rng, 300, length)}
    videos |= {f"v{i}": random_activities(rng, 20, 60.0) for i in range(5)}
    copies = [(10.0, 9000 + i, 20.0, "same") for i in range(800)]
    videos["copies"] = copies + [(10.0, 9900, 21.0, "one longer")]
    rows = activity_rows(spark, videos)
    want = kept_by_video(dedup_activities(rows, limit=None))  # one scan per video, checked by hand above and by SQL
    assert kept_by_video(dedup_activities(rows, limit=100, chunk_rows=370)) == want


def test_copies_of_one_activity_settle_in_few_rounds(spark):
    """Chunks full of copies agree after one hand-over, they do not wait for one another."""
    from pathlib import Path

    from spanloom.shared import shared_root

    folder = Path(shared_root(spark)) / "spanloom" / spark.sparkContext.applicationId
    rounds = lambda: len(list(folder.glob("todo-*")))
    acts = [(5.0, i, 25.0, "same words") for i in range(900)] + [(24.0, 901, 60.0, "after")]
    before = rounds()
    got = kept_by_video(dedup_activities(activity_rows(spark, {"v": acts}), limit=100, chunk_rows=100))
    assert got == {"v": [(5.0, 25.0, "same words"), (24.0, 60.0, "after")]}
    assert rounds() - before <= 3


def test_a_difference_that_runs_through_all_chunks(spark):
    """Which activities are kept follows from the first one; the rounds are bounded all the same."""
    from pathlib import Path

    from spanloom.shared import shared_root

    folder = Path(shared_root(spark)) / "spanloom" / spark.sparkContext.applicationId
    count = lambda name: len(list(folder.glob(f"{name}-*")))
    videos = {v: [(float(i), i, float(i + 10), "same") for i in range(n)] for v, n in (("a", 1500), ("b", 700), ("c", 30))}
    videos["a"][3] = (3.0, 3, 13.5, "a longer one")
    rows = activity_rows(spark, videos)
    want = kept_by_video(dedup_activities(rows, limit=None))
    before = count("todo"), count("unsettled")
    assert kept_by_video(dedup_activities(rows, limit=40, chunk_rows=50)) == want
    assert count("todo") - before[0] <= 1 + (2200 // 50).bit_length() and count("unsettled") - before[1] == 1


def test_hot_videos_are_cut_where_nothing_overlaps(spark):
    rng = random.Random(8)
    acts, at = [], 0.0
    for n in range(400):
        at += rng.choice([0.5, 3.0, 12.0])
        acts.append((at, n, at + rng.uniform(-1, 9), "d" * rng.randint(0, 9)))
    acts += [(500.0 + i / 100, 1000 + i, 600.0 + rng.random(), "e" * rng.randint(0, 9)) for i in range(60)]
    rows = activity_rows(spark, {"v": acts, "w": acts[:120], "touching": [(float(i), i, float(i + 1), "t") for i in range(50)]})
    want = kept_by_video(dedup_activities(rows, limit=None))
    for limit, chunk_rows in ((1, 7), (20, 30), (45, 1000)):
        assert kept_by_video(dedup_activities(rows, limit=limit, chunk_rows=chunk_rows)) == want


# --- frames ------------------------------------------------------------------------------------


FRAME_RULE = """
WITH f AS (SELECT unnest($t) AS t, unnest($key) AS is_key, unnest($ref) AS ref),
edge AS (SELECT max(t) AS seek FROM f WHERE is_key AND t <= trunc($ts * 1e6) / 1e6),
seen AS (SELECT t, ref, least(greatest(CAST(trunc((t - $ts) / ($te - $ts + 1e-9) * $n) AS INT), 0), $n - 1) AS slot
         FROM f, edge WHERE t <= $te + 1 AND (seek IS NULL OR t >= seek)),
first_in AS (SELECT slot, arg_min(ref, (t, ref)) AS ref FROM seen GROUP BY slot),
mark AS (SELECT i, (SELECT max(slot) FROM first_in WHERE slot <= i) AS a, (SELECT min(slot) FROM first_in WHERE slot >= i) AS b
         FROM range($n) AS s(i))
SELECT i, ref FROM mark LEFT JOIN first_in
  ON slot = CASE WHEN a = i OR b IS NULL THEN a WHEN a IS NULL OR (b = i + 1 AND a < i - 1) THEN b ELSE a END
ORDER BY i
"""


def frames_by_rule(clip, frames, n):
    """The rule as one relation: a slot shows its first frame; an empty one that of the filled slot before it, or of
    the next one if there is none before or only the next one is a neighbour."""
    import duckdb

    start, end, duration = clip
    length = duration or end
    begin = min(max(start, 0.0), max(length, 0.0))
    t, key, ref = (list(c) for c in zip(*frames)) if frames else ([], [], [])
    given = {"t": t, "key": key, "ref": ref, "ts": begin, "te": max(begin + 0.1, min(end, length)), "n": n}
    if not frames:
        return [None] * n
    return [r[1] for r in duckdb.execute(FRAME_RULE, given).fetchall()]


def frame_table(spark, videos):
    rows = [(v, t, key, ref) for v, frames in videos.items() for t, key, ref in frames]
    return spark.createDataFrame(rows, "video_id string, pts double, is_keyframe boolean, frame_ref string")


CLIP = "clip_id bigint, video_id string, start double, end double, duration double"


def test_slots_by_hand(spark):
    frames = frame_table(spark, {"v": [(8.0, True, "f8"), (10.5, False, "f10"), (13.0, False, "f13"), (21.0, False, "f21")]})
    clips = spark.createDataFrame([(1, "v", 10.0, 20.0, None), (2, "none", 0.0, 5.0, None)], CLIP)
    rows = clip_frames(clips, frames, 4).orderBy("clip_id", "slot").collect()
    assert [r["frame_ref"] for r in rows] == ["f8", "f13", "f13", "f21", None, None, None, None]
    assert [r["is_blank"] for r in rows] == [False] * 4 + [True] * 4


@pytest.mark.parametrize(
    "decoded, shown", [([0, 4], [0, 0, 0, 4, 4, 4]), ([3], [3] * 6), ([1, 3], [1, 1, 1, 3, 3, 3]), ([], [None] * 6)]
)
def test_slot_fill(one, decoded, shown):
    filled = F.array(*[F.lit(i) for i in decoded]).cast("array<int>")
    assert one(source_slots(filled, 6)) == shown


@pytest.mark.parametrize("limit, chunk_rows", [(None, 1), (150, 400)])
def test_frames_against_decoding_in_order(spark, limit, chunk_rows):
    rng = random.Random(4)
    videos = {}
    for name, size in (("a", 400), ("b", 60), ("c", 3), ("no key", 40)):
        times = sorted({round(rng.uniform(0, 60), 2) for _ in range(size)})
        videos[name] = [(t, name != "no key" and rng.random() < 0.1, f"{name}{t}") for t in times]
    clips = []
    for i in range(150):
        start = round(rng.uniform(-1, 62), 1)
        clips.append((i, rng.choice([*videos, "none"]), start, start + rng.choice([0.0, 0.5, 3.0, 40.0]), rng.choice([None, 0.0, 55.0])))
    for n in (1, 4, 7):
        got = {}
        table = clip_frames(spark.createDataFrame(clips, CLIP), frame_table(spark, videos), n, limit, chunk_rows)
        for r in table.orderBy("clip_id", "slot").collect():
            got.setdefault(r["clip_id"], []).append(r["frame_ref"])
        want = {i: frames_by_rule((s, e, d), videos.get(v, []), n) for i, v, s, e, d in clips}
        assert got == want


def test_slot_borders_are_exact(spark):
    """Frames exactly on, and one unit around, the computed borders fall into the slot the formula gives."""
    import math

    rng = random.Random(8)
    videos, clips = {}, []
    for i in range(40):
        start, end, n = rng.uniform(0, 50), 0.0, 5
        end = start + rng.uniform(0.2, 30)
        width = max(start + 0.1, end) - start + 1e-9
        times = {start}
        for k in range(1, n):
            border = start + k * width / n
            times |= {border, math.nextafter(border, 0), math.nextafter(border, 99)}
        videos[f"v{i}"] = [(t, t == start, f"{t!r}") for t in sorted(times)]
        clips.append((i, f"v{i}", start, end, None))
    rows = clip_frames(spark.createDataFrame(clips, CLIP), frame_table(spark, videos), 5).orderBy("clip_id", "slot")
    got = {}
    for r in rows.collect():
        got.setdefault(r["clip_id"], []).append(r["frame_ref"])
    assert got == {i: frames_by_rule((s, e, d), videos[v], 5) for i, v, s, e, d in clips}


def test_clamp_and_durations(spark):
    clips = spark.createDataFrame([(1, "v", 50.0, 60.0, 40.0), (2, "v", -3.0, 5.0, 0.0)], CLIP)
    assert [(r["t_start"], r["t_end"]) for r in clamp_clips(clips).collect()] == [(40.0, 40.1), (0.0, 5.0)]
    videos = spark.createDataFrame([("v",), ("w",)], "video_id string")
    got = video_durations(videos, frame_table(spark, {"v": [(1.0, True, "x"), (7.5, False, "y")]}))
    assert {r["video_id"]: r["duration"] for r in got.collect()} == {"v": 7.5, "w": 0.0}


@pytest.mark.parametrize("limit, chunk_rows", [(None, 10), (2, 3)])
def test_dedup_of_rows_with_nulls(spark, limit, chunk_rows):
    rows = [
        ("v", 0, 0.0, 10.0, None), ("v", 1, 1.0, 10.0, "long"), ("v", 2, 1.0, 10.5, None), ("v", 3, None, 5.0, "x"),
        ("v", 4, 4.0, None, "y"), ("v", 5, 50.0, 60.0, ""), ("v", 6, 50.0, 61.0, None), ("w", 0, 0.0, 1.0, None),
    ]
    df = spark.createDataFrame(rows, "video_id string, pos bigint, start double, end double, description string")
    got = dedup_activities(df, limit=limit, chunk_rows=chunk_rows)
    assert sorted(map(tuple, got.select("video_id", "kept_no", "start", "end").collect())) == [
        ("v", 0, 1.0, 10.0), ("v", 1, 50.0, 60.0), ("w", 0, 0.0, 1.0)
    ]
    # Equal starts follow a struct position field by field.
    nested = df.withColumn("pos", F.struct(F.lit(0).alias("a"), F.col("pos").alias("b")))
    again = dedup_activities(nested, limit=limit, chunk_rows=chunk_rows)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_frames_of_other_videos_stay_out(spark):
    videos = {f"v{i}": [(t / 2, True, f"{i}@{t}") for t in range(200)] for i in range(20)}
    frames = frame_table(spark, videos)
    clips = spark.createDataFrame([(1, "v3", 10.0, 12.0, None)], CLIP)
    needed = frames_module._needed(clamp_clips(clips), frames)
    assert {r["video_id"] for r in needed.select("video_id").distinct().collect()} == {"v3"}
    assert needed.agg(F.max("pts")).first()[0] == 13.0


# --- frame index on disk -----------------------------------------------------------------------


def above(plan, mark):
    """For each node of a plan text that holds ``mark``: the names of the nodes above it, nearest first."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for n, line in enumerate(lines):
        if mark in line:
            names, at = [], depth[n]
            for m in range(n - 1, -1, -1):
                if depth[m] < at:
                    names.append(lines[m].lstrip(" :+-"))
                    at = depth[m]
            yield names


def test_clips_on_a_written_index_leave_the_frames_in_place(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"v{v}", round(rng.uniform(0, 90), 3), rng.random() < 0.2, f"{v}-{i}") for v in range(12) for i in range(80)]
    frames = spark.createDataFrame(rows, "video_id string, pts double, is_keyframe boolean, frame_ref string")
    clips = [(n, f"v{n % 14}", s := rng.uniform(0, 90), s + rng.uniform(0, 20)) for n in range(150)]
    clips = spark.createDataFrame(clips, "clip_id long, video_id string, start double, end double")
    write_frame_index(frames, str(tmp_path / "index"), buckets=8)
    index = open_frame_index(spark, str(tmp_path / "index"))
    again = open_frame_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, again.frames.collect())) == sorted(rows)

    lengths = video_durations(clips, index)
    want = video_durations(clips, frames)
    assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, want.collect()))
    assert "is_keyframe" not in lengths._jdf.queryExecution().executedPlan().toString()

    shown = clip_frames(lengths, index, 4)
    assert sorted(map(str, shown.collect())) == sorted(map(str, clip_frames(want, frames, 4).collect()))
    assert sorted(map(str, clip_frames(lengths, index, 4, limit=100, chunk_rows=90).collect())) == sorted(map(str, shown.collect()))
    # As for tables too large to be sent around.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ancestors = list(above(plan_of(clip_frames(lengths, index, 4)), "Bucketed: true"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ancestors
    for names in ancestors:
        inside = names[: next(n for n, name in enumerate(names) if name.startswith("Window"))]
        assert not [name for name in inside if "Exchange" in name]


def test_chunks_of_many_videos_are_scanned_in_one_stream():
    """Each starts from its own open activities; none needs a call of its own."""
    import pyarrow as pa

    from spanloom.operators.dedup import _scan

    rows = [  # key, role, chunk, out_no, start, end, description
        (1, 0, 1, 0, 0.0, 10.0, "open"),
        (1, 1, 1, None, 1.0, 10.0, "within"),
        (1, 1, 2, None, 1.0, 10.0, "first of its chunk"),
        (2, 1, 1, None, 1.0, 10.0, "other video"),
    ]
    names = ["key", "role", "chunk", "out_no", "start", "end", "description"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    out = [r for b in _scan(0.5, pa.int64(), True)(iter([batch])) for r in b.to_pylist()]
    got = [(r["key"], r["leg"], r["out_no"], r["inherited"], r["description"]) for r in out]
    assert got == [(1, 1, 0, True, "within"), (1, 2, 0, False, "first of its chunk"), (2, 1, 0, False, "other video")]


def test_tasks_follow_the_rows(spark):
    from spanloom.operators.hotkeys import dealt

    df = spark.range(1000)
    assert dealt(df, 1000, "id", task_rows=20).rdd.getNumPartitions() == max(50, spark.sparkContext.defaultParallelism)
    assert dealt(df, 1000, "id", task_rows=1000) is df
