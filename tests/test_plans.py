from __future__ import annotations

import random

import pytest

from spanloom.operators.evaluate import attach_scores, score_spans, side_by_side, summarize
from spanloom.operators.generate import generate, generate_models, generate_side_by_side, resolve_model
from spanloom.operators.runlog import append_points, metric_points, metric_points_json
from spanloom.operators.textmetrics import hashed_embedder
from spanloom.plans.detection import dense_records, detect_single_pass, detect_sliding, run_record
from spanloom.plans.evaluation import evaluate
from spanloom.streaming.dedup import dedup_stream
from spanloom.streaming.scoring import append_scores, publish_summary, read_predictions, read_summary

from spanloom.operators.dedup import dedup_activities

from .test_operators import activity_rows, kept_by_video, random_activities

SAMPLE = "sample_id bigint, video_id string, start double, end double, gt string"


def frames_of(spark, videos):
    rows = [(v, t / 2, t % 6 == 0, f"{v}@{t / 2}") for v, seconds in videos.items() for t in range(int(seconds * 2) + 1)]
    return spark.createDataFrame(rows, "video_id string, pts double, is_keyframe boolean, frame_ref string")


def test_scores_and_summary(spark):
    rows = spark.createDataFrame(
        [(1, 0.0, 10.0, "x [5.0, 15.0]"), (2, 0.0, 10.0, "nothing"), (3, 0.0, 10.0, "[0, 10] ok"), (4, 2.0, 4.0, "[4.0, 2.0]")],
        "sample_id bigint, start double, end double, pred string",
    )
    scored = score_spans(rows)
    got = {r["sample_id"]: r["tiou"] for r in scored.collect()}
    assert got == pytest.approx({1: 1 / 3, 2: 0.0, 3: 1.0, 4: 0.0})
    s = summarize(scored).first()
    assert (s["n_samples"], s["timestamp_found"], s["timestamp_rate"]) == (4, 3, 0.75)
    assert s["mean_tiou"] == pytest.approx(1 / 3) and (s["tiou_at_0.3"], s["tiou_at_0.5"]) == (0.5, 0.25)
    assert summarize(scored, by=("sample_id",)).count() == 4


def test_attach_and_side_by_side(spark):
    samples = spark.createDataFrame([(1, "v", 0.0, 1.0, "g"), (2, "v", 1.0, 2.0, "h")], SAMPLE)
    scores = spark.createDataFrame([(1, 0.5)], "sample_id bigint, tiou double")
    assert {r["sample_id"]: r["tiou"] for r in attach_scores(samples, scores).collect()} == {1: 0.5, 2: None}
    say = lambda word: lambda: lambda batch, n: [f" {word} {g}\n" for g in batch["gt"]]
    wide = side_by_side(generate_models(samples, {"finetuned": say("ft")})).orderBy("sample_id").collect()
    assert [(r["zeroshot"], r["finetuned"]) for r in wide] == [(None, "ft g"), (None, "ft h")]


def test_resolve_model():
    assert resolve_model("tuned", "base", ["tuned"]) == ("tuned", True)
    assert resolve_model("tuned", "base", lambda name: False) == ("base", False)
    assert resolve_model(None, "base", lambda name: True) == ("base", False)


def test_generate_strips(spark):
    df = spark.createDataFrame([("a",)], "gt string")
    assert generate(df, lambda: lambda b, n: [f" {n} "]).first()["pred"] == "128"


def test_evaluate(spark):
    samples = spark.createDataFrame([(i, "v", float(i), i + 2.0, f"a man walks number {i}") for i in range(6)], SAMPLE)

    def factory():
        def caption(batch, limit):
            assert all(len(refs) == 4 for refs in batch["frame_refs"])
            assert all(p.endswith("Assistant:") for p in batch["prompt"])
            return [f"{g} Timestamps: [{s:.1f}, {e:.1f}]" for g, s, e in zip(batch["gt"], batch["start"], batch["end"])]

        return caption

    done = evaluate(samples, frames_of(spark, {"v": 20}), factory, hashed_embedder())
    s = done.summary.first()
    assert s["n_samples"] == 6
    for name in ("timestamp_rate", "mean_tiou", "mean_rouge_l", "mean_bleu4", "mean_bertscore_f1"):
        assert s[name] == pytest.approx(1.0, abs=1e-6)
    assert {"gt_start", "gt_text", "pred_start", "bertscore_f1"} <= set(done.rows.columns)


def window_captioner():
    """Each window reports one activity at its start and one in its middle, relative to the window."""

    def caption(batch, limit):
        return [
            "1. [0.0, 30.0] starts\n2. [60.0, 90.0] middle" + " seen" * (int(start) // 60)
            for start in batch["start"]
        ]

    return caption


def test_sliding_detection(spark):
    videos = spark.createDataFrame([("v", 200.0), ("w", 50.0), ("u", 0.0)], "video_id string, duration double")
    found = detect_sliding(videos, frames_of(spark, {"v": 200, "w": 50}), lambda: window_captioner())
    got = kept_by_video(found.activities)
    # The middle of one window is the start of the next; the longer text wins.
    assert got["v"] == [(0, 30, "starts"), (60, 90, "middle"), (120, 150, "middle seen"), (180, 210, "middle seen seen")]
    assert got["w"] == got["u"] == [(0, 30, "starts"), (60, 90, "middle")]
    windows = [(r["video_id"], r["window_start"], r["window_end"]) for r in found.windows.collect()]
    assert sorted(windows) == [("v", 0, 120), ("v", 60, 180), ("v", 120, 200), ("w", 0, 50)]


def test_single_pass(spark):
    videos = spark.createDataFrame([("v", 200.0), ("u", 0.0)], "video_id string, duration double")

    def factory():
        return lambda batch, limit: [f"1. [0, {e}] {limit} {len(set(r))}" for e, r in zip(batch["end"], batch["frame_refs"])]

    got = kept_by_video(detect_single_pass(videos, frames_of(spark, {"v": 200}), factory).activities)
    assert got == {"v": [(0, 120, "512 16")], "u": [(0, 120, "512 1")]}


def test_metric_points(spark, tmp_path):
    logs = spark.createDataFrame(
        [("r", 5, {"loss": "0.5", "note": "1d", "epoch": "2", "lr": "2e-05", "none": None})],
        "run_id string, step bigint, logs map<string, string>",
    )
    points = metric_points(logs)
    assert {r["key"]: r["value"] for r in points.collect()} == {"loss": 0.5, "epoch": 2.0, "lr": 2e-05}
    text = '{"loss": 0.5, "note": "7", "epoch": 2, "lr": 2e-05, "none": null, "best": true, "list": [1]}'
    typed = spark.createDataFrame([("r", 5, text)], "run_id string, step bigint, logs string")
    got = {r["key"]: r["value"] for r in metric_points_json(typed).collect()}
    assert got == {"loss": 0.5, "epoch": 2.0, "lr": 2e-05, "best": 1.0}
    append_points(points, str(tmp_path / "points"))
    append_points(points, str(tmp_path / "points"))
    assert spark.read.parquet(str(tmp_path / "points")).count() == 6


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(120), "the stream did not end"


def test_streamed_scores_equal_batch(spark, tmp_path):
    rows = [("m" if i % 3 else "n", i, float(i), i + 3.0, f"x [{i}.0, {i + i % 4}.5]" if i % 5 else "none") for i in range(40)]
    df = spark.createDataFrame(rows, "model string, sample_id bigint, start double, end double, pred string")
    df.repartition(3).write.json(str(tmp_path / "in"))
    stream = lambda: read_predictions(spark, str(tmp_path / "in"), files_per_trigger=1)
    finish(append_scores(stream(), str(tmp_path / "rows"), str(tmp_path / "c1")))
    finish(publish_summary(stream(), str(tmp_path / "sum"), str(tmp_path / "c2")))
    want = {r["sample_id"]: r["tiou"] for r in score_spans(df).collect()}
    assert {r["sample_id"]: r["tiou"] for r in spark.read.parquet(str(tmp_path / "rows")).collect()} == want
    batch = {r["model"]: r["mean_tiou"] for r in summarize(score_spans(df), by=("model",)).collect()}
    assert {r["model"]: r["mean_tiou"] for r in read_summary(spark, str(tmp_path / "sum")).collect()} == pytest.approx(batch)


def test_streamed_dedup_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    acts = {v: random_activities(rng, 80, 500.0) for v in ("v", "w", "x")}
    rows = []
    for video, items in acts.items():
        last = int(max(a[0] for a in items) // 60)
        for w in range(last + 1):
            inside = sorted((a for a in items if a[0] // 60 == w), key=lambda a: (a[0], a[1]))
            rows.append((video, w, w * 60.0, w == last, [(s, e, d) for s, _, e, d in inside]))
    rng.shuffle(rows)  # windows come in any order, some twice
    rows += rows[:4]
    schema = "video_id string, window_idx bigint, window_start double, is_last boolean, activities array<struct<start: double, end: double, description: string>>"
    for i in range(0, len(rows), 5):
        spark.createDataFrame(rows[i : i + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = dedup_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    finish(out.outputMode("append").option("checkpointLocation", str(tmp_path / "c")))
    got = kept_by_video(spark.read.parquet(str(tmp_path / "out")))
    assert got == kept_by_video(dedup_activities(activity_rows(spark, acts), limit=None))


def test_models_follow_one_another_without_a_shuffle(spark):
    def say(prefix):
        return lambda: lambda batch, max_new_tokens: [f"{prefix} {v} " for v in batch["video_id"]]

    samples = spark.createDataFrame([(1, "v", 0.0, 1.0, "g"), (2, None, None, None, None)], SAMPLE)
    wide = generate_side_by_side(samples, {"zeroshot": say("zs"), "finetuned": say("ft")})
    assert [(r["zeroshot"], r["finetuned"]) for r in wide.orderBy("sample_id").collect()] == [
        ("zs v", "ft v"),
        ("zs None", "ft None"),
    ]
    assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        generate_side_by_side(samples, {"gt": say("x")})


def test_dense_and_run_records(spark):
    factory = lambda: lambda batch, max_new_tokens: [
        "1. [0.0, 2.0] a\n2. [5.0, 9.0] b" if v == "v" else "nothing" for v in batch["video_id"]
    ]
    videos = spark.createDataFrame(
        [("v", 60.0, [(1.0, 2.0, "x")]), ("w", 60.0, None)],
        "video_id string, duration double, annotations array<struct<start: double, end: double, sentence: string>>",
    )
    frames = frames_of(spark, {"v": 60, "w": 60})
    for mode, detect in (("single_pass", detect_single_pass), ("sliding_window", detect_sliding)):
        found = dense_records(videos, detect(videos, frames, factory), mode)
        v, w = found.orderBy("video_id").collect()
        assert [tuple(a) for a in v["predicted"]] == [(0.0, 2.0, "a"), (5.0, 9.0, "b")] and w["predicted"] == []
        assert [tuple(a) for a in v["gt"]] == [(1.0, 2.0, "x")] and w["gt"] is None
        assert (w["raw_output"], w["mode"]) == ("nothing" if mode == "single_pass" else None, mode)
    bare = dense_records(videos.drop("annotations"), detect_single_pass(videos, frames, factory), "single_pass")
    assert bare.filter("gt is not null").count() == 0
    run = run_record(found, run_name="r", finetuned_dir=None, num_frames=16).first()
    assert run.asDict() == {"run_name": "r", "finetuned_dir": None, "num_frames": 16, "n_videos": 2}
    with pytest.raises(ValueError):
        dense_records(videos, None, "other")


def test_a_published_summary_is_the_last_whole_one(spark, tmp_path):
    path = str(tmp_path / "sum")
    for number in (0, 9, 10):
        spark.range(number, number + 2).write.parquet(f"{path}/batch={number}")
    (tmp_path / "sum" / "batch=11" / "_temporary").mkdir(parents=True)
    assert sorted(r["id"] for r in read_summary(spark, path).collect()) == [10, 11]


def test_texts_are_scored_without_what_only_the_captioner_needs(spark):
    df = spark.createDataFrame([(1, "x", ["a"])], "k int, prompt string, refs array<string>")
    got = generate(df, lambda: lambda batch, n: [f"{p} {len(r)}" for p, r in zip(batch["prompt"], batch["refs"])], keep=["k"])
    assert got.columns == ["k", "pred"] and got.first()["pred"] == "x 1"
