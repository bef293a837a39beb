from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.functions import mask_labels, truncate_ids
from spanloom.operators.batching import assign_batches, hashed_tokenizer, pad_batch, tokenize, training_rows
from spanloom.plans.training import clip_texts, token_table, video_texts


def masked(one, ids, marker, pad):
    return one(mask_labels(F.array(*[F.lit(i) for i in ids]).cast("array<int>"), marker, pad))


@pytest.mark.parametrize(
    "ids, labels",
    [
        ([5, 7, 8, 1, 2, 7, 8, 3, 4, 0, 6], [-100] * 8 + [4, -100, 6]),
        ([1, 2], [-100, -100]),
        ([1], [-100]),
        ([], []),
        ([1, 7, 8], [-100] * 3),
        ([7, 8, 9], [-100] * 3),
        ([7, 8, 9, 4], [-100] * 3 + [4]),
    ],
)
def test_mask(one, ids, labels):
    assert masked(one, ids, [7, 8], 0) == labels


def test_mask_needs_a_marker(spark):
    with pytest.raises(ValueError):
        mask_labels(F.col("x"), [], 0)


def test_truncation_can_cut_off_the_marker(spark):
    df = spark.createDataFrame([([1, 2, 3, 7, 8, 5, 6],), ([7, 8, 1, 2],)], "input_ids array<int>")
    rows = training_rows(df, [7, 8], 0, 4).collect()
    assert [r["is_masked_out"] for r in rows] == [True, False]
    assert rows[1]["labels"] == [-100, -100, -100, 2]
    assert df.select(truncate_ids(F.col("input_ids"), 2)).first()[0] == [1, 2]


def test_tokenizer_plug_in(spark):
    df = spark.createDataFrame([("a b  a",), (None,), ("",)], "text string")
    rows = [r["input_ids"] for r in tokenize(df, hashed_tokenizer()).collect()]
    assert len(rows[0]) == 3 and rows[0][0] == rows[0][2] != rows[0][1]
    assert rows[1:] == [[], []]


def test_batches_are_full_and_seeded(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    rows = assign_batches(df.repartition(5), 8, 42, ["k"], bin_digits=1).collect()
    assert sorted(r["row_no"] for r in rows) == list(range(1003))
    sizes = {}
    for r in rows:
        sizes[r["batch"]] = sizes.get(r["batch"], 0) + 1
        assert r["batch"] == r["row_no"] // 8
    assert sorted(sizes.values()) == [3] + [8] * 125
    again = {r["k"]: r["row_no"] for r in assign_batches(df, 8, 42, ["k"]).collect()}
    assert again == {r["k"]: r["row_no"] for r in rows}


@pytest.mark.parametrize("side, first", [("right", [1, 2, 0]), ("left", [0, 1, 2])])
def test_padding(spark, side, first):
    df = spark.createDataFrame([(0, [1, 2]), (0, [3, 4, 5]), (1, [6])], "batch int, input_ids array<int>")
    rows = sorted(pad_batch(df, "batch", 0, side).collect(), key=lambda r: sorted(r["input_ids"]))
    ids = {tuple(r["input_ids"]): r["attention_mask"] for r in rows}
    assert ids[tuple(first)] == ([1, 1, 0] if side == "right" else [0, 1, 1])
    assert ids[(6,)] == [1] and ids[(3, 4, 5)] == [1, 1, 1]


def test_token_tables(spark):
    factory = hashed_tokenizer()
    marker = factory()(["Assistant:"])[0]
    clips = spark.createDataFrame([(i, float(i), i + 4.5, f"sentence {i}") for i in range(10)], "k int, start double, end double, sentence string")
    rows = token_table(clip_texts(clips), factory, marker, 0, 2048, 4, 42, ["k"]).collect()
    for r in rows:
        assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"])
        trained = [v for v in r["labels"] if v != -100]
        # "Assistant:", then one token is skipped: the rest of "sentence k Timestamps: [s, e]".
        assert trained == factory()([f"{r['k']} Timestamps: [{r['start']:.1f}, {r['end']:.1f}]"])[0]
        assert len(r["metadata"]["frames_indices"]) == 8
    videos = spark.createDataFrame([("v", 60.0)], "video_id string, effective_end double").withColumn(
        "annotations", F.array(F.struct(F.lit(1.0).alias("start"), F.lit(2.0).alias("end"), F.lit("x").alias("sentence")))
    )
    text = video_texts(videos).first()
    assert text["text"].endswith("Assistant: 1. [1.0, 2.0] x\n") and len(text["metadata"]["frames_indices"]) == 16


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def factory():
        import os

        with open(loads, "a") as log:
            log.write(f"{os.getpid()}\n")
        return lambda texts: [[len(t)] for t in texts]

    df = spark.range(64).select(F.col("id").cast("string").alias("text")).repartition(32)
    assert tokenize(df, factory).count() == 64
    workers = open(loads).read().split()
    assert len(workers) == len(set(workers)) < 32


def test_video_rows_carry_the_frames_of_their_first_seconds(spark):
    from spanloom.plans.training import DENSE_FRAMES, video_frames_of

    videos = spark.createDataFrame([("v", 8.0), ("none", 8.0)], "video_id string, effective_end double")
    # Sixteen slots of half a second, a frame in the middle of each: border frames belong to the slot before.
    index = [("v", t / 2 + 0.25, True, str(t)) for t in range(61)]
    frames = spark.createDataFrame(index, "video_id string, pts double, is_keyframe boolean, frame_ref string")
    got = {r["video_id"]: r["frame_refs"] for r in video_frames_of(videos, frames).collect()}
    assert got == {"v": [str(t) for t in range(DENSE_FRAMES)], "none": [None] * DENSE_FRAMES}
