from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import (
    category_of,
    clip_response,
    dense_response,
    extract_description,
    fmt1,
    messages,
    parse_activities,
    parse_span,
    render_chat,
    shift_activities,
    strip_text,
    tiou,
    video_metadata,
    video_path_of,
    window_prompt,
)
from spanloom.functions.intervals import effective_end, valid_interval
from spanloom.functions.parse import ACTIVITY_PATTERN, SPAN_PATTERN, TIMESTAMP_PART_PATTERN


@pytest.mark.parametrize(
    "video_id, category", [("Abuse001_x264", "Abuse"), ("Normal_Videos_003_x264", "Normal_Videos_"), ("plain", "plain")]
)
def test_category(one, video_id, category):
    assert one(category_of(F.col("v")), v=video_id) == category


def test_video_path(one):
    assert one(video_path_of("/data/", F.col("v")), v="Abuse001_x264") == "/data/Abuse/Abuse001_x264.mp4"


@pytest.mark.parametrize(
    "a, b, expected",
    [((0, 10), (5, 15), 1 / 3), ((0, 10), (10, 20), 0.0), ((10, 0), (0, 10), 0.0), ((1, 1), (1, 1), 0.0)],
)
def test_tiou(one, a, b, expected):
    lits = [F.lit(float(x)) for x in (*a, *b)]
    assert one(tiou(*lits)) == pytest.approx(expected, abs=1e-15)


def test_valid_interval_drops_nan(one):
    nan = F.lit(float("nan"))
    assert not one(valid_interval(F.lit(1.0), nan))
    assert not one(valid_interval(nan, F.lit(1.0)))
    assert not one(valid_interval(F.lit(1.0), F.lit(1.0)))
    assert one(valid_interval(F.lit(-1.0), F.lit(1.0)))


def test_effective_end(one):
    assert one(effective_end(F.lit(200.0))) == 120.0
    assert one(effective_end(F.lit(0.0))) == 0.0
    assert one(effective_end(F.lit(0.0), nonpositive_to_cap=True)) == 120.0


def test_fmt1_agrees_with_exact_rounding(spark):
    rng = random.Random(5)
    values = [i / 20 for i in range(4000)] + [rng.uniform(0, 5000) for _ in range(4000)]
    values += [round(rng.uniform(0, 500), 2) for _ in range(4000)] + [0.15, 0.25, 0.35, 0.75, -2.25, -0.04]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for value, text in df.select("v", fmt1(F.col("v"))).collect():
        assert text == f"{value:.1f}"


def test_strip_is_unicode_aware(spark):
    texts = ["　 a b \n", "\x1c\x1fx\x85", "  ", "", " é "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_text(F.col("t"))).collect()
    assert all(got == text.strip() for text, got in rows)


@pytest.mark.parametrize(
    "text, span",
    [
        ("A man walks. Timestamps: [2.6, 12.6]", (2.6, 12.6)),
        ("[ 1 ,2 ] and [3, 4]", (1.0, 2.0)),
        ("no span", None),
        ("[1., 2]", None),
    ],
)
def test_parse_span(one, text, span):
    got = one(parse_span(F.col("t")), t=text)
    assert (None if got is None else tuple(got)) == span


@pytest.mark.parametrize(
    "text, rest",
    [
        ("A man walks. Timestamps: [2.6, 12.6]", "A man walks."),
        ("Timestamps: [1, 2]", "Timestamps: [1, 2]"),
        (" timestamp [1] x Timestamps:[2] ", "x"),
        ("  ", "  "),
    ],
)
def test_extract_description(one, text, rest):
    assert one(extract_description(F.col("t")), t=text) == rest


@pytest.mark.parametrize(
    "text, found",
    [
        ("1. [0.0, 5.3] A.\n2. [7,8.] B", [(0, 5.3, "A."), (7, 8, "B")]),
        ("1. [0, 1]\n2. [3, 4] foo", [(0, 1, "2. [3, 4] foo")]),
        ("1. [.5, 1] x", []),
    ],
)
def test_parse_activities(one, text, found):
    assert [tuple(a) for a in one(parse_activities(F.col("t")), t=text)] == found


def test_patterns_agree_with_python_on_random_texts(spark):
    rng = random.Random(11)
    parts = ["1.", " ", "\n", "[", "]", "0.5", "12", ",", " x", "Timestamps:", "timestamp", " ", "\r", "é", "7. [1, 2] go"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        "t",
        parse_span(F.col("t")).alias("span"),
        extract_description(F.col("t")).alias("rest"),
        parse_activities(F.col("t")).alias("acts"),
    ).collect()
    plain = lambda p: p.replace("(?dU)", "")
    for r in rows:
        m = re.search(plain(SPAN_PATTERN), r["t"])
        assert (None if r["span"] is None else tuple(r["span"])) == (m and (float(m[1]), float(m[2])))
        rest = re.sub(plain(TIMESTAMP_PART_PATTERN), "", r["t"]).strip()
        assert r["rest"] == (rest or r["t"])
        want = [(float(a), float(b), d.strip()) for a, b, d in re.findall(plain(ACTIVITY_PATTERN), r["t"])]
        assert [tuple(a) for a in r["acts"]] == want


def test_shift(one):
    acts = parse_activities(F.lit("1. [1, 2] a"))
    assert tuple(one(shift_activities(acts, F.lit(60.0)))[0]) == (61.0, 62.0, "a")


def test_render_then_parse_round_trip(spark):
    acts = F.array(*[F.struct(F.lit(i * 1.5).alias("start"), F.lit(i + 9.0).alias("end"), F.lit(f"s {i}").alias("sentence")) for i in range(5)])
    text = spark.range(1).select(dense_response(acts).alias("t"))
    assert text.first()[0].startswith("1. [0.0, 9.0] s 0\n2. [1.5, 10.0] s 1\n")
    got = text.select(parse_activities(F.col("t"))).first()[0]
    assert [tuple(a) for a in got] == [(i * 1.5, i + 9.0, f"s {i}") for i in range(5)]


def test_clip_response_and_prompts(one):
    assert one(clip_response(F.lit("Hi."), F.lit(0.25), F.lit(3.0))) == "Hi. Timestamps: [0.2, 3.0]"
    assert "relative to 60s of" in one(window_prompt(F.lit(60.0)))
    assert "relative to 2s of" in one(window_prompt(F.lit(2.5)))


def test_video_metadata(one):
    got = one(video_metadata(F.lit(2.6), F.lit(12.6), 4))
    assert (got["total_num_frames"], got["fps"], got["frames_indices"], got["duration"]) == (12, 1.0, [2, 5, 9, 12], 12.6)
    assert one(video_metadata(F.lit(1.0), F.lit(3.0), 1))["frames_indices"] == [1]


def test_messages_and_chat(one):
    both = messages(F.lit("What?"), F.lit("That."))
    turns = one(both)
    assert [t["role"] for t in turns] == ["user", "assistant"]
    assert [p["type"] for p in turns[0]["content"]] == ["video", "text"]
    assert one(render_chat(both)) == "User: <video>What?\nAssistant: That.\n"
    assert one(render_chat(messages(F.lit("What?")), add_generation_prompt=True)) == "User: <video>What?\nAssistant:"
