"""Tokens, labels, batches and whole training tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from spanloom.functions.chat import CLIP_PROMPT, DENSE_PROMPT, messages, render_chat
from spanloom.operators.batching import assign_batches, hashed_tokenizer, pad_batch, tokenize, training_rows
from spanloom.operators.frames import video_durations
from spanloom.operators.samples import video_samples, with_duration
from spanloom.plans.training import DENSE_MAX_LENGTH, clip_frames_of, clip_texts, token_table, video_frames_of, video_texts

from .frame_queries import _CLIPS_SQL, _clips, _frames_sql
from .registry import query
from .sample_queries import VIDEO_SAMPLE_SQL
from .views import chat_pairs, complete_records, ctes, frames, valid_annotations

VOCABULARY, RESERVED = 32_000, 16
PAD_ID = 0


def word_id(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % VOCABULARY + RESERVED


MARKER = [word_id("Assistant:")]


def _chat_ids(spark, sf):
    pairs = chat_pairs(spark, sf)
    text = render_chat(messages(F.col("prompt"), F.col("response")))
    return tokenize(pairs.select("conv_id", "turn", text.alias("text")), hashed_tokenizer(VOCABULARY, RESERVED))


_TOKENS_SQL = ctes("chat") + rf"""
, texts AS (SELECT conv_id, turn, 'User: <video>' || prompt || chr(10) || 'Assistant: ' || response || chr(10) AS text FROM chat)
, ids AS (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '[ \t\r\n\f\x0b]+'), lambda w: w <> ''),
     lambda w: CAST('0x' || md5(w)[1:8] AS BIGINT) % {VOCABULARY} + {RESERVED}) AS ids FROM texts)
"""
_TRAIN_SQL = _TOKENS_SQL + f"""
, cut AS (SELECT conv_id, turn, ids[1:2048] AS ids FROM ids)
, mark AS (SELECT *, list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] = {MARKER[0]})) AS last_mark FROM cut)
, lab AS (SELECT *, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN last_mark IS NULL OR i <= last_mark + 1 THEN -100 ELSE ids[i] END) AS labels FROM mark)
"""


@query(
    "tokenize",
    _TOKENS_SQL + "SELECT conv_id, turn, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ',') AS ids FROM ids",
)
def q_tokenize(spark, sf):
    return _chat_ids(spark, sf).select(
        "conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_ids"), F.array_join("input_ids", ",").alias("ids")
    )


@query(
    "mask_labels",
    _TRAIN_SQL
    + """SELECT conv_id, turn, array_to_string(ids, ',') AS ids, array_to_string(labels, ',') AS labels,
len(list_filter(labels, lambda l: l <> -100)) = 0 AS is_masked_out FROM lab""",
)
def q_mask(spark, sf):
    return training_rows(_chat_ids(spark, sf), MARKER, PAD_ID, 2048).select(
        "conv_id",
        "turn",
        F.array_join("input_ids", ",").alias("ids"),
        F.array_join("labels", ",").alias("labels"),
        "is_masked_out",
    )


@query(
    "assign_batches",
    ctes("ann", "valid")
    + """
, n AS (SELECT ann_pos, video_id, row_number() OVER (ORDER BY md5('42|' || CAST(ann_pos AS VARCHAR))) - 1 AS row_no FROM valid)
SELECT ann_pos, video_id, CAST(row_no AS BIGINT) AS row_no, CAST(row_no // 8 AS BIGINT) AS batch FROM n""",
)
def q_batches(spark, sf):
    rows = valid_annotations(spark, sf).select("ann_pos", "video_id")
    return assign_batches(rows, 8, 42, ["ann_pos"]).select("ann_pos", "video_id", "row_no", "batch")


@query(
    "pad_batch",
    _TOKENS_SQL
    + """
, w AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS width FROM ids)
SELECT conv_id, turn, array_to_string(list_concat(ids, list_transform(range(width - len(ids)), lambda i: CAST(0 AS BIGINT))), ',') AS ids,
  array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(width - len(ids)), lambda i: 0)), ',') AS mask FROM w""",
)
def q_pad(spark, sf):
    return pad_batch(_chat_ids(spark, sf), "conv_id", PAD_ID).select(
        "conv_id", "turn", F.array_join("input_ids", ",").alias("ids"), F.array_join("attention_mask", ",").alias("mask")
    )


def _table_sql(key: str, max_length: int, batch: int) -> str:
    """Padded ids and labels of ``texts`` (``key``, text) in seeded batches."""
    return rf"""
, ids AS (SELECT {key}, list_transform(list_filter(regexp_split_to_array(text, '[ \t\r\n\f\x0b]+'), lambda w: w <> ''),
     lambda w: CAST('0x' || md5(w)[1:8] AS BIGINT) % {VOCABULARY} + {RESERVED})[1:{max_length}] AS ids,
     row_number() OVER (ORDER BY md5('42|' || CAST({key} AS VARCHAR))) - 1 AS row_no FROM texts)
, wide AS (SELECT *, row_no // {batch} AS batch, max(len(ids)) OVER (PARTITION BY row_no // {batch}) AS width FROM ids)
, padded AS (SELECT {key}, row_no, batch, list_concat(ids, list_transform(range(width - len(ids)), lambda i: CAST(0 AS BIGINT))) AS ids FROM wide)
, mark AS (SELECT *, list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] = {MARKER[0]})) AS last_mark FROM padded)
, lab AS (SELECT *, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN last_mark IS NULL OR i <= last_mark + 1 OR ids[i] = 0 THEN -100 ELSE ids[i] END) AS labels FROM mark)
"""


_CLIP_TABLE_SQL = (
    ctes("ann", "valid")
    + f"""
, texts AS (SELECT ann_pos, 'User: <video>{CLIP_PROMPT}' || chr(10) || 'Assistant: ' || sentence || ' Timestamps: [' || printf('%.1f', start)
    || ', ' || printf('%.1f', "end") || ']' || chr(10) AS text FROM valid)"""
    + _table_sql("ann_pos", 2048, 4)
    + """
, meta AS (SELECT ann_pos, array_to_string(list_transform(range(8), lambda i: CAST(trunc(start + CAST(i AS DOUBLE) * ("end" - start) / CAST(7 AS DOUBLE)) AS BIGINT)), ',') AS frames FROM valid)
SELECT ann_pos, CAST(row_no AS BIGINT) AS row_no, CAST(batch AS BIGINT) AS batch, frames, array_to_string(ids, ',') AS ids, array_to_string(labels, ',') AS labels
FROM lab JOIN meta USING (ann_pos)"""
)


@query("clip_training_table", _CLIP_TABLE_SQL)
def q_clip_training(spark, sf):
    samples = valid_annotations(spark, sf).select("video_id", "ann_pos", "start", "end", "sentence")
    rows = token_table(
        clip_texts(samples), hashed_tokenizer(VOCABULARY, RESERVED), MARKER, PAD_ID, 2048, 4, 42, ["ann_pos"]
    )
    return rows.select(
        "ann_pos",
        "row_no",
        "batch",
        F.array_join("metadata.frames_indices", ",").alias("frames"),
        F.array_join("input_ids", ",").alias("ids"),
        F.array_join("labels", ",").alias("labels"),
    )


@query(
    "clip_training_frames",
    f"""
SELECT clip_id AS ann_pos, CAST(row_no AS BIGINT) AS row_no, CAST(row_no // 4 AS BIGINT) AS batch, refs FROM (
  SELECT clip_id, string_agg(coalesce(frame_ref, '-'), ',' ORDER BY slot) AS refs FROM ({_frames_sql(8, _CLIPS_SQL)}) GROUP BY clip_id)
JOIN (SELECT clip_id, row_number() OVER (ORDER BY md5('42|' || CAST(clip_id AS VARCHAR))) - 1 AS row_no FROM ({_CLIPS_SQL} SELECT clip_id FROM span)) USING (clip_id)""",
)
def q_clip_training_frames(spark, sf):
    spans = _clips(spark, sf).withColumnRenamed("clip_id", "ann_pos")
    said = valid_annotations(spark, sf).select("ann_pos", "sentence")
    samples = clip_frames_of(spans.join(said, "ann_pos"), frames(spark, sf), "ann_pos")
    rows = token_table(
        clip_texts(samples), hashed_tokenizer(VOCABULARY, RESERVED), MARKER, PAD_ID, 2048, 4, 42, ["ann_pos"]
    )
    return rows.select("ann_pos", "row_no", "batch", F.array_join("frame_refs", ",", "-").alias("refs"))


_VIDEO_TABLE_SQL = (
    VIDEO_SAMPLE_SQL
    + f"""
, texts AS (SELECT video_id, 'User: <video>{DENSE_PROMPT}' || chr(10) || 'Assistant: '
    || string_agg(rn || '. [' || printf('%.1f', start) || ', ' || printf('%.1f', e) || '] ' || s, chr(10) ORDER BY rn) || chr(10) AS text FROM kept GROUP BY video_id)"""
    + _table_sql("video_id", DENSE_MAX_LENGTH, 8)
    + """
SELECT video_id, CAST(row_no AS BIGINT) AS row_no, CAST(batch AS BIGINT) AS batch, array_to_string(ids, ',') AS ids, array_to_string(labels, ',') AS labels,
  len(list_filter(labels, lambda l: l <> -100)) = 0 AS is_masked_out FROM lab"""
)


@query("video_training_table", _VIDEO_TABLE_SQL)
def q_video_training(spark, sf):
    samples = video_samples(complete_records(spark, sf))
    rows = token_table(
        video_texts(samples),
        hashed_tokenizer(VOCABULARY, RESERVED),
        MARKER,
        PAD_ID,
        DENSE_MAX_LENGTH,
        8,
        42,
        ["video_id"],
    )
    return rows.select(
        "video_id",
        "row_no",
        "batch",
        F.array_join("input_ids", ",").alias("ids"),
        F.array_join("labels", ",").alias("labels"),
        "is_masked_out",
    )


_VIDEO_SPANS_SQL = ctes("ann", "valid", "fr") + """
, dur AS (SELECT video_id, max(pts) AS duration FROM fr GROUP BY 1)
, span AS (SELECT video_id AS clip_id, video_id, CAST(0 AS DOUBLE) AS start, least(duration, CAST(120 AS DOUBLE)) AS "end", duration
  FROM (SELECT DISTINCT video_id FROM valid) JOIN dur USING (video_id))
"""


@query(
    "video_training_frames",
    f"SELECT clip_id AS video_id, string_agg(coalesce(frame_ref, '-'), ',' ORDER BY slot) AS refs FROM ({_frames_sql(16, _VIDEO_SPANS_SQL)}) GROUP BY clip_id",
)
def q_video_training_frames(spark, sf):
    """Frames of the first two minutes of every annotated video."""
    index = frames(spark, sf)
    videos = video_durations(valid_annotations(spark, sf).select("video_id").distinct(), index)
    samples = video_frames_of(with_duration(videos), index)
    return samples.select("video_id", F.array_join("frame_refs", ",", "-").alias("refs"))
