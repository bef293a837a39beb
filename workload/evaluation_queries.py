"""Scores, roll-ups, generation and detection with a stand-in captioner."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spanloom.functions.chat import dense_response
from spanloom.operators.evaluate import score_spans, side_by_side, summarize
from spanloom.operators.generate import generate, generate_models, generate_side_by_side, resolve_model
from spanloom.operators.runlog import append_new_points, metric_points
from spanloom.operators.samples import group_by_video
from spanloom.operators.textmetrics import bleu4, hashed_embedder, rouge_l
from spanloom.plans.detection import (
    dense_records,
    detect_single_pass,
    detect_sliding,
    run_record,
    union_windows,
    window_activities,
)
from spanloom.plans.evaluation import evaluate
from spanloom.shared import new_folder
from spanloom.sources import write_results

from .frame_queries import decoded_sql
from .registry import query
from .sample_queries import fold_sql
from .text_queries import _LCS_SQL, _bleu_sql
from .views import SQL, annotations, ctes, frames, predictions, table, valid_annotations


@query(
    "score_spans",
    ctes("ann", "valid", "pred", "scored") + "\nSELECT sample_id, pred_start, pred_end, pred_text, tiou FROM scored",
)
def q_score_spans(spark, sf):
    return score_spans(predictions(spark, sf)).select("sample_id", "pred_start", "pred_end", "pred_text", "tiou")


_SUMMARY = """
  CAST(count(*) AS BIGINT) AS n_samples, CAST(count(pred_start) AS BIGINT) AS timestamp_found,
  round(count(pred_start) / CAST(count(*) AS DOUBLE), 6) AS timestamp_rate, round(avg(tiou), 6) AS mean_tiou,
  round(avg(CASE WHEN tiou >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS recall_30,
  round(avg(CASE WHEN tiou >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS recall_50,
  round(avg(CASE WHEN tiou >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS recall_70"""


def _shown(summary, *keys):
    texts = [m for m in ("mean_rouge_l", "mean_bleu4", "mean_bertscore_f1") if m in summary.columns]
    return summary.select(
        *keys,
        "n_samples",
        "timestamp_found",
        F.round("timestamp_rate", 6).alias("timestamp_rate"),
        F.round("mean_tiou", 6).alias("mean_tiou"),
        *[F.round(f"`tiou_at_0.{t}`", 6).alias(f"recall_{t}0") for t in (3, 5, 7)],
        *[F.round(m, 6).alias(m) for m in texts],
    )


_METRICS_SQL = (
    ctes("ann", "valid", "pred", "scored")
    + _LCS_SQL
    + ", pairs AS (SELECT sample_id, pred_text AS pred, gt AS ref FROM scored)"
    + _bleu_sql("pairs", "sample_id")
    + ", metrics AS (SELECT s.*, rouge_l, bleu4 FROM scored s JOIN rouge USING (sample_id) JOIN bleu ON bleu.id = s.sample_id)"
)


@query(
    "evaluation_summary",
    _METRICS_SQL
    + f"\nSELECT {_SUMMARY}, round(avg(rouge_l), 6) AS mean_rouge_l, round(avg(bleu4), 6) AS mean_bleu4 FROM metrics",
)
def q_summary(spark, sf):
    rows = score_spans(predictions(spark, sf))
    return _shown(summarize(bleu4(rouge_l(rows, "pred_text", "gt"), "pred_text", "gt")))


@query(
    "evaluation_by_video",
    ctes("ann", "valid", "pred", "scored") + f"\nSELECT video_id, {_SUMMARY} FROM scored GROUP BY video_id",
)
def q_summary_by_video(spark, sf):
    return _shown(summarize(score_spans(predictions(spark, sf)), by=("video_id",)), "video_id")


@query(
    "write_results",
    ctes("ann", "valid", "pred", "scored")
    + "\nSELECT sample_id, pred, pred_start IS NULL AS no_span, round(tiou, 6) AS tiou FROM scored",
)
def q_write_results(spark, sf):
    rows = score_spans(predictions(spark, sf)).select("sample_id", "pred", "pred_start", "tiou")
    path = new_folder(spark, "results")
    write_results(rows, summarize(rows), path)
    back = spark.read.schema(rows.schema).json(f"{path}/rows")
    return back.select(
        "sample_id", "pred", F.col("pred_start").isNull().alias("no_span"), F.round("tiou", 6).alias("tiou")
    )


def _echo(prefix):
    """Stand-in captioner: repeats the caption it finds in the row."""

    def factory():
        def caption(batch, max_new_tokens):
            return [f"{prefix}{text} " for text in batch["gt"]]

        return caption

    return factory


_CLIPS = ("sample_id", "video_id", "start", "end", "gt")


@query(
    "generate",
    ctes("ann", "valid", "pred") + "\nSELECT sample_id, 'I see ' || gt AS pred FROM pred",
)
def q_generate(spark, sf):
    return generate(predictions(spark, sf).select("sample_id", "gt"), _echo("I see ")).select("sample_id", "pred")


_SIDE_BY_SIDE_SQL = ctes("ann", "valid", "pred") + """
SELECT sample_id, video_id, start, "end", gt, gt AS zeroshot, 'Seen: ' || gt AS finetuned FROM pred"""


@query("side_by_side", _SIDE_BY_SIDE_SQL)
def q_side_by_side(spark, sf):
    clips = predictions(spark, sf).select(*_CLIPS)
    return generate_side_by_side(clips, {"zeroshot": _echo(""), "finetuned": _echo("Seen: ")})


@query("side_by_side_long", _SIDE_BY_SIDE_SQL)
def q_side_by_side_long(spark, sf):
    clips = predictions(spark, sf).select(*_CLIPS)
    return side_by_side(generate_models(clips, {"zeroshot": _echo(""), "finetuned": _echo("Seen: ")}))


@query(
    "base_model_fallback",
    ctes("ann", "valid", "pred") + "\nSELECT sample_id, 'base' AS model, 'base: ' || gt AS pred FROM pred",
)
def q_fallback(spark, sf):
    model, _ = resolve_model("tuned", "base", ["base"])
    clips = predictions(spark, sf).select("sample_id", "gt")
    return generate(clips, _echo(f"{model}: ")).select("sample_id", F.lit(model).alias("model"), "pred")


def _span_echo():
    def caption(batch, max_new_tokens):
        return [
            f"{gt} Timestamps: [{start:.1f}, {end:.1f}]"
            for gt, start, end in zip(batch["gt"], batch["start"], batch["end"])
        ]

    return caption


@query(
    "evaluate_clips",
    ctes("ann", "valid")
    + """
, r AS (SELECT start, "end", CAST(printf('%.1f', start) AS DOUBLE) AS s, CAST(printf('%.1f', "end") AS DOUBLE) AS e FROM valid)
, i AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(e, "end") - greatest(s, start)) AS x FROM r)
, t AS (SELECT CASE WHEN (e - s) + ("end" - start) - x > 0 THEN x / ((e - s) + ("end" - start) - x) ELSE CAST(0 AS DOUBLE) END AS tiou FROM i)
SELECT CAST(count(*) AS BIGINT) AS n_samples, round(avg(tiou), 6) AS mean_tiou, CAST(1 AS DOUBLE) AS mean_rouge_l, CAST(1 AS DOUBLE) AS mean_bertscore_f1 FROM t""",
)
def q_evaluate(spark, sf):
    samples = predictions(spark, sf).select(*_CLIPS)
    done = evaluate(samples, frames(spark, sf), lambda: _span_echo(), hashed_embedder())
    return done.summary.select(
        "n_samples", *[F.round(m, 6).alias(m) for m in ("mean_tiou", "mean_rouge_l", "mean_bertscore_f1")]
    )


def _careless():
    """Stand-in captioner that drops words, adds some, shifts spans and leaves them out."""

    def caption(batch, max_new_tokens):
        texts = []
        for n, gt, start, end in zip(batch["sample_id"], batch["gt"], batch["start"], batch["end"]):
            if n % 3 == 0:
                texts.append(f"{gt.split(' ', 1)[1]} Timestamps: [{start + 1.0:.1f}, {end:.1f}]")
            elif n % 3 == 1:
                texts.append(f"a {gt}")
            else:
                texts.append(f"{gt} Timestamps: [{start * 0.75:.1f}, {end + 2.0:.1f}]")
        return texts

    return caption


def _word_axes():
    """Stand-in embedder: every word is an axis of its own, so that only equal words match."""

    def embed(texts):
        axes = np.eye(256, dtype="float32")
        words = ["a", '{"k":', "view", "signup", "click", "error", "purchase"]
        return [np.asarray([axes[words.index(w) if w in words else len(words) + int(w.strip("}"))] for w in t.split()]) for t in texts]

    return embed


_CARELESS_SQL = (
    "WITH "
    + ",\n".join(
        (
            SQL["ann"],
            SQL["valid"],
            """pred AS (
  SELECT ann_pos AS sample_id, video_id, event_type, start, "end", sentence AS gt,
         CASE ann_pos % 3 WHEN 0 THEN sentence[length(event_type) + 2:] || ' Timestamps: [' || printf('%.1f', start + 1) || ', ' || printf('%.1f', "end") || ']'
           WHEN 1 THEN 'a ' || sentence
           ELSE sentence || ' Timestamps: [' || printf('%.1f', start * CAST(0.75 AS DOUBLE)) || ', ' || printf('%.1f', "end" + 2) || ']' END AS pred
  FROM valid)""",
            SQL["scored"],
        )
    )
    + _LCS_SQL
    + ", texts AS (SELECT sample_id, pred_text AS pred, gt AS ref FROM scored)"
    + _bleu_sql("texts", "sample_id")
    + """
, own AS (SELECT sample_id, string_split(pred_text, ' ') AS p, string_split(gt, ' ') AS r FROM scored)
, share AS (SELECT sample_id, len(list_filter(p, lambda w: list_contains(r, w))) / CAST(len(p) AS DOUBLE) AS x,
    len(list_filter(r, lambda w: list_contains(p, w))) / CAST(len(r) AS DOUBLE) AS y FROM own)
, matched AS (SELECT sample_id, CASE WHEN x + y > 0 THEN 2 * x * y / (x + y) ELSE 0 END AS f1 FROM share)
, metrics AS (SELECT scored.*, rouge_l, bleu4, f1 FROM scored JOIN rouge USING (sample_id) JOIN bleu ON bleu.id = sample_id JOIN matched USING (sample_id))
"""
    + f"SELECT {_SUMMARY}, round(avg(rouge_l), 6) AS mean_rouge_l, round(avg(bleu4), 6) AS mean_bleu4, round(avg(f1), 6) AS mean_bertscore_f1 FROM metrics"
)


@query("evaluate_careless_clips", _CARELESS_SQL)
def q_evaluate_careless(spark, sf):
    """All ten numbers of an evaluation whose captions and spans are partly wrong."""
    samples = predictions(spark, sf).select(*_CLIPS)
    done = evaluate(samples, frames(spark, sf), _careless, _word_axes)
    return _shown(done.summary)


def _lister():
    """Stand-in for dense captions: reports the frames it was shown, as two activities per text."""

    def caption(batch, max_new_tokens):
        texts = []
        for refs, start, end in zip(batch["frame_refs"], batch["start"], batch["end"]):
            shown = sorted({r for r in refs if r is not None})
            half = (end - start) / 2
            texts.append(f"1. [0.0, {half:.1f}] saw {len(shown)} frames\n2. [{half:.1f}, {end - start:.1f}] end {end:.1f}")
        return texts

    return caption


def _customer_videos(spark, sf):
    from spanloom.operators.frames import video_durations

    from .views import video_name

    videos = table(spark, sf, "customer").select(video_name(F.col("c_custkey")).alias("video_id"))
    return video_durations(videos, frames(spark, sf))


_VIDEOS_SQL = ctes("ann", "valid", "fr") + """
, dur AS (SELECT video_id, max(pts) AS duration FROM fr GROUP BY 1)
, vid AS (SELECT v.video_id, coalesce(d.duration, CAST(0 AS DOUBLE)) AS duration FROM (
    SELECT ['Lobby','Yard','Gate','Dock','Hall'][CAST(c_custkey % 5 AS INTEGER) + 1] || CAST(c_custkey AS VARCHAR) || '_x264' AS video_id FROM customer) v
  LEFT JOIN dur d ON v.video_id = d.video_id)
"""
# What the stand-in says about each span, as activities relative to the span.
_SAID_SQL = """
, seen AS (SELECT span.*, coalesce(n, 0) AS n FROM span LEFT JOIN (SELECT clip_id, count(DISTINCT frame_ref) AS n FROM filled GROUP BY 1) f USING (clip_id))
, said AS (SELECT *, 0 AS line, CAST(0 AS DOUBLE) AS s, CAST(printf('%.1f', ("end" - start) / 2) AS DOUBLE) AS e, 'saw ' || n || ' frames' AS description FROM seen
  UNION ALL SELECT *, 1, CAST(printf('%.1f', ("end" - start) / 2) AS DOUBLE), CAST(printf('%.1f', "end" - start) AS DOUBLE), 'end ' || printf('%.1f', "end") FROM seen)
"""
_WINDOWS_SQL = _VIDEOS_SQL + """
, win AS (SELECT *, unnest(range(0, CASE WHEN duration <= 120 THEN 1 ELSE CAST(ceil((duration - 120) / CAST(60 AS DOUBLE)) AS BIGINT) + 1 END)) AS window_idx FROM vid)
, span AS (SELECT video_id || '#' || window_idx AS clip_id, video_id, duration, window_idx, CAST(window_idx * 60 AS DOUBLE) AS start,
    CASE WHEN duration > 0 THEN least(CAST(window_idx * 60 + 120 AS DOUBLE), duration) ELSE CAST(120 AS DOUBLE) END AS "end" FROM win)
"""


_SINGLE_SQL = (
    _VIDEOS_SQL
    + """
, span AS (SELECT video_id AS clip_id, video_id, duration, CAST(0 AS DOUBLE) AS start,
    CASE WHEN duration > 0 THEN least(duration, CAST(120 AS DOUBLE)) ELSE CAST(120 AS DOUBLE) END AS "end" FROM vid)
"""
    + decoded_sql(16)
    + _SAID_SQL
)


@query(
    "detect_single_pass",
    _SINGLE_SQL
    + """SELECT video_id, CAST(line AS BIGINT) AS kept_no, s AS start, e AS "end", description FROM said""",
)
def q_single_pass(spark, sf):
    return detect_single_pass(_customer_videos(spark, sf), frames(spark, sf), lambda: _lister()).activities


_SLIDING_SQL = (
    _WINDOWS_SQL
    + decoded_sql(16)
    + _SAID_SQL
    + """, moved AS (SELECT video_id, window_idx * 2 + line AS pos, s + start AS start, e + start AS "end", description FROM said WHERE duration > 0)"""
    + fold_sql("moved", "pos", "description")
)


@query(
    "detect_sliding",
    _SLIDING_SQL
    + """SELECT * FROM kept
UNION ALL SELECT video_id, CAST(line AS BIGINT), s, e, description FROM said WHERE duration = 0""",
)
def q_sliding(spark, sf):
    return detect_sliding(_customer_videos(spark, sf), frames(spark, sf), lambda: _lister()).activities


@query(
    "window_records",
    _WINDOWS_SQL
    + decoded_sql(16)
    + _SAID_SQL
    + """
SELECT video_id, CAST(window_idx AS BIGINT) AS window_idx, start AS window_start, "end" AS window_end,
  '1. [0.0, ' || printf('%.1f', ("end" - start) / 2) || '] saw ' || n || ' frames' || chr(10) || '2. [' || printf('%.1f', ("end" - start) / 2)
    || ', ' || printf('%.1f', "end" - start) || '] end ' || printf('%.1f', "end") AS raw_output, CAST(2 AS BIGINT) AS n_activities
FROM seen WHERE duration > 0""",
)
def q_window_records(spark, sf):
    shown = detect_sliding(_customer_videos(spark, sf), frames(spark, sf), lambda: _lister()).windows
    return shown.select(
        "video_id",
        "window_idx",
        "window_start",
        "window_end",
        "raw_output",
        F.size("activities").cast("bigint").alias("n_activities"),
    )


def _records_sql(activities: str, raw_output: str, mode: str) -> str:
    """One row per video with a digest of what the nested record holds."""
    return f"""
, act AS ({activities})
, found AS (SELECT video_id, count(*) AS n, string_agg(description, ' / ' ORDER BY kept_no) AS told, sum("end") AS ends FROM act GROUP BY 1)
, truth AS (SELECT video_id, count(*) AS n, sum("end") AS ends FROM valid GROUP BY 1)
SELECT vid.video_id, duration, CAST(coalesce(t.n, 0) AS BIGINT) AS n_gt, round(coalesce(t.ends, 0), 4) AS gt_ends,
  CAST(coalesce(f.n, 0) AS BIGINT) AS n_predicted, coalesce(told, '') AS told, round(coalesce(f.ends, 0), 4) AS predicted_ends,
  {raw_output} AS raw_output, '{mode}' AS mode
FROM vid LEFT JOIN found f ON f.video_id = vid.video_id LEFT JOIN truth t ON t.video_id = vid.video_id"""


def _records(spark, sf, detect, mode):
    truth = group_by_video(valid_annotations(spark, sf), k=None)
    videos = _customer_videos(spark, sf).join(truth, "video_id", "left")
    nested = dense_records(videos, detect(videos, frames(spark, sf), lambda: _lister()), mode)
    ends = lambda c: F.round(F.aggregate(F.coalesce(F.col(c), F.expr("array()").cast(nested.schema[c].dataType)), F.lit(0.0), lambda t, a: t + a["end"]), 4)
    return nested.select(
        "video_id",
        "duration",
        F.when(F.col("gt").isNull(), 0).otherwise(F.size("gt")).cast("bigint").alias("n_gt"),
        ends("gt").alias("gt_ends"),
        F.size("predicted").cast("bigint").alias("n_predicted"),
        F.array_join("predicted.description", " / ").alias("told"),
        ends("predicted").alias("predicted_ends"),
        "raw_output",
        "mode",
    )


@query(
    "dense_records_single_pass",
    _SINGLE_SQL
    + _records_sql(
        """SELECT video_id, line AS kept_no, s AS start, e AS "end", description FROM said""",
        """(SELECT '1. [0.0, ' || printf('%.1f', ("end" - start) / 2) || '] saw ' || n || ' frames' || chr(10) || '2. [' || printf('%.1f', ("end" - start) / 2)
    || ', ' || printf('%.1f', "end" - start) || '] end ' || printf('%.1f', "end") FROM seen WHERE seen.video_id = vid.video_id)""",
        "single_pass",
    ),
)
def q_records_single(spark, sf):
    return _records(spark, sf, detect_single_pass, "single_pass")


@query(
    "dense_records_sliding",
    _SLIDING_SQL
    + _records_sql(
        """SELECT video_id, kept_no, start, "end", description FROM kept
UNION ALL SELECT video_id, CAST(line AS BIGINT), s, e, description FROM said WHERE duration = 0""",
        "CAST(NULL AS VARCHAR)",
        "sliding_window",
    ),
)
def q_records_sliding(spark, sf):
    return _records(spark, sf, detect_sliding, "sliding_window")


@query(
    "run_record",
    "SELECT 'first' AS run_name, 'tuned' AS finetuned_dir, 'single_pass' AS mode, CAST(16 AS BIGINT) AS num_frames, CAST(count(*) AS BIGINT) AS n_videos FROM customer",
)
def q_run_record(spark, sf):
    record = run_record(
        _customer_videos(spark, sf), run_name="first", finetuned_dir="tuned", mode="single_pass", num_frames=16
    )
    return record.withColumn("num_frames", F.col("num_frames").cast("bigint"))


def window_texts(spark, sf):
    """Texts of one-minute windows, each holding the valid annotations that start in it."""
    rows = valid_annotations(spark, sf).withColumn("window_idx", F.floor(F.col("start") / 60).cast("bigint"))
    rows = rows.withColumn("window_start", F.col("window_idx").cast("double") * 60.0)
    local = rows.select(
        F.concat_ws("#", "video_id", F.col("window_idx").cast("string")).alias("video_id"),
        "window_start",
        "ann_pos",
        (F.col("start") - F.col("window_start")).alias("start"),
        (F.col("end") - F.col("window_start")).alias("end"),
        "sentence",
    )
    texts = group_by_video(local, k=None)
    part = F.split("video_id", "#")
    idx = part[1].cast("bigint")
    return texts.select(
        part[0].alias("video_id"),
        idx.alias("window_idx"),
        (idx.cast("double") * 60.0).alias("window_start"),
        dense_response(F.col("annotations")).alias("raw_output"),
    )


@query(
    "union_windows",
    ctes("ann", "valid")
    + """
, w AS (SELECT *, CAST(floor(start / 60) AS BIGINT) AS window_idx FROM valid)
, k AS (SELECT *, row_number() OVER (PARTITION BY video_id, window_idx ORDER BY start - window_idx * 60, "end" - window_idx * 60, ann_pos) AS rn FROM w)
SELECT video_id, window_idx, rn - 1 AS line,
  round(CAST(printf('%.1f', start - window_idx * 60) AS DOUBLE) + window_idx * 60, 6) AS start,
  round(CAST(printf('%.1f', "end" - window_idx * 60) AS DOUBLE) + window_idx * 60, 6) AS "end", sentence AS description
FROM k""",
)
def q_union_windows(spark, sf):
    rows = union_windows(window_activities(window_texts(spark, sf)))
    return rows.select(
        "video_id", "pos.*", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "description"
    )


_POINTS_SQL = r"""
SELECT user_id AS run_id, event_id AS step, 'value' AS key, value FROM events
UNION ALL SELECT user_id, event_id, 'k', CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) FROM events"""


def run_logs(spark, sf):
    """Events as training logs: numbers and a word."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        F.create_map(
            F.lit("value"),
            F.col("value").cast("string"),
            F.lit("kind"),
            F.col("event_type"),
            F.lit("k"),
            F.regexp_extract("props", r"(\d+)", 1),
        ).alias("logs"),
        F.col("ts").cast("timestamp").alias("at"),
    )


@query("metric_points", _POINTS_SQL)
def q_metric_points(spark, sf):
    return metric_points(run_logs(spark, sf))


@query("append_new_points", _POINTS_SQL)
def q_append_new_points(spark, sf):
    """Half of the log, then all of it."""
    path = new_folder(spark, "points")
    points = metric_points(run_logs(spark, sf))
    append_new_points(points.filter("step % 2 = 0"), path)
    append_new_points(points, path)
    return spark.read.parquet(path)
