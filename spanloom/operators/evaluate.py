"""Scoring of generated clips and the roll-up of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import tiou
from ..functions.parse import extract_description, parse_span

RECALL_THRESHOLDS = (0.3, 0.5, 0.7)


def score_spans(samples: DataFrame, pred: str = "pred") -> DataFrame:
    """Add the predicted span and text and the tIoU with ``start, end`` (0 without a span)."""
    return (
        samples.withColumn("pred_span", parse_span(F.col(pred)))
        .withColumn("pred_start", F.col("pred_span.start"))
        .withColumn("pred_end", F.col("pred_span.end"))
        .drop("pred_span")
        .withColumn("pred_text", extract_description(F.col(pred)))
        .withColumn(
            "tiou",
            F.when(
                F.col("pred_start").isNotNull(),
                tiou(F.col("pred_start"), F.col("pred_end"), F.col("start"), F.col("end")),
            ).otherwise(F.lit(0.0)),
        )
    )


def attach_scores(samples: DataFrame, scores: DataFrame, on: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Samples with their scores by a stable id; samples without a score keep nulls."""
    return samples.join(scores, list(on), "left")


def summarize(
    rows: DataFrame,
    by: Sequence[str] = (),
    metrics: Sequence[str] = ("tiou", "rouge_l", "bleu4", "bertscore_f1"),
    thresholds: Sequence[float] = RECALL_THRESHOLDS,
) -> DataFrame:
    """Sample count, span rate, means and tIoU recall, over all rows or per ``by``."""
    n = F.count(F.lit(1))
    found = F.count_if(F.col("pred_start").isNotNull())
    columns = [
        n.alias("n_samples"),
        found.alias("timestamp_found"),
        (found / n).alias("timestamp_rate"),
        *[F.avg(m).alias(f"mean_{m}") for m in metrics if m in rows.columns],
    ]
    if "tiou" in rows.columns:
        columns += [F.avg((F.col("tiou") >= t).cast("double")).alias(f"tiou_at_{t}") for t in thresholds]
    return rows.groupBy(*by).agg(*columns)


def side_by_side(
    predictions: DataFrame,
    models: Sequence[str] = ("zeroshot", "finetuned"),
    clip: Sequence[str] = ("sample_id", "video_id", "start", "end", "gt"),
) -> DataFrame:
    """Long (clip, model, text) as one row per clip with a column per model, null where it did not run.

    Rows meet by the first column of ``clip``, an id; the others belong to it. Models that are yet to
    run need no shuffle: see ``generate_side_by_side``.
    """
    key, *rest = clip
    texts = [F.first(F.when(F.col("model") == m, F.col("text")), ignorenulls=True).alias(m) for m in models]
    return predictions.groupBy(key).agg(*[F.first(c).alias(c) for c in rest], *texts)
