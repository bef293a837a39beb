"""Evaluation of a captioner on clips: frames, texts, spans, text metrics, roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chat import clip_prompt, messages, render_chat, video_metadata
from ..operators.evaluate import score_spans, summarize
from ..operators.frames import frame_refs
from ..operators.generate import CLIP_NEW_TOKENS, CaptionerFactory, generate
from ..operators.textmetrics import Embedder, bleu4, embed_and_match, rouge_l
from ..shared import stash

CLIP_FRAMES = 4


@dataclass(frozen=True)
class Evaluation:
    rows: DataFrame
    summary: DataFrame


def clip_inputs(samples: DataFrame, frames: DataFrame, n_frames: int = CLIP_FRAMES) -> DataFrame:
    """Clip samples with their frame references, frame times and prompt text.

    ``samples``: ``sample_id, video_id, start, end, gt``.
    """
    refs = frame_refs(samples.withColumnRenamed("sample_id", "clip_id"), frames, n_frames)
    refs = refs.withColumnRenamed("clip_id", "sample_id")
    prompt = render_chat(messages(clip_prompt()), add_generation_prompt=True)
    return (
        samples.join(refs, "sample_id")
        .withColumn("metadata", video_metadata(F.col("start"), F.col("end"), n_frames))
        .withColumn("prompt", prompt)
    )


def score_predictions(predicted: DataFrame, embedder=None) -> DataFrame:
    """``pred`` against ``start, end, gt``: span, tIoU, ROUGE-L, BLEU-4 and, with an embedder, matching."""
    rows = score_spans(predicted)
    rows = rouge_l(rows, "pred_text", "gt")
    rows = bleu4(rows, "pred_text", "gt")
    if embedder is not None:
        rows = embed_and_match(rows, embedder, "pred_text", "gt").drop("bertscore_precision", "bertscore_recall")
    return rows


def evaluate(
    samples: DataFrame,
    frames: DataFrame,
    captioner: CaptionerFactory,
    embedder: Embedder | None = None,
    by: tuple[str, ...] = (),
    n_frames: int = CLIP_FRAMES,
    max_new_tokens: int = CLIP_NEW_TOKENS,
    model: str | None = None,
) -> Evaluation:
    """Per-sample rows and their summary, which names the ``model`` if given.

    Scored rows are written once: rows and summary must not each run the model.
    """
    predicted = generate(clip_inputs(samples, frames, n_frames), captioner, max_new_tokens, keep=samples.columns)
    scored = score_predictions(predicted, embedder).select(
        *[c for c in samples.columns if c not in ("start", "end", "gt")],
        F.col("start").alias("gt_start"),
        F.col("end").alias("gt_end"),
        F.col("gt").alias("gt_text"),
        "pred",
        "pred_start",
        "pred_end",
        "tiou",
        "rouge_l",
        "bleu4",
        *(["bertscore_f1"] if embedder is not None else []),
    )
    rows = stash(scored, "evaluation")
    summary = summarize(rows, by)
    return Evaluation(rows, summary if model is None else summary.withColumn("model", F.lit(model)))
