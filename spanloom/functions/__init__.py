"""Columns in, columns out."""

from .chat import (
    ChatTemplate,
    clip_prompt,
    clip_response,
    dense_prompt,
    dense_response,
    messages,
    render_chat,
    video_metadata,
    window_prompt,
)
from .intervals import duration_or_default, effective_end, tiou, valid_interval
from .labels import attention_mask, mask_labels, pad_ids, truncate_ids
from .pairs import bleu_counts, bleu_score, lcs_counts, rouge_f, stem_tokens, tokens_13a
from .parse import extract_description, parse_activities, parse_span, shift_activities
from .stemming import porter_stem
from .text import category_of, fmt1, strip_text, to_double, video_path_of

__all__ = [
    "ChatTemplate",
    "attention_mask",
    "bleu_counts",
    "bleu_score",
    "category_of",
    "clip_prompt",
    "clip_response",
    "dense_prompt",
    "dense_response",
    "duration_or_default",
    "effective_end",
    "extract_description",
    "fmt1",
    "lcs_counts",
    "mask_labels",
    "messages",
    "pad_ids",
    "parse_activities",
    "parse_span",
    "porter_stem",
    "render_chat",
    "rouge_f",
    "shift_activities",
    "stem_tokens",
    "strip_text",
    "tiou",
    "to_double",
    "tokens_13a",
    "truncate_ids",
    "valid_interval",
    "video_metadata",
    "video_path_of",
    "window_prompt",
]
