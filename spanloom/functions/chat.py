"""Prompts, responses, chat messages and their rendering as one text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fmt1

# The prompt texts.
CLIP_PROMPT = (
    "Describe the activity in this surveillance video clip "
    "and provide the start and end timestamps in seconds."
)
DENSE_PROMPT = (
    "Describe ALL activities in this surveillance video. "
    "For each activity, provide a description and its start and end timestamps in seconds. "
    "List them in chronological order."
)
WINDOW_PROMPT_HEAD = "Describe ALL activities visible in this video segment. Timestamps are relative to "
WINDOW_PROMPT_TAIL = (
    "s of the full video. "
    "For each activity, provide a description and its start and end timestamps in seconds. "
    "List them in chronological order."
)


def clip_prompt() -> Column:
    return F.lit(CLIP_PROMPT)


def dense_prompt() -> Column:
    return F.lit(DENSE_PROMPT)


def window_prompt(offset: Column) -> Column:
    """Prompt of one window; its offset is shown in whole seconds, ties to even."""
    return F.concat(
        F.lit(WINDOW_PROMPT_HEAD), F.rint(offset).cast("bigint").cast("string"), F.lit(WINDOW_PROMPT_TAIL)
    )


def clip_response(sentence: Column, start: Column, end: Column) -> Column:
    """``<sentence> Timestamps: [s, e]`` with one decimal."""
    return F.concat(sentence, F.lit(" Timestamps: ["), fmt1(start), F.lit(", "), fmt1(end), F.lit("]"))


def dense_response(activities: Column, text_field: str = "sentence") -> Column:
    """Numbered lines ``i. [s, e] text`` in array order."""
    lines = F.transform(
        activities,
        lambda a, i: F.concat(
            (i + 1).cast("string"),
            F.lit(". ["),
            fmt1(a["start"]),
            F.lit(", "),
            fmt1(a["end"]),
            F.lit("] "),
            a[text_field],
        ),
    )
    return F.array_join(lines, "\n")


def video_metadata(start: Column, end: Column, n_frames: int) -> Column:
    """Planned frame seconds of a span: evenly spaced, cut to whole seconds, at one frame a second."""
    gaps = max(n_frames - 1, 1)
    seconds = F.transform(
        F.sequence(F.lit(0), F.lit(n_frames - 1)),
        lambda i: (start + i.cast("double") * (end - start) / F.lit(float(gaps))).cast("int"),
    )
    return F.struct(
        F.greatest(end.cast("int"), F.lit(n_frames)).alias("total_num_frames"),
        F.lit(1.0).alias("fps"),
        seconds.alias("frames_indices"),
        end.cast("double").alias("duration"),
    )


def _part(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))


def messages(prompt: Column, response: Column | None = None) -> Column:
    """User turn (a video and a prompt) and, for training, the assistant's turn."""
    turns = [
        F.struct(
            F.lit("user").alias("role"),
            F.array(_part("video", F.lit(None)), _part("text", prompt)).alias("content"),
        )
    ]
    if response is not None:
        turns.append(
            F.struct(F.lit("assistant").alias("role"), F.array(_part("text", response)).alias("content"))
        )
    return F.array(*turns)


@dataclass(frozen=True)
class ChatTemplate:
    """How a model wants its turns written. The assistant marker is also what label masking seeks."""

    turn_head: str = ": "
    turn_end: str = "\n"
    video_token: str = "<video>"
    assistant_marker: str = "Assistant:"


def render_chat(
    turns: Column, template: ChatTemplate = ChatTemplate(), add_generation_prompt: bool = False
) -> Column:
    """Messages as one training text, or with ``add_generation_prompt`` as one prompt text."""

    def turn(message: Column) -> Column:
        parts = F.transform(
            message["content"],
            lambda p: F.when(p["type"] == "video", F.lit(template.video_token)).otherwise(
                F.coalesce(p["text"], F.lit(""))
            ),
        )
        return F.concat(
            F.initcap(message["role"]),
            F.lit(template.turn_head),
            F.array_join(parts, ""),
            F.lit(template.turn_end),
        )

    text = F.array_join(F.transform(turns, turn), "")
    return F.concat(text, F.lit(template.assistant_marker)) if add_generation_prompt else text
