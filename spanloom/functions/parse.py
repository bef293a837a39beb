"""Spans, descriptions and activity lists out of generated text.

Patterns carry ``(?dU)``: only ``\\n`` ends a line and classes are Unicode-aware, which is what
makes Java's matcher agree with the dialect the patterns were written for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_text, to_double

# The three output patterns.
SPAN_PATTERN = r"(?dU)\[\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\]"
TIMESTAMP_PART_PATTERN = r"(?dU)[Tt]imestamps?:?\s*\[.*?\]"
ACTIVITY_PATTERN = r"(?dU)\d+\.\s*\[(\d+\.?\d*),\s*(\d+\.?\d*)\]\s*(.+)"

ACTIVITY_TYPE = "array<struct<start: double, end: double, description: string>>"


def parse_span(text: Column) -> Column:
    """First ``[a, b]`` in the text as ``struct<start, end>``; null where there is none."""
    start = to_double(F.nullif(F.regexp_extract(text, SPAN_PATTERN, 1), F.lit("")))
    end = to_double(F.nullif(F.regexp_extract(text, SPAN_PATTERN, 2), F.lit("")))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def extract_description(text: Column) -> Column:
    """Text without its ``Timestamps: [..]`` parts; the untouched text when nothing else is left."""
    rest = strip_text(F.regexp_replace(text, TIMESTAMP_PART_PATTERN, ""))
    return F.when(rest == "", text).otherwise(rest)


def parse_activities(text: Column) -> Column:
    """Numbered lines ``1. [s, e] description`` as an array of activities, in text order."""
    starts, ends, words = (
        F.regexp_extract_all(text, F.lit(ACTIVITY_PATTERN), F.lit(group)) for group in (1, 2, 3)
    )
    rows = F.arrays_zip(starts.alias("s"), ends.alias("e"), words.alias("d"))
    return F.transform(
        rows,
        lambda row: F.struct(
            to_double(row["s"]).alias("start"),
            to_double(row["e"]).alias("end"),
            strip_text(row["d"]).alias("description"),
        ),
    )


def shift_activities(activities: Column, offset: Column) -> Column:
    """Move activities given relative to a window to video time."""
    return F.transform(
        activities,
        lambda a: F.struct(
            (a["start"] + offset).alias("start"),
            (a["end"] + offset).alias("end"),
            a["description"].alias("description"),
        ),
    )
