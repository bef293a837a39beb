"""Text and number rendering as plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes, and the trailing part of a clip file name.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CLIP_SUFFIX_PATTERN = r"(?dU)\d+_x264$"


def strip_text(text: Column) -> Column:
    """Remove leading and trailing Unicode white space (plain ``trim`` only removes blanks)."""
    return F.trim(text, F.lit(SPACES))


def category_of(video_id: Column) -> Column:
    """Category is the video id without its trailing number and ``_x264``."""
    return F.regexp_replace(video_id, CLIP_SUFFIX_PATTERN, "")


def video_path_of(root: str | Column, video_id: Column) -> Column:
    """``root/category/video_id.mp4``."""
    base = F.lit(root.rstrip("/")) if isinstance(root, str) else root
    return F.concat(base, F.lit("/"), category_of(video_id), F.lit("/"), video_id, F.lit(".mp4"))


def to_double(value: Column) -> Column:
    """Numeric cast that yields null instead of failing under ANSI mode."""
    return value.try_cast("double")


def fmt1(seconds: Column) -> Column:
    """Seconds with exactly one decimal, rounded as the binary value demands.

    ``format_string`` and ``bround`` round the decimal rendering and miss near-ties such as
    0.15. Ten times the value is therefore taken as half of an exact two-term sum of 20x, and
    its error term settles every tie; a true tie goes to the even digit.
    """
    x = F.abs(seconds)
    big, small = x * F.lit(16.0), x * F.lit(4.0)
    total = big + small
    part = total - big
    error = (big - (total - part)) + (small - part)
    tenfold = total / F.lit(2.0)
    below = F.floor(tenfold).cast("double")
    on_tie = (tenfold - below) == F.lit(0.5)
    tenths = (
        F.when(on_tie & (error > 0), below + F.lit(1.0))
        .when(on_tie & (error < 0), below)
        .otherwise(F.rint(tenfold))
        .cast("bigint")
    )
    sign = F.when(seconds < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(tenths / F.lit(10)).cast("bigint")
    return F.concat(sign, whole.cast("string"), F.lit("."), (tenths % F.lit(10)).cast("string"))
