"""Algebra of spans given in seconds from the start of a video."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DURATION = 120.0
DURATION_CAP = 120.0


def valid_interval(start: Column, end: Column) -> Column:
    """True for ``end > start``. Spark sorts NaN above all numbers, so NaN is excluded by hand."""
    return (end > start) & ~F.isnan(start) & ~F.isnan(end)


def duration_or_default(duration: Column, default: float = DEFAULT_DURATION) -> Column:
    return F.coalesce(duration, F.lit(default))


def effective_end(
    duration: Column, cap: float = DURATION_CAP, nonpositive_to_cap: bool = False
) -> Column:
    """Last second that is looked at: the duration, at most ``cap``.

    With ``nonpositive_to_cap`` an unknown (zero or negative) duration counts as ``cap``, which is
    the rule for inference; sample building takes the duration as it is.
    """
    capped = F.least(duration, F.lit(cap))
    if nonpositive_to_cap:
        return F.when(duration > 0, capped).otherwise(F.lit(cap))
    return capped


def tiou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Temporal intersection over union; 0 where the union is not positive.

    A span that ends before it starts is not repaired: it adds its negative length to the union.
    """
    shared = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
