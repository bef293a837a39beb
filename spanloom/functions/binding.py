"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Array lambdas evaluate everything they mention again for each element, also what does not
    depend on the element. A one-element transform turns such a value into a lambda variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(df: DataFrame, array: Column, item: str, place: str | None = None) -> DataFrame:
    """A row per item of a computed array of structs, next to all columns of ``df``.

    For a plain explode the planner first filters by the array's size, which computes it twice; an
    outer one that is filtered afterwards is not touched.
    """
    at = place or f"{item}_at"
    out = df.select("*", F.posexplode_outer(array).alias(at, item)).filter(F.col(at).isNotNull())
    return out if place else out.drop(at)
