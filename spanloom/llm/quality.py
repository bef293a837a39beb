"""Quality rules: a table of thresholds compiled into one projection.

Everything is a built-in column function; nothing is shuffled and no Python runs on the rows.

A document fails its base rules with fewer than 50 words, or if over half of its words lie in
three-word windows that occur more than once. It is kept if no base rule and no threshold fails. A
ratio over nothing is null and fails no threshold. A null or empty text has no words and fails; a
null id is kept as it is; repeated rows are judged alike; further columns do not matter, whatever
their names. Very long texts are one row like any other, and their windows one array of it. The least
share of stop words is that of the four languages listed, so texts in others are not kept. Empty
tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_or_null

_WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# The most frequent function words of four languages.
STOP_WORDS = tuple(
    "the of and to in a is that it for as was with be by on not he his are this from at "
    "der die das und in zu den von ist mit sich des auf für im dem nicht ein eine als auch "
    "de la le et les des en un une du que est pour qui dans par sur au il pas avec ce "
    "el los las y del se una por con no su para es al lo como más o pero".split()
)


@dataclass(frozen=True)
class Threshold:
    """A measure must lie between two values (none: no bound)."""

    measure: str
    least: float | None = None
    most: float | None = None


THRESHOLDS = (
    Threshold("mean_word_length", least=2.0, most=14.0),
    Threshold("symbols_per_word", most=0.25),
    Threshold("stop_word_ratio", least=0.02),
    Threshold("duplicate_line_ratio", most=0.5),
    Threshold("ellipsis_line_ratio", most=0.5),
    Threshold("upper_case_ratio", most=0.6),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and all measures of each text."""
    text = F.coalesce(column_or_null(docs, "text", "string"), F.lit(""))
    # Array columns are built once each; later ones only refer to them.
    words = docs.select(
        column_or_null(docs, "doc_id", "long").alias("doc_id"),
        text.alias("text"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, _WHITE)) > 0).alias("lines"),
    )
    n = F.size("words")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = words.withColumn(
        "windows",
        F.transform(starts, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
    )
    # Windows next to an equal one in hash order are repeated. Most texts have none.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = windows.withColumn(
        "ordered",
        F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )

    def same(k: Column, x: Column) -> Column:
        return F.coalesce(F.get("ordered", k)["h"] == x["h"], F.lit(False))

    at = ordered.withColumn(
        "at", F.sort_array(F.transform(F.filter("ordered", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))
    )
    new = F.transform("at", lambda p, k: F.least(F.lit(3), p - F.coalesce(F.when(k > 0, F.get("at", k - 1)), F.lit(-3))))
    letters = _without(F.col("text"), _WHITE)
    bare = F.length(letters)
    plain = F.regexp_replace("text", r"[^\p{L}]", "")
    stops = F.filter("words", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))
    dotted = F.filter("lines", lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…"))
    counted = at.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        bare.cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(stops).cast("long").alias("n_stop_words"),
        F.size(dotted).cast("long").alias("n_ellipsis_lines"),
        F.length(plain).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(plain, r"[^\p{Lu}]", "")).cast("long").alias("n_upper"),
    )
    col = F.col
    return counted.withColumns(
        {
            "mean_word_length": _ratio(col("word_chars"), col("n_words")),
            "symbols_per_word": _ratio(col("n_symbols"), col("n_words")),
            "stop_word_ratio": _ratio(col("n_stop_words"), col("n_words")),
            "duplicate_line_ratio": _ratio(col("n_dup_lines"), col("n_lines")),
            "ellipsis_line_ratio": _ratio(col("n_ellipsis_lines"), col("n_lines")),
            "upper_case_ratio": _ratio(col("n_upper"), col("n_letters")),
        }
    )


def fails(threshold: Threshold) -> Column:
    value = F.col(threshold.measure)
    bounds = []
    if threshold.least is not None:
        bounds.append(value < threshold.least)
    if threshold.most is not None:
        bounds.append(value > threshold.most)
    failed = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
    return F.coalesce(failed, F.lit(False))


def judge(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """Measures, base_failed, failed (names of the failed thresholds) and kept of each document."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(fails(t), F.lit(t.measure)) for t in thresholds]))
    return measures(docs).withColumns({"base_failed": base, "failed": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )
