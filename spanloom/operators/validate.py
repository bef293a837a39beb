"""Checks of annotation records against their rules and expected counts.

Works on raw records: ``split, pos, video_id, raw`` with ``raw`` the record's JSON text, so that a
field that is present but null, or a number's own spelling, is not lost.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.binding import each
from ..functions.text import to_double

REQUIRED_FIELDS = ("duration", "timestamps", "sentences")
ISSUES_SHOWN = 5

# What the full dataset holds per split.
EXPECTED_COUNTS = {
    "Train": {"videos": 1165, "annotations": 15677},
    "Val": {"videos": 379, "annotations": 3534},
    "Test": {"videos": 310, "annotations": 4331},
}


def _fields(records: DataFrame) -> DataFrame:
    return (
        records.withColumn("fields", F.from_json("raw", "map<string, string>"))
        .withColumn(
            "complete",
            F.forall(
                F.array(*[F.lit(f) for f in REQUIRED_FIELDS]),
                lambda f: F.coalesce(F.map_contains_key(F.col("fields"), f), F.lit(False)),
            ),
        )
        .withColumn("spans", F.from_json(F.col("fields")["timestamps"], "array<string>"))
        .withColumn("pairs", F.from_json(F.col("fields")["timestamps"], "array<array<string>>"))
        .withColumn("texts", F.from_json(F.col("fields")["sentences"], "array<string>"))
    )


def _shown(number: Column) -> Column:
    """A JSON number as it is reported: decimals without needless zeros."""
    trimmed = F.regexp_replace(number, r"^(-?\d+\.\d*?[1-9])0+$", "$1")
    return F.regexp_replace(trimmed, r"^(-?\d+)\.0+$", "$1.0")


def examine(records: DataFrame) -> DataFrame:
    """Each record parsed once: ``split, pos, video_id, n_annotations, issues``.

    ``n_annotations`` is null unless the record has all fields. An issue is ``kind, kind_no, item, message``.

    A field that is null or no list is ``malformed``, and so is a span that is not a list of two
    numbers (or numeric strings). JSON text held in a string counts as what it holds. Lengths are
    compared where both fields are lists.
    """
    # Spans are parsed all at once; where one of them is no list, each from its own text.
    alone = F.transform("spans", lambda s: F.struct(s.alias("spans"), F.from_json(s, "array<string>").alias("pairs")))
    all_lists = F.coalesce((F.size("pairs") == F.size("spans")) & ~F.exists("pairs", lambda p: p.isNull()), F.lit(False))
    paired = F.when(all_lists, F.arrays_zip("spans", "pairs")).otherwise(alone)
    item = F.transform(paired, lambda s, i: F.struct(s["spans"].alias("text"), s["pairs"].alias("pair"), i.alias("i")))
    parsed = _fields(records).withColumn("items", item)

    def issue(kind: str, no: int, item: Column, message: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(no).alias("kind_no"),
            item.cast("int").alias("item"),
            F.concat(F.col("video_id"), F.lit(": "), message).alias("message"),
        )

    def when(condition: Column, found: Column) -> Column:
        return F.when(condition, F.array(found)).otherwise(F.array())

    missing = F.when(
        ~F.col("complete"), F.array(issue("missing", 0, F.lit(0), F.lit("missing required fields")))
    )
    no_spans = when(F.col("spans").isNull(), issue("malformed", 1, F.lit(0), F.lit("malformed timestamps")))
    no_texts = when(F.col("texts").isNull(), issue("malformed", 1, F.lit(1), F.lit("malformed sentences")))
    mismatch = when(
        F.size("spans") != F.size("texts"),
        issue("length", 1, F.lit(0), F.lit("timestamps/sentences length mismatch")),
    )

    def bounds(span: Column) -> list[Column]:
        return [to_double(F.get(span["pair"], F.lit(i))) for i in (0, 1)]

    def is_pair(span: Column) -> Column:
        start, end = bounds(span)
        return F.coalesce(F.size(span["pair"]) == 2, F.lit(False)) & start.isNotNull() & end.isNotNull()

    def is_bad(span: Column) -> Column:
        start, end = bounds(span)
        either_nan = F.isnan(start) | F.isnan(end)
        return ((start >= end) & ~either_nan) | ((start < 0) & ~F.isnan(start))

    def told(span: Column) -> Column:
        first, second = (_shown(F.get(span["pair"], F.lit(i))) for i in (0, 1))
        invalid = F.concat(F.lit("invalid timestamp ["), first, F.lit(", "), second, F.lit("]"))
        malformed = F.concat(F.lit("malformed timestamp "), F.coalesce(span["text"], F.lit("null")))
        return F.when(is_pair(span), issue("span", 2, span["i"], invalid)).otherwise(
            issue("malformed", 2, span["i"], malformed)
        )

    invalid = F.coalesce(F.transform(F.filter("items", lambda p: ~is_pair(p) | is_bad(p)), told), F.array())
    found = F.coalesce(missing, F.concat(no_spans, no_texts, mismatch, invalid))
    counted = F.when(F.col("complete"), F.size("spans"))
    return parsed.select("split", "pos", "video_id", counted.alias("n_annotations"), found.alias("issues"))


def issues_of(examined: DataFrame) -> DataFrame:
    """One row per issue: ``split, pos, video_id, kind, kind_no, item, message``."""
    return each(examined, F.col("issues"), "issue").select("split", "pos", "video_id", "issue.*")


def counts_of(examined: DataFrame) -> DataFrame:
    """Videos and annotations per split; only records with all fields count annotations."""
    return examined.groupBy("split").agg(
        F.count(F.lit(1)).alias("videos"),
        F.coalesce(F.sum("n_annotations"), F.lit(0)).cast("bigint").alias("annotations"),
    )


def validate(records: DataFrame) -> DataFrame:
    return issues_of(examine(records))


def split_counts(records: DataFrame) -> DataFrame:
    return counts_of(examine(records))


def category_counts(inventory: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Videos per category; a listing of ``categories`` adds those that have none."""
    found = inventory.groupBy("category").agg(F.count(F.lit(1)).alias("videos"))
    if categories is None:
        return found
    every = categories.select("category").distinct().join(found, "category", "full")
    return every.select("category", F.coalesce("videos", F.lit(0)).cast("bigint").alias("videos"))


def expected_counts(df: DataFrame, expected: Mapping[str, Mapping[str, int]] = EXPECTED_COUNTS) -> DataFrame:
    rows = [(split, n["videos"], n["annotations"]) for split, n in expected.items()]
    return df.sparkSession.createDataFrame(
        rows, "split string, expected_videos bigint, expected_annotations bigint"
    )


def check_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected splits against actual counts. A split that does not occur is missing."""
    # Both sides have one row per split; the planner sees that after the aggregation.
    return expected.join(actual, "split", "left").select(
        "split",
        F.col("videos").isNull().alias("is_missing"),
        "videos",
        "expected_videos",
        "annotations",
        "expected_annotations",
        F.coalesce(F.col("videos") == F.col("expected_videos"), F.lit(False)).alias("videos_ok"),
        F.coalesce(F.col("annotations") == F.col("expected_annotations"), F.lit(False)).alias("annotations_ok"),
    )


def issue_report(issues: DataFrame, k: int = ISSUES_SHOWN) -> DataFrame:
    """The first ``k`` issues of each split and how many more there are."""
    order = W.partitionBy("split").orderBy("pos", "kind_no", "item")
    shown = issues.withColumn("line", F.row_number().over(order)).filter(F.col("line") <= k)
    totals = issues.groupBy("split").agg(F.count(F.lit(1)).alias("n_issues"))
    return shown.join(totals, "split").select(
        "split", "line", "message", "n_issues", F.greatest(F.col("n_issues") - k, F.lit(0)).alias("n_more")
    )


def split_status(checked: DataFrame, issues: DataFrame) -> DataFrame:
    """Status of each split: ``OK``, ``WARN`` or ``MISSING``."""
    return status_of(checked, issues.groupBy("split").agg(F.count(F.lit(1)).alias("n_issues")))


def status_of(checked: DataFrame, totals: DataFrame) -> DataFrame:
    """``split_status`` for issues that were counted before: ``split, n_issues``."""
    fine = F.col("videos_ok") & F.col("annotations_ok") & (F.col("n_issues") == 0)
    return (
        checked.join(totals, "split", "left")
        .withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
        .withColumn(
            "status", F.when(F.col("is_missing"), F.lit("MISSING")).when(fine, F.lit("OK")).otherwise(F.lit("WARN"))
        )
    )


def verdict(status: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """One row: whether every split is fine and there is a video folder.

    ``inventory=None`` stands for a missing folder; an empty folder still counts as present.
    """
    present = inventory is not None
    return status.agg(
        F.count_if(F.col("status") == "OK").alias("n_ok"),
        F.count_if(F.col("status") == "WARN").alias("n_warn"),
        F.count_if(F.col("status") == "MISSING").alias("n_missing"),
        F.lit(present).alias("videos_present"),
        (F.bool_and(F.col("status") == "OK") & F.lit(present)).alias("is_valid"),
    )
