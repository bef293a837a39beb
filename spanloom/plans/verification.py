"""Verification of a dataset folder."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import (
    EXPECTED_COUNTS,
    category_counts,
    check_counts,
    examine,
    expected_counts,
    issue_report,
    issues_of,
    status_of,
    verdict,
)
from ..shared import stash
from ..sources.annotations import read_raw_annotations
from ..sources.inventory import find_video_inventory, read_video_categories


@dataclass(frozen=True)
class Verification:
    status: DataFrame
    issues: DataFrame
    report: DataFrame
    categories: DataFrame | None
    verdict: DataFrame


def _observed(records: DataFrame, splits: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Examined records as they were written, and counts and issue totals of the splits.

    Both are counted while the rows are written, so nothing is read again for them.
    """
    seen = Observation()
    metrics = []
    for n, split in enumerate(splits):
        own = F.col("split") == F.lit(split)
        metrics += [
            F.count_if(own).alias(f"videos_{n}"),
            F.coalesce(F.sum(F.when(own, F.col("n_annotations"))), F.lit(0)).cast("bigint").alias(f"annotations_{n}"),
            F.coalesce(F.sum(F.when(own, F.size("issues"))), F.lit(0)).cast("bigint").alias(f"issues_{n}"),
        ]
    examined = stash(examine(records).observe(seen, *metrics) if metrics else examine(records), "examined")
    found = seen.get if metrics else {}
    rows = [(s, found[f"videos_{n}"], found[f"annotations_{n}"], found[f"issues_{n}"]) for n, s in enumerate(splits)]
    spark = records.sparkSession
    counts = spark.createDataFrame([r[:3] for r in rows if r[1]], "split string, videos bigint, annotations bigint")
    issues = spark.createDataFrame([(r[0], r[3]) for r in rows if r[3]], "split string, n_issues bigint")
    return examined, counts, issues


def verify_records(
    records: DataFrame,
    inventory: DataFrame | None,
    expected: Mapping[str, Mapping[str, int]] = EXPECTED_COUNTS,
    categories: DataFrame | None = None,
) -> Verification:
    """Checks of raw records of all splits against expected counts and the video inventory.

    Records are parsed once. Counts, status and verdict are made in the same pass; issues and report
    read what it wrote. ``categories`` lists folders that may have no video.
    """
    examined, counts, n_issues = _observed(records, list(expected))
    issues = issues_of(examined)
    status = status_of(check_counts(counts, expected_counts(records, expected)), n_issues)
    by_category = None if inventory is None else category_counts(inventory, categories)
    return Verification(status, issues, issue_report(issues), by_category, verdict(status, inventory))


def verify_folder(
    spark: SparkSession,
    files: Mapping[str, str],
    video_root: str,
    expected: Mapping[str, Mapping[str, int]] = EXPECTED_COUNTS,
) -> Verification:
    """``files`` maps split to annotation file. A split whose file is not there counts as missing."""
    records = None
    for split, path in files.items():
        try:
            part = read_raw_annotations(spark, path, split)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error.getCondition()):
                raise
            continue
        records = part if records is None else records.unionByName(part)
    if records is None:
        records = spark.createDataFrame([], "split string, pos bigint, video_id string, raw string")
    inventory = find_video_inventory(spark, video_root)
    categories = None if inventory is None else read_video_categories(spark, video_root)
    return verify_records(records, inventory, expected, categories)
