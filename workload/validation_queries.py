"""Record checks and counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.validate import (
    category_counts,
    check_counts,
    expected_counts,
    issue_report,
    split_counts,
    split_status,
    validate,
    verdict,
)

from spanloom.plans.verification import verify_records
from spanloom.shared import new_folder
from spanloom.sources import read_video_categories, read_video_inventory

from .registry import query
from .views import ctes, dirty_records, inventory, raw_records, table

# Two real splits with a right and a wrong expectation are made from the data; one split is not there.
_ISSUES = ctes("rec") + """
, miss AS (SELECT split, pos, video_id, 'missing' AS kind, 0 AS kind_no, 0 AS item, video_id || ': missing required fields' AS message
           FROM rec WHERE sents IS NULL OR duration IS NULL)
, full_ AS (SELECT * FROM rec WHERE sents IS NOT NULL AND duration IS NOT NULL)
, len_ AS (SELECT split, pos, video_id, 'length', 1, 0, video_id || ': timestamps/sentences length mismatch' FROM full_ WHERE len(ts) <> len(sents))
, span AS (SELECT split, pos, video_id, 'span', 2, i - 1, video_id || ': invalid timestamp [' || CAST(ts[i][1] AS VARCHAR) || ', ' || CAST(ts[i][2] AS VARCHAR) || ']'
           FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM full_) WHERE ts[i][1] >= ts[i][2] OR ts[i][1] < 0)
, issues AS (SELECT * FROM miss UNION ALL SELECT * FROM len_ UNION ALL SELECT * FROM span)
, counts AS (SELECT split, CAST(count(*) AS BIGINT) AS videos,
    CAST(coalesce(sum(CASE WHEN sents IS NOT NULL AND duration IS NOT NULL THEN len(ts) END), 0) AS BIGINT) AS annotations FROM rec GROUP BY split)
"""


@query(
    "validate",
    _ISSUES + "SELECT split, pos, video_id, kind, CAST(item AS BIGINT) AS item, message FROM issues",
)
def q_validate(spark, sf):
    return validate(raw_records(spark, sf)).select(
        "split", "pos", "video_id", "kind", F.col("item").cast("bigint").alias("item"), "message"
    )


@query(
    "validate_malformed",
    """
WITH d AS (SELECT lang AS split, doc_id AS pos, 'Doc' || CAST(doc_id AS VARCHAR) || '_x264' AS video_id, doc_id % 8 AS t, doc_id % 3 AS s FROM documents)
, found AS (
  SELECT *, 'malformed' AS kind, 0 AS item, 'malformed timestamps' AS message FROM d WHERE t IN (0, 1)
  UNION ALL SELECT *, 'malformed', 1, 'malformed sentences' FROM d WHERE s IN (1, 2)
  UNION ALL SELECT *, 'length', 0, 'timestamps/sentences length mismatch' FROM d WHERE s = 0 AND t IN (5, 6)
  UNION ALL SELECT *, 'malformed', 0, 'malformed timestamp ' || CASE t WHEN 2 THEN '[1]' WHEN 3 THEN '[1,2,3]' WHEN 4 THEN '["abc",2]' WHEN 5 THEN '3' ELSE 'null' END
    FROM d WHERE t IN (2, 3, 4, 5, 7)
  UNION ALL SELECT *, 'span', 1, 'invalid timestamp [2, 1]' FROM d WHERE t = 6)
SELECT split, pos, video_id, kind, CAST(item AS BIGINT) AS item, video_id || ': ' || message AS message FROM found""",
)
def q_validate_malformed(spark, sf):
    return validate(dirty_records(spark, sf)).select(
        "split", "pos", "video_id", "kind", F.col("item").cast("bigint").alias("item"), "message"
    )


@query("split_counts", _ISSUES + "SELECT * FROM counts")
def q_split_counts(spark, sf):
    return split_counts(raw_records(spark, sf))


@query(
    "issue_report",
    _ISSUES
    + """
SELECT i.split, CAST(rn AS BIGINT) AS line, message, n AS n_issues, greatest(n - 5, 0) AS n_more
FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY pos, kind_no, item) AS rn, count(*) OVER (PARTITION BY split) AS n FROM issues) i
WHERE rn <= 5""",
)
def q_issue_report(spark, sf):
    return issue_report(validate(raw_records(spark, sf))).withColumn("line", F.col("line").cast("bigint"))


_EXPECTED = {
    "en": {"videos": 620, "annotations": 1},
    "fr": {"videos": 145, "annotations": 2},
    "it": {"videos": 1, "annotations": 1},
}
_EXPECTED_SQL = (
    "(VALUES "
    + ", ".join(f"('{s}', {n['videos']}, {n['annotations']})" for s, n in _EXPECTED.items())
    + ") AS x(split, expected_videos, expected_annotations)"
)
_CHECK_SQL = _ISSUES + f"""
, checked AS (SELECT x.split, videos IS NULL AS is_missing, videos, CAST(expected_videos AS BIGINT) AS expected_videos, annotations,
    CAST(expected_annotations AS BIGINT) AS expected_annotations, coalesce(videos = expected_videos, false) AS videos_ok,
    coalesce(annotations = expected_annotations, false) AS annotations_ok
  FROM {_EXPECTED_SQL} LEFT JOIN counts ON counts.split = x.split)
, status AS (SELECT c.*, coalesce(n, 0) AS n_issues, CASE WHEN is_missing THEN 'MISSING' WHEN videos_ok AND annotations_ok AND coalesce(n, 0) = 0 THEN 'OK' ELSE 'WARN' END AS status
  FROM checked c LEFT JOIN (SELECT split, count(*) AS n FROM issues GROUP BY 1) i ON i.split = c.split)
"""


def _checked(spark, sf):
    records = raw_records(spark, sf)
    return check_counts(split_counts(records), expected_counts(records, _EXPECTED))


@query("check_counts", _CHECK_SQL + "SELECT * FROM checked")
def q_check(spark, sf):
    return _checked(spark, sf)


@query("split_status", _CHECK_SQL + "SELECT split, n_issues, status FROM status")
def q_status(spark, sf):
    return split_status(_checked(spark, sf), validate(raw_records(spark, sf))).select("split", "n_issues", "status")


@query(
    "verdict",
    _CHECK_SQL
    + """
SELECT CAST(count(*) FILTER (status = 'OK') AS BIGINT) AS n_ok, CAST(count(*) FILTER (status = 'WARN') AS BIGINT) AS n_warn,
  CAST(count(*) FILTER (status = 'MISSING') AS BIGINT) AS n_missing, true AS videos_present, bool_and(status = 'OK') AS is_valid FROM status""",
)
def q_verdict(spark, sf):
    status = split_status(_checked(spark, sf), validate(raw_records(spark, sf)))
    return verdict(status, inventory(spark, sf))


@query(
    "category_counts",
    ctes("inv") + "\nSELECT category, CAST(count(*) AS BIGINT) AS videos FROM inv GROUP BY category",
)
def q_categories(spark, sf):
    return category_counts(inventory(spark, sf))


def make_files(paths: DataFrame, root: str) -> None:
    """A video of one byte for each ``path`` that ends in .mp4, a folder for each other one; made in the tasks."""
    spark = paths.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    base = store.makeQualified(folder).toUri()
    # Spark names local folders file:/x, Arrow file:///x.
    at = f"{base.getScheme()}://{base.getAuthority() or ''}{base.getPath()}"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, below = FileSystem.from_uri(at)
        there = set()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own = f"{below}/{path}"
                parent = own.rpartition("/")[0] if path.endswith(".mp4") else own
                if parent not in there:
                    store.create_dir(parent, recursive=True)
                    there.add(parent)
                if parent != own:
                    with store.open_output_stream(own) as file:
                        file.write(b"\1")  # Spark's listing passes over empty files
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    dealt = paths.select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path")
    dealt.mapInArrow(make, "n long").agg(F.sum("n")).collect()


@query(
    "category_folders",
    """
SELECT n_name AS category, CAST(count(s_suppkey) AS BIGINT) AS videos FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT r_name, CAST(0 AS BIGINT) FROM region""",
)
def q_category_folders(spark, sf):
    """A tree of folders: suppliers are videos in their nation's folder, regions are folders without any."""
    root = new_folder(spark, "videos")
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").cast("string").alias("video"))
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    files = nations.join(suppliers, "n_nationkey", "left").select(F.concat_ws("/", "n_name", F.concat("video", F.lit("_x264.mp4"))).alias("path"))
    folders = table(spark, sf, "region").select(F.col("r_name").alias("path"))
    make_files(files.union(folders), root)
    return category_counts(read_video_inventory(spark, root), read_video_categories(spark, root))


@query(
    "verify_records",
    _CHECK_SQL + "SELECT split, videos, annotations, n_issues, status, (SELECT bool_and(status = 'OK') FROM status) AS is_valid FROM status",
)
def q_verify_records(spark, sf):
    """The whole verification: one pass over the records."""
    found = verify_records(raw_records(spark, sf), inventory(spark, sf), _EXPECTED)
    return found.status.crossJoin(F.broadcast(found.verdict.select("is_valid"))).select(
        "split", "videos", "annotations", "n_issues", "status", "is_valid"
    )
