"""Video files on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, root: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def read_video_categories(spark: SparkSession, root: str) -> DataFrame:
    """``category`` of every folder right below ``root``, with or without videos.

    One listing of one folder; its names pass through the driver as in any file listing of Spark.
    """
    store, folder = _store(spark, root)
    names = [f.getPath().getName() for f in store.listStatus(folder) if f.isDirectory()]
    return spark.createDataFrame([(n,) for n in sorted(names)], "category string")


def read_video_inventory(spark: SparkSession, root: str) -> DataFrame:
    """``path, category, video_id, length`` of ``root/<category>/<video_id>.mp4``, at exactly that depth.

    Only listing data is selected, so file contents stay unread; files of no length are passed over. Category folders without videos
    are seen by ``read_video_categories``.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.mp4")
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    store, folder = _store(spark, root)
    base = store.makeQualified(folder).toUri().getPath().rstrip("/") + "/"
    below = F.regexp_replace("path", r"^[^:/]+:(//[^/]*)?(?=/)", "")
    tail = r"^([^/]+)/([^/]+)\.mp4$"
    inside = F.when(F.startswith(below, F.lit(base)), F.substring(below, F.lit(len(base) + 1), F.length(below)))
    return files.withColumn("inside", inside).filter(F.col("inside").rlike(tail)).select(
        "path",
        F.regexp_extract("inside", tail, 1).alias("category"),
        F.regexp_extract("inside", tail, 2).alias("video_id"),
        "length",
    )


def find_video_inventory(spark: SparkSession, root: str) -> DataFrame | None:
    """The inventory, or None when the folder does not exist."""
    try:
        return read_video_inventory(spark, root)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return None
        raise
