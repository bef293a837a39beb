"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local-cluster") or not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spanloom-")
    return _local_roots[app]


def new_folder(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return os.path.join(shared_root(spark), "spanloom", app, f"{label}-{uuid.uuid4().hex}")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage and pins results that must not differ between two readers (sampled range
    bounds, state handed from one round to the next), also after an executor is lost.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
