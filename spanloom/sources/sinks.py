"""Result, summary and sample tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table as JSON lines under ``path/<name>``, with null fields written out; all of them or none.

    Results stay in long form: a detection has ``videos``, ``activities`` and ``windows`` tables that
    share the video id, instead of one nested document.

    The tables are written under another name beside ``path``, which listings pass over, and get
    their own by one rename when the last one is there. ``mode`` is ``errorifexists`` or
    ``overwrite``; of an older result the reader sees either all or nothing. Stores without folders
    rename file by file, so there the last step is not atomic.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode is 'errorifexists' or 'overwrite'")
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    target = _path(spark, path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "errorifexists" and store.exists(target):
        raise FileExistsError(path)
    beside = f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}"
    staged, older = _path(spark, f"{beside}-new"), _path(spark, f"{beside}-old")
    try:
        for name, df in tables.items():
            df.write.option("ignoreNullFields", "false").json(f"{staged}/{name}")
        # A folder that is there would take the new one in instead of giving way to it.
        if store.exists(target):
            if mode == "errorifexists":
                raise FileExistsError(path)
            _move(store, target, older)
        try:
            _move(store, staged, target)
        except OSError:
            if store.exists(older):
                _move(store, older, target)
            raise
    finally:
        for rest in (staged, older):
            store.delete(rest, True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _move(store, source, target) -> None:
    if not store.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def write_results(rows: DataFrame, summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Per-sample rows and the one-row summary, published together; a missing span stays visible as null."""
    write_tables({"rows": rows, "summary": summary}, path, mode)


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists", array: str | None = None) -> DataFrame:
    """Samples as a parquet table partitioned by split; returns their totals.

    ``n_videos`` and ``n_annotations`` (of the lists in ``array``; rows, where it is not given) are
    counted as the rows pass by on their way to the files.
    """
    seen = Observation()
    inner = F.lit(1) if array is None else F.size(array)
    counted = samples.observe(
        seen, F.count(F.lit(1)).alias("n_videos"), F.coalesce(F.sum(inner), F.lit(0)).cast("bigint").alias("n_annotations")
    )
    counted.write.mode(mode).partitionBy("split").parquet(path)
    totals = seen.get
    return samples.sparkSession.createDataFrame([(totals["n_videos"], totals["n_annotations"])], "n_videos bigint, n_annotations bigint")
