"""Training-log points in long form."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..shared import stash

# Numbers as they are logged; Java would also take "1d" or "0x1p3".
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|NaN|nan|Infinity|inf)$"


POINT_KEY = ["run_id", "step", "key"]


def metric_points(logs: DataFrame, *also: str) -> DataFrame:
    """``run_id, step, logs map`` as one row per numeric value, with further columns on request."""
    rows = logs.select("run_id", "step", *also, F.explode("logs").alias("key", "raw"))
    return rows.filter(F.col("raw").rlike(NUMBER_PATTERN)).select(
        "run_id", "step", "key", F.col("raw").try_cast("double").alias("value"), *also
    )


def metric_points_json(logs: DataFrame) -> DataFrame:
    """The same for ``logs`` as JSON text, which still tells numbers and booleans from strings."""
    rows = logs.select("run_id", "step", F.explode(F.from_json("logs", "map<string, variant>")).alias("key", "raw"))
    numeric = F.schema_of_variant("raw").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$")
    return rows.filter(numeric).select("run_id", "step", "key", F.col("raw").cast("double").alias("value"))


def append_points(points: DataFrame, path: str) -> None:
    """Append points as they are; a repeated step stands there twice."""
    points.write.mode("append").parquet(path)


def append_new_points(points: DataFrame, path: str) -> None:
    """Append the points whose run, step and key are not there yet, so a step logged again changes nothing."""
    spark = points.sparkSession
    fresh = points.dropDuplicates(POINT_KEY)
    try:
        there = spark.read.schema(points.select(*POINT_KEY).schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
    else:
        # Written first: what is read here must not change while it is appended to.
        fresh = stash(fresh.join(there, POINT_KEY, "left_anti"), "points")
    append_points(fresh, path)


def stream_points(logs: DataFrame, path: str, progress: str, event_time: str, delay: str) -> DataStreamWriter:
    """Writer of the points of a stream of logs, each run's step and key once.

    A trainer that restarts from its last checkpoint logs some steps again. They are known by state
    that lasts ``delay`` of event time beyond a point, so repeats may come that late.
    """
    points = metric_points(logs.withWatermark(event_time, delay), event_time).dropDuplicatesWithinWatermark(POINT_KEY)
    writer = points.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", progress)
