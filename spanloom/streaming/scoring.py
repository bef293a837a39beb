"""Scoring of prediction files as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.evaluate import score_spans, summarize

PREDICTION_SCHEMA = "model string, sample_id bigint, start double, end double, pred string"


def read_predictions(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PREDICTION_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def score_stream(predictions: DataFrame) -> DataFrame:
    """Span and tIoU of every prediction; stateless, so rows are appended."""
    return score_spans(predictions)


def summary_stream(predictions: DataFrame) -> DataFrame:
    """Running roll-up per model; one small state row each, for complete output mode."""
    return summarize(score_spans(predictions), by=("model",))


def append_scores(predictions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        score_stream(predictions)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def publish_summary(predictions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each trigger writes the summary as a table of its own, ``path/batch=<number>``.

    A repeated trigger replaces its own table only, so ``read_summary`` finds the last whole one at
    any time.
    """

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        summary_stream(predictions)
        .writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
    )


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The last published summary."""
    tables = spark.read.parquet(path)
    # The batch is a partition column, so the others' files are not read.
    newest = tables.agg(F.max("batch")).first()[0]
    return tables.filter(F.col("batch") == F.lit(newest)).drop("batch")
