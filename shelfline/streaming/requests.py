"""Stateless stream scoring of forecast requests.

Each request carries its own history, so the stream needs neither watermark nor
state store: the batch functions run unchanged on every micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfline.operators.requests import REQUEST_SCHEMA, Scorer, classify_with_tables, score_requests


def read_request_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New request files as a stream, fixed schema, bounded batch size."""
    return (
        spark.readStream.schema(REQUEST_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The same requests as a batch table; malformed documents fail the read."""
    return spark.read.schema(REQUEST_SCHEMA).option("mode", "FAILFAST").json(folder)


def score_stream(
    requests: DataFrame,
    skus: DataFrame,
    warehouses: DataFrame,
    training_end,
    scorers: dict[int, tuple[str, str, Scorer]],
) -> DataFrame:
    """``skus`` and ``warehouses`` are static tables of the levels the model knows, of any size."""
    return score_requests(classify_with_tables(requests, skus, warehouses, training_end), scorers)


def start_scoring(responses: DataFrame, output: str, checkpoint: str):
    """Append responses as Parquet; the checkpoint folder makes restarts exact."""
    return (
        responses.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
