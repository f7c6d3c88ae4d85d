"""Scoring samples as they arrive: a file stream of observations, a solver a micro-batch, appended estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mixolve.operators.solvers import solve

SCHEMA = "sample string, marker string, x double, c long"


def score_stream(spark: SparkSession, source: str, atlas: DataFrame, out: str, checkpoint: str, solver: str = "nnls", **options) -> StreamingQuery:
    """Each file of `source` holds whole samples; estimates of a batch go to a folder of their own, so a repeated batch writes the same.

    No state is kept between batches, hence no watermark. Runs through what is there and stops.
    """

    def batch(rows: DataFrame, number: int) -> None:
        solve(rows, atlas, solver, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
