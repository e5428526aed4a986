"""Sizes of the batches that go to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows per Arrow batch where rows hold whole texts; keeps a batch of long texts within tens of megabytes.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
