"""Job logs: one JSON object per line, some lines broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "ts bigint, level string, stage string, message string, meta string, _broken string"
_ENTRY = "ts bigint, level string, stage string, message string, meta string"
#: Bytes of the largest log that is read, so one fits a row; larger ones are rejected.
MOST_LOG = 10_000_000


def parsed_log(lines: DataFrame, start: int = 0) -> DataFrame:
    """Entries from the ``start``-th on of lines (file, line, value), in the order of the lines of their file.

    Blank and broken lines don't count, nor do objects without a time.
    """
    d = lines.select("file", "line", F.from_json("value", _ENTRY, {"mode": "PERMISSIVE"}).alias("e")).where("e.ts is not null")
    d = d.select("file", "e.*", (F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1).alias("entry"))
    return d.where(F.col("entry") >= start)


def read_log(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Readable entries of each log from its ``start``-th on, in the order of its lines; logs above MOST_LOG bytes give none."""
    d = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    d = d.where(F.col("size") <= MOST_LOG).select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return parsed_log(d, start)


def tail_log(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """The same as a stream over a folder; files_per_batch limits the rate."""
    d = spark.readStream.schema(SCHEMA).option("columnNameOfCorruptRecord", "_broken").option("maxFilesPerTrigger", files_per_batch).json(path)
    return d.where("_broken is null and ts is not null").drop("_broken")
