"""Session helpers: reading tables, cutting lineage, sizing shuffles."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a session in one process, as in tests, may leave that unset: it
    gets a temporary folder, which goes when the process ends; any other session without a shared folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    now = context.getCheckpointDir()
    if named:
        if now is None:
            context.setCheckpointDir(named)
        return named
    if now is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
        now = context.getCheckpointDir()
    return str(now)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so later steps neither recompute it nor lose it with an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle and sort, whatever size Spark takes ``right`` for.

    Spark's estimate counts a column of q-grams, keys or Python's output at its size before it was exploded, also
    behind a checkpoint, so tables of hundreds of megabytes would be broadcast through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
