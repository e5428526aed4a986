"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.batches import small_batches
from quire.llm.sentences import sentences
from quire.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sentences(read_table(spark, sf_dir, "paragraphs"), "para_id")


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
