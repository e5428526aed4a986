"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.truncation import hidden_limits, truncated, truncation_by_source
from quire.session import read_table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(read_table(spark, sf_dir, "documents")).select("doc_id")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_by_source(read_table(spark, sf_dir, "documents"))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_limits(read_table(spark, sf_dir, "documents"))


QUERIES = {"p9_found": p9_found, "p9_sources": p9_sources, "p9_limits": p9_limits}
ORACLES: dict[str, str] = {}
