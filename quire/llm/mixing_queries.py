"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.batches import small_batches
from quire.llm.mixing import mixed_documents, shares
from quire.llm.tokens import with_tokens
from quire.session import read_table


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    return mixed_documents(docs, read_table(spark, sf_dir, "mix_targets"), lambda d: with_tokens(d, "doc_id", "text", ["source"]))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p8_mixed(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


QUERIES = {"p8_mixed": p8_mixed, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
