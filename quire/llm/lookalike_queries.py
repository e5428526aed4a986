"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import small_batches
from quire.llm.lookalikes import consistent_forms, look_alike_pairs
from quire.session import read_table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read_table(spark, sf_dir, "characters").select(F.lit("name").alias("item_kind"), "book_id", F.col("character_id").alias("item_id"), F.col("name").alias("text"))
    texts = read_table(spark, sf_dir, "paragraphs").select(F.lit("paragraph").alias("item_kind"), "book_id", F.col("para_id").cast("string").alias("item_id"), "text")
    return names.unionAll(texts)


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return consistent_forms(_items(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(p5_forms(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms}
ORACLES: dict[str, str] = {}
