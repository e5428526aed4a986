"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import small_batches
from quire.llm.splitting import split_oversized
from quire.session import read_table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = read_table(spark, sf_dir, "chapters").select(
        F.lit("chapter").alias("item_kind"), F.col("chapter_id").alias("item_id"), F.col("html").alias("body"), F.lit(True).alias("markup")
    )
    requests = read_table(spark, sf_dir, "synth_requests").select(
        F.lit("request").alias("item_kind"), F.col("request_id").alias("item_id"), F.col("text").alias("body"), F.lit(False).alias("markup")
    )
    return chapters.unionAll(requests)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return split_oversized(_items(spark, sf_dir), read_table(spark, sf_dir, "piece_limits"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pieces = split_oversized(_items(spark, sf_dir), read_table(spark, sf_dir, "piece_limits"), only_oversized=True)
    return pieces.where("n_pieces > 1 and piece_no = 1").select("item_kind", "item_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLES: dict[str, str] = {}
