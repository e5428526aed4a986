"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.names import entity_pairs, same_entities
from quire.session import read_table


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read_table(spark, sf_dir, "characters").select("book_id", F.col("character_id").alias("record"), "name", "aliases")
    typed = read_table(spark, sf_dir, "character_inputs").select("book_id", F.col("input_id").alias("record"), "name", "aliases")
    return same_entities(known.unionAll(typed))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_pairs(p4_groups(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
ORACLES: dict[str, str] = {}
