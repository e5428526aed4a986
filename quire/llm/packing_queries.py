"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.batches import small_batches
from quire.llm.packing import packed_documents
from quire.llm.tokens import with_tokens
from quire.session import read_table

#: Rows that the small table of capacities may have.
MOST_CAPACITIES = 100


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = read_table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity_tokens").limit(MOST_CAPACITIES + 1).collect()
    if len(rows) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    capacities = sorted((r[0], r[1]) for r in rows)
    return packed_documents(read_table(spark, sf_dir, "documents"), capacities, lambda d: with_tokens(d, "doc_id", "text"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("pack_id", "container", F.col("item_id").alias("doc_id"), "part_no", "n_parts", "start_token", "length")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    d = _packed(spark, sf_dir).groupBy("pack_id", "container").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("items"))
    sizes = read_table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity_tokens")
    d = d.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("items").alias("items"))
    return d.join(F.broadcast(sizes), "pack_id").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
ORACLES: dict[str, str] = {}
