"""Queries of problem 2, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.components import connected_components
from quire.session import read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = connected_components(read_table(spark, sf_dir, "merge_requests"), "survivor_id", "absorbed_id")
    return d.withColumnRenamed("id", "character_id")


QUERIES = {"p2_found": p2_found}
ORACLES = {
    "p2_found": """
with recursive pairs as (
  select distinct survivor_id a, absorbed_id b from merge_requests where survivor_id <> absorbed_id),
links as (select a, b from pairs union select b, a from pairs),
reach(id, root) as (
  select a, a from links
  union
  select l.b, r.root from reach r join links l on l.a = r.id where r.root < l.b)
select id as character_id, min(root) as group_id from reach group by id"""
}
