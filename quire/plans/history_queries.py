"""Queries of problem 6, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.history import OPEN_END, bible_periods
from quire.session import read_table

STAMP = "yyyy-MM-dd HH:mm:ss"


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bible_periods(read_table(spark, sf_dir, "bible_snapshots"))
    return d.select(
        "character_id",
        F.date_format("valid_from", STAMP).alias("valid_from"),
        F.coalesce(F.date_format("valid_to", STAMP), F.lit(OPEN_END)).alias("valid_to"),
    ).distinct()


def p6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = bible_periods(read_table(spark, sf_dir, "bible_snapshots"))
    return d.withColumns(
        {
            "valid_from": F.date_format("valid_from", STAMP),
            "valid_to": F.coalesce(F.date_format("valid_to", STAMP), F.lit(OPEN_END)),
        }
    )


_PERIODS = """
with one as (
  select character_id, taken_at, version, source, description,
         row_number() over (partition by character_id, taken_at
           order by loaded_at desc nulls last, snapshot_id desc nulls last, version desc nulls last,
                    source desc nulls last, description desc nulls last) as rn
  from bible_snapshots where character_id is not null and taken_at is not null),
seen as (
  select *, lag(taken_at) over w as before_at, lag(version) over w as v0, lag(source) over w as s0,
         lag(description) over w as d0
  from one where rn = 1 window w as (partition by character_id order by taken_at)),
starts as (
  select * from seen where before_at is null or version is distinct from v0 or source is distinct from s0
     or description is distinct from d0)
"""

QUERIES = {"p6_found": p6_found, "p6_history": p6_history}
ORACLES = {
    "p6_found": _PERIODS
    + """
select distinct character_id, strftime(taken_at, '%Y-%m-%d %H:%M:%S') as valid_from,
  coalesce(strftime(lead(taken_at) over (partition by character_id order by taken_at), '%Y-%m-%d %H:%M:%S'),
           '9999-12-31 00:00:00') as valid_to
from starts""",
    "p6_history": _PERIODS
    + """
select character_id, version, source, description, strftime(taken_at, '%Y-%m-%d %H:%M:%S') as valid_from,
  coalesce(strftime(lead(taken_at) over (partition by character_id order by taken_at), '%Y-%m-%d %H:%M:%S'),
           '9999-12-31 00:00:00') as valid_to
from starts""",
}
