"""Relational building blocks: search, top-k, running sums, upserts, layered settings, status summaries.

All of them are lazy DataFrame compositions; none collects rows or fixes a join strategy, so Catalyst and AQE choose.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_ci(column: str, text: str) -> Column:
    """Whether the column contains ``text``, whatever the case of letters; null where the column is null."""
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def search(df: DataFrame, equals: Mapping[str, object] | None = None, contains: Mapping[str, str] | None = None, any_contains: tuple[Sequence[str], str] | None = None) -> DataFrame:
    """Rows that meet all given filters; filters that are None or empty are left out."""
    for column, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(column) == value)
    for column, text in (contains or {}).items():
        if text:
            df = df.where(contains_ci(column, text))
    if any_contains and any_contains[1]:
        columns, text = any_contains
        hit = F.lit(False)
        for column in columns:
            hit = hit | F.coalesce(contains_ci(column, text), F.lit(False))
        df = df.where(hit)
    return df


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order``, with their rank from 1.

    The order must be total for a reproducible result. Spark keeps at most k rows per group and task before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (nulls least); partial aggregation, no sort of a key's rows."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_m"))
    return picked.select(*key, *[F.col(f"_m._row.{c}").alias(c) for c in rest])


def running_offsets(df: DataFrame, group: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """``start_ms`` and ``end_ms`` of rows laid one after another; rows without a positive size are left out."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(size).over(w)
    return df.where(F.col(size) > 0).withColumns({"end_ms": end, "start_ms": end - F.col(size)})


def first_not_null(*columns: str) -> Column:
    """Layered settings: the first that is not null; an empty string counts as set."""
    return F.coalesce(*[F.col(c) for c in columns])


def merge_counters(old: DataFrame, new: DataFrame, key: str, count: str, seen: str) -> DataFrame:
    """Insert or increment: counts add up, ``seen`` becomes the later one. Null keys are left out on both sides."""
    both = old.select(key, count, seen).unionByName(new.select(key, count, seen)).where(F.col(key).isNotNull())
    return both.groupBy(key).agg(F.sum(count).alias(count), F.max(seen).alias(seen))


def touch_counters(old: DataFrame, hits: DataFrame, key: str, count: str) -> DataFrame:
    """Increment only keys that exist: ``hits`` has key and count."""
    added = hits.groupBy(key).agg(F.sum(count).alias("_add"))
    return old.join(added, key, "left").withColumn(count, F.col(count) + F.coalesce("_add", F.lit(0))).drop("_add")


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet, each key once."""
    fresh = new.select(*old.columns).dropDuplicates(list(key)).join(old.select(*key).distinct(), list(key), "left_anti")
    return old.unionByName(fresh)


def status_counts(df: DataFrame, group: Sequence[str], status: str, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per group the number of rows, and for each kind that of rows whose status is one of its values."""
    counts = [F.count_if(F.col(status).isin(list(values))).alias(name) for name, values in kinds.items()]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *counts)


def missing_numbers(have: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """Numbers from 1 to the group's largest that it does not have."""
    planned = have.groupBy(*group).agg(F.max(number).alias("_m")).where(F.col("_m") >= 1)
    planned = planned.select(*group, F.explode(F.sequence(F.lit(1), F.col("_m"))).alias(number))
    return planned.join(have.select(*group, number).distinct(), [*group, number], "left_anti")


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """The ends of an edge as ``low`` and ``high``; edges with a null end are left out."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})


def evenly_spaced(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows per group at even distances in ``order``, the first and the last among them; all if there are fewer."""
    by = Window.partitionBy(*group)
    d = df.withColumns({"_i": F.row_number().over(by.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(by)})
    if k == 1:
        return d.where("_i = 0").drop("_i", "_n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (k - 1)))
    return d.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i").cast("long"))).drop("_i", "_n")


def islands(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal values (null equals null): (group, run, value, rows)."""
    w = Window.partitionBy(*group).orderBy(*order)
    first = F.row_number().over(w) == 1
    changed = (first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    d = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*group, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("rows"))
