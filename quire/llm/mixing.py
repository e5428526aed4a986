"""Problem 8: mixing sources to target shares of the total size.

Documents are hashed into blocks of their source, of which a source has as many as its size asks for. Exact quotas of
blocks per source follow from the targets; a tree splits them among the output shards, each split a multivariate
hypergeometric draw, so that every shard gets what a random deal of all blocks would give it. Each shard then takes
its own stretch of the permuted blocks of each source and is shuffled by itself. The driver holds totals per source
only: blocks, their permutation and the shards' counts are tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

#: Sources that the table of targets may name: a parameter table, whose totals the driver holds.
MOST_SOURCES = 100_000
#: Tokens that a block should have, and a shard; a source has so many blocks a shard at least.
BLOCK_TOKENS, SHARD_TOKENS, BLOCKS_A_SHARD = 65_536, 32_000_000, 16
#: Blocks that are numbered within one task.
RANKED = 20_000


@dataclass
class Quota:
    source: str
    tokens: int  # of all its documents
    share: float  # target among the sources that have documents
    quota: int  # tokens to take
    passes: int  # whole passes over the source
    rest: int  # tokens of the last pass, which is partial


def quotas(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> list[Quota]:
    """The largest mix that keeps all target shares: what each source gives to it.

    Sources without documents or with a target of 0 cannot give anything; the targets of the others are taken in
    proportion to each other. The source that runs out first at its ``max_repeats`` sets the size.
    """
    there = {s: t for s, t in targets.items() if tokens.get(s, 0) > 0 and t[0] > 0 and t[1] > 0}
    whole = sum(share for share, _ in there.values())
    if not there:
        return []
    total = min(tokens[s] * repeats * whole / share for s, (share, repeats) in there.items())
    out = []
    for s, (share, repeats) in sorted(there.items()):
        quota = min(tokens[s] * repeats, round(total * share / whole))
        out.append(Quota(s, tokens[s], share / whole, quota, quota // tokens[s], quota % tokens[s]))
    return out


def _draw(counts: list[int], share: tuple[int, int], rng: np.random.Generator) -> list[int]:
    """A part of ``share`` of all, drawn without replacement; of more than a draw can hold all but a rest goes in proportion."""
    part, whole = share
    total = sum(counts)
    if not total:
        return [0] * len(counts)
    wanted = total * part // whole
    sure = [0] * len(counts)
    if total >= 900_000_000:
        sure = [max(0, c * part // whole - 1000) for c in counts]
        counts, wanted = [min(2000, c - s) for c, s in zip(counts, sure, strict=True)], wanted - sum(sure)
        wanted = min(max(wanted, 0), sum(counts))
    drawn = rng.multivariate_hypergeometric(counts, wanted, method="marginals")
    return [s + int(d) for s, d in zip(sure, drawn, strict=True)]


def split_tree(counts: list[int], shards: int, rng: np.random.Generator) -> list[list[int]]:
    """Counts per shard: each half of the tree draws its part without replacement from what its parent has."""
    if shards == 1:
        return [list(counts)]
    left = shards // 2
    drawn = _draw(counts, (left, shards), rng)
    rest = [c - d for c, d in zip(counts, drawn, strict=True)]
    return split_tree(drawn, left, rng) + split_tree(rest, shards - left, rng)


def split_range(counts: list[int], shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """The same tree for the shards from ``first`` to before ``last``: (shard, counts before it, its counts).

    Every node draws by its own seed, so any range of shards can be computed by itself.
    """
    todo = [(0, shards, list(counts), [0] * len(counts))]
    while todo:
        low, high, own, before = todo.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, before, own
            continue
        middle = low + (high - low) // 2
        drawn = _draw(own, (middle - low, high - low), np.random.default_rng([seed, low, high]))
        rest = [c - d for c, d in zip(own, drawn, strict=True)]
        todo.append((middle, high, rest, [b + d for b, d in zip(before, drawn, strict=True)]))
        todo.append((low, middle, drawn, before))


def _small(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return rows


def _placed(d: DataFrame, group: str, order: list[Column], measure: Column, parts: int) -> DataFrame:
    """``d`` with ``before``: the sum of ``measure`` over the rows of the group before it in a random order.

    The order goes by ``order``, a hash first; parts of the hash range are summed up by themselves, so no group is
    sorted in one task.
    """
    place = F.floor((order[0] / F.lit(2.0**64) + 0.5) * parts)
    d = d.withColumn("_part", F.least(F.greatest(place, F.lit(0)), F.lit(parts - 1))).withColumn("_m", measure)
    sums = d.groupBy(group, "_part").agg(F.sum("_m").alias("_s"))
    earlier = F.sum("_s").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(group, "_part", F.coalesce(earlier, F.lit(0)).alias("_b"))
    within = F.sum("_m").over(Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_w", F.coalesce(within, F.lit(0))).join(sums, [group, "_part"])
    return d.withColumn("before", F.col("_b") + F.col("_w")).drop("_part", "_m", "_w", "_b")


def mix(sizes: DataFrame, targets: DataFrame, *, seed: int = 7, shards: int | None = None) -> DataFrame:
    """The mix: (doc_id, source, repeat, shard, position, n_tokens), one row per use of a document.

    ``sizes`` has doc_id (unique), source and n_tokens; ``targets`` has source, target_share and max_repeats, one row
    per source. Documents of sources without target, of a null source, or without tokens are not used. A document is
    used ``max_repeats`` times at most; within a pass over its source it is used once. Shares are met up to one
    document per source. Empty inputs give an empty mix. The same seed gives the same mix.
    """
    spark = sizes.sparkSession
    d = sizes.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens"))
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in _small(targets, MOST_SOURCES) if r["source"] is not None}
    wished = spark.createDataFrame([(s,) for s in sorted(goal)], "source string")
    totals = {r["source"]: r["t"] for r in _small(d.groupBy("source").agg(F.sum("n_tokens").alias("t")).join(wished, "source", "left_semi"), MOST_SOURCES)}
    plan = quotas(totals, goal)
    n = shards or max(1, math.ceil(sum(q.quota for q in plan) / SHARD_TOKENS))
    number = {q.source: max(BLOCKS_A_SHARD * n, math.ceil(q.tokens / BLOCK_TOKENS)) for q in plan}
    rows = [(q.source, number[q.source], q.passes, q.rest) for q in plan]
    planned = spark.createDataFrame(rows, "source string, blocks long, passes long, rest long")
    d = d.join(planned.select("source", "blocks"), "source")
    d = d.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks"))).drop("blocks")
    parts = max(1, math.ceil(max(number.values(), default=1) / RANKED))
    # blocks with their uses: every whole pass takes all, the partial one the first of a random order
    blocks = cut(d.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    there = blocks.join(planned.select("source", "passes", "rest"), "source")
    whole = there.where("passes > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))).alias("repeat"), F.lit(None).cast("long").alias("take"))
    last = _placed(there.where("rest > 0"), "source", [F.xxhash64(F.lit(seed + 3), "block"), F.col("block")], F.col("tokens"), parts).where("before < rest")
    left = F.col("rest") - F.col("before")
    last = last.select("source", "block", (F.col("passes") + 1).cast("int").alias("repeat"), F.when(F.col("tokens") > left, left).alias("take"))
    uses = cut(whole.unionByName(last))
    counts = {r["source"]: r["n"] for r in uses.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_SOURCES rows
    permuted = _placed(uses, "source", [F.xxhash64(F.lit(seed + 4), "block", "repeat"), F.col("block"), F.col("repeat")], F.lit(1), max(1, math.ceil(max(counts.values(), default=1) / RANKED)))
    names = sorted(counts)
    drawn = _stretches(spark, names, [counts[s] for s in names], n, seed)
    dealt = permuted.withColumnRenamed("before", "rank").join(drawn, ["source", "rank"]).select("source", "block", "repeat", "take", "shard")
    dealt = cut(dealt)

    whole = d.join(dealt.where("take is null").drop("take"), ["source", "block"])
    # of the last block of a source only the first documents of a random order are taken
    part = d.join(dealt.where("take is not null"), ["source", "block"])
    order = Window.partitionBy("source", "block", "repeat").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    so_far = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("so_far", so_far).where("so_far - n_tokens / 2 <= take").drop("so_far", "take")
    out = whole.unionByName(part)
    place = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "repeat"), "doc_id", "repeat")
    return out.withColumn("position", F.row_number().over(place)).select("doc_id", "source", "repeat", "shard", "position", "n_tokens")


def _stretches(spark, names: list[str], counts: list[int], shards: int, seed: int) -> DataFrame:
    """Every rank of the permuted block uses of every source, and the shard that takes it: (source, rank, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(s, before[k], own[k], shard) for shard, before, own in split_range(counts, shards, min(ids), max(ids) + 1, seed) for k, s in enumerate(names) if own[k]] if ids else []
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["source", "start", "number", "shard"])

    d = spark.range(shards).mapInArrow(run, "source string, start long, number long, shard int")  # ids of a batch are a range
    return d.select("source", F.explode(F.expr("sequence(start, start + number - 1)")).alias("rank"), "shard")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source reached: (source, target_share, max_repeats, documents, uses, most_uses, tokens, share)."""
    d = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("u"), F.sum("n_tokens").alias("t"))
    d = d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("u").alias("uses"), F.max("u").alias("most_uses"), F.sum("t").alias("tokens"))
    d = targets.select("source", "target_share", "max_repeats").join(d, "source", "left")  # one row per source
    d = d.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("documents", "uses", "most_uses", "tokens")}
    return d.withColumns(filled).withColumn("share", F.round(F.col("tokens") / F.col("total"), 6)).drop("total")


def mixed_documents(docs: DataFrame, targets: DataFrame, count_tokens, *, seed: int = 7, shards: int | None = None) -> DataFrame:
    return mix(cut(count_tokens(docs)), targets, seed=seed, shards=shards)
