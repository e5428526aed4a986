"""Problem 2: consolidating pairwise matches into groups.

Edges lie in a two-dimensional grid: vertices are hashed into blocks, and an edge goes to the cell (block of one end,
block of the other). Every cell runs union-find on its own edges; each vertex then takes the least representative that
any cell of its row or column found for it, and the representatives that cells disagree on become the edges of the
next round. A vertex with a third of all edges is spread over a whole row of cells.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut, shuffled

#: Edges that one cell should hold at most, a hot row included; sets the number of blocks.
CELL_EDGES = 500_000
#: Blocks at least, so that the grid is the same way of working at every size.
LEAST_BLOCKS = 3


def _cell(table: pa.Table) -> pa.Table:
    """Union-find in one cell: rows (vertex, rep, rank); rep is the member of the least rank, a hash that changes by round."""
    parent: dict[str, str] = {}
    rank: dict[str, int] = {}

    def find(x: str) -> str:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for u, v, ru, rv in zip(*(table.column(c).to_pylist() for c in ("u", "v", "ru", "rv")), strict=True):
        if u not in parent:
            parent[u], rank[u] = u, ru
        if v not in parent:
            parent[v], rank[v] = v, rv
        a, b = find(u), find(v)
        if a != b:
            if (rank[b], b) < (rank[a], a):
                a, b = b, a
            parent[b] = a
    reps = [find(x) for x in parent]
    ranks = [rank[r] for r in reps]
    return pa.table({"vertex": pa.array(list(parent), pa.string()), "rep": pa.array(reps, pa.string()), "rank": pa.array(ranks, pa.int64())})


def _rank(c: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(c))


def _round(edges: DataFrame, count: int, seed: int, least_blocks: int) -> DataFrame:
    """Per vertex of the present edges the representatives that cells found: (vertex, rep, rank)."""
    blocks = max(least_blocks, math.ceil(math.sqrt(count / CELL_EDGES)))
    if count > blocks * CELL_EDGES:  # else no vertex can fill more than a row of cells
        ends = edges.select("u").unionAll(edges.select("v"))
        blocks = max(blocks, math.ceil(ends.groupBy("u").count().agg(F.max("count")).first()[0] / CELL_EDGES))
    place = lambda c: F.pmod(F.xxhash64(F.lit(7919), F.col(c)), F.lit(blocks).cast("long"))
    d = edges.select("u", "v", _rank("u", seed).alias("ru"), _rank("v", seed).alias("rv"), place("u").alias("row"), place("v").alias("col"))
    return d.groupBy("row", "col").applyInArrow(_cell, "vertex string, rep string, rank bigint")


def connected_components(pairs: DataFrame, left: str, right: str, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """Rows (id, group_id): every id of a pair of two different ids, neither null, with the least id of its group.

    Ids are strings and compare by code point. Pairs may repeat, be reversed or hold an id twice; pairs with a null
    and pairs of an id with itself are ignored, so an id that has no others gives no row. An empty input gives an
    empty result. Other columns are ignored.
    """
    a, b = F.col(left).cast("string"), F.col(right).cast("string")
    edges = pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    edges = cut(edges)
    labels = None
    seed = 0
    while count := edges.count():
        found = cut(_round(edges, count, seed, least_blocks))
        # Row and column representatives meet: a vertex takes the least of them, and at once that one's own.
        best = found.groupBy("vertex").agg(F.min(F.struct("rank", "rep")).alias("m")).select("vertex", F.col("m.rep").alias("to"))
        onward = best.select(F.col("vertex").alias("to"), F.col("to").alias("far"))
        jump = cut(shuffled(best, onward, "to", "left").select("vertex", F.coalesce("far", "to").alias("label")))
        # Where cells disagree, the new parents are linked in the next round.
        ends = jump.select(F.col("vertex").alias("rep"), F.col("label").alias("b"))
        nxt = shuffled(found.where("vertex <> rep"), jump, "vertex").select("label", "rep").distinct()
        nxt = shuffled(nxt, ends, "rep").where("label <> b")
        nxt = cut(nxt.select(F.least("label", "b").alias("u"), F.greatest("label", "b").alias("v")).distinct())
        if labels is None:
            labels = jump
        else:
            move = jump.select(F.col("vertex").alias("label"), F.col("label").alias("moved"))
            labels = cut(shuffled(labels, move, "label", "left").select("vertex", F.coalesce("moved", "label").alias("label")))
        edges, seed = nxt, seed + 1
    if labels is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    least = labels.groupBy("label").agg(F.min("vertex").alias("least"))
    return shuffled(labels, least, "label").select(F.col("vertex").alias("id"), F.col("least").alias("group_id"))


def brute_force_components(pairs: pd.DataFrame, left: str, right: str) -> dict[str, str]:
    """The same on one machine, for tests."""
    near: dict[str, set[str]] = {}
    for a, b in zip(pairs[left], pairs[right], strict=True):
        if isinstance(a, str) and isinstance(b, str) and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    group: dict[str, str] = {}
    for start in sorted(near):
        if start in group:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = start
                todo += near[x]
    return group
