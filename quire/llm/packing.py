"""Problem 7: filling containers of fixed capacity with texts of varying length.

The lengths are counted, and best-fit decreasing is planned over the counts: a plan names kinds of containers, what
lengths one of the kind holds, and how many there are. Documents then take the planned places by joining on their rank
within their length. The histogram has at most as many rows as the capacity, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import cut, parallelism

#: Parts of the documents within which ranks are numbered one by one; the parts' sizes are summed up before.
RANK_PARTS = 256


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int], int]]:
    """Best-fit decreasing over counts: [(number of containers, {length: items in each}, space left in each)].

    Lengths run from the longest down. Items go to the open containers with the least space that still fits them, many
    containers of a kind at once; where none fits, new ones open and take as many as fit. Every count is placed whole.
    """
    kinds: list[list] = []  # [containers, {length: items}, space left]
    open_by_space: dict[int, list[int]] = {}

    def split_off(k: int, n: int) -> int:
        """The index of a kind of ``n`` containers out of kind ``k``."""
        if kinds[k][0] == n:
            return k
        kinds[k][0] -= n
        kinds.append([n, dict(kinds[k][1]), kinds[k][2]])
        return len(kinds) - 1

    def put(k: int, length: int, each: int) -> None:
        kind = kinds[k]
        kind[1][length] = kind[1].get(length, 0) + each
        kind[2] -= length * each
        open_by_space.setdefault(kind[2], []).append(k)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit capacity {capacity}")
        for space in sorted(s for s in open_by_space if s >= length):
            stack = open_by_space.pop(space)
            while stack and left:
                k = stack.pop()
                each = min(space // length, left)  # one container after the other is filled up
                n = min(kinds[k][0], left // each)
                rest = kinds[k][0] - n
                used = split_off(k, n)
                if rest and used != k:
                    stack.append(k)
                put(used, length, each)
                left -= n * each
            if stack:
                open_by_space.setdefault(space, []).extend(stack)
            if not left:
                break
        while left:
            each = min(capacity // length, left)
            n = left // each
            kinds.append([n, {}, capacity])
            put(len(kinds) - 1, length, each)
            left -= n * each
    return [(n, held, space) for n, held, space in kinds if n]


def _ranked(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``, from 0 within its length, without sorting one length in one task."""
    d = items.withColumn("_part", F.pmod(F.xxhash64("item_id", "part_no"), F.lit(RANK_PARTS)))
    sizes = d.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy("item_id", "part_no")) - 1
    return d.withColumn("_in", within).join(sizes.hint("merge"), ["length", "_part"]).withColumn("rank", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def _places(spark: SparkSession, plan: list[tuple[int, dict[int, int], int]]) -> DataFrame:
    """Every planned place: (length, rank, container)."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for n, held, _ in plan:
        for length, each in held.items():
            rows.append((length, taken.get(length, 0), n * each, each, first))
            taken[length] = taken.get(length, 0) + n * each
        first += n
    names = ["length", "start", "number", "each", "first"]
    d = spark.createDataFrame(rows, T.StructType([T.StructField(c, T.LongType()) for c in names]))
    # a hot length may have a third of all places in one row of the plan: it is cut before it is unfolded
    step = 10_000
    d = d.where("number > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(number - 1) div {step}"))))
    d = d.repartition(max(2, parallelism(spark)), "length", "start", "chunk")
    d = d.withColumn("i", F.explode(F.expr(f"sequence(chunk * {step}, least(number, (chunk + 1) * {step}) - 1)")))
    return d.select("length", (F.col("start") + F.col("i")).alias("rank"), (F.col("first") + F.expr("i div each")).alias("container"))


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """Places of all items in containers: (container, item_id, part_no, n_parts, start_token, length).

    ``sizes`` has one row per item. An item above ``capacity`` is cut into full parts and a rest; no other is cut. The
    lengths in a container sum to ``capacity`` at most. Items of size 0 or null need no place and give no row. Equal
    ids are told apart by nothing, so ids must be unique. An empty input gives an empty result.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    spark = sizes.sparkSession
    d = sizes.where(F.col(size_col) > 0).select(F.col(id_col).alias("item_id"), F.col(size_col).cast("long").alias("size"))
    d = d.withColumn("n_parts", F.expr(f"cast((size + {capacity} - 1) div {capacity} as int)"))
    d = d.withColumn("part_no", F.explode(F.sequence(F.lit(1), F.col("n_parts"))))
    start = (F.col("part_no") - 1).cast("long") * capacity
    d = d.withColumns({"start_token": start, "length": F.least(F.lit(capacity).cast("long"), F.col("size") - start)}).drop("size")
    counts = d.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    # the sides grow with the documents, so they are merged whatever the planner guesses of their size
    plan = plan_best_fit({r["length"]: r["n"] for r in counts}, capacity)
    places = _places(spark, plan)
    return _ranked(d).join(places.hint("merge"), ["length", "rank"]).select("container", "item_id", "part_no", "n_parts", "start_token", "length")


def packed_documents(docs: DataFrame, capacities: list[tuple[int, int]], count_tokens) -> DataFrame:
    """``pack`` for several capacities, with pack_id; the tokens are counted once."""
    sizes = cut(count_tokens(docs))
    out = None
    for pack_id, capacity in capacities:
        d = pack(sizes, "doc_id", "n_tokens", capacity).withColumn("pack_id", F.lit(pack_id))
        out = d if out is None else out.unionByName(d)
    return out
