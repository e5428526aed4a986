"""Problem 6: full history of changing attributes, from snapshots that arrive late, twice or corrected.

``build_history`` makes the whole history; ``rebuild_chains`` answers late or corrected updates by rebuilding only the
entities they touch; ``HistoryStore`` keeps a history on disk and replaces chains atomically.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import checkpoint_dir

OPEN_END = "9999-12-31 00:00:00"


def _neighbour(df: DataFrame, key: str, chunk: str, at: str, value: Column, out: str, *, after: bool) -> DataFrame:
    """Adds ``out``: ``value`` of the row before (or after) within ``key`` in order of ``at``; null where there is none.

    A window over ``key`` alone would sort all rows of one hot key in one task. Here rows are windowed within
    (``key``, ``chunk``), and only one edge row per chunk travels to a window over ``key``.
    """
    df = df.withColumn("_v", value)
    inner = Window.partitionBy(key, chunk).orderBy(at)
    step = F.lead if after else F.lag
    df = df.withColumn("_n", step("_v").over(inner))
    edge = (F.min_by if after else F.max_by)(F.col("_v"), F.col(at))
    edges = df.groupBy(key, chunk).agg(edge.alias("_e"))
    edges = edges.withColumn("_o", step("_e").over(Window.partitionBy(key).orderBy(chunk))).drop("_e")
    return df.join(edges, [key, chunk]).withColumn(out, F.coalesce("_n", "_o")).drop("_v", "_n", "_o")


def build_history(
    raw: DataFrame, key: str, at: str, loaded: str, attrs: Sequence[str], tie: Sequence[str] = (), chunk: str = "month"
) -> DataFrame:
    """One row per state: ``key``, ``attrs``, ``valid_from``, ``valid_to`` (null for the state that still holds).

    Rows whose key or ``at`` is null are left out. Of several rows of one key and one ``at`` the latest ``loaded``
    counts; rows that tie on it are told apart by ``tie`` and then by their attributes, so any order of the input gives
    the same result. Exact repeats change nothing; null equals null; a state that returns starts a new period. An
    empty input gives an empty history. Other columns of ``raw`` are ignored, whatever their names.
    """
    names = {key: "_k", at: "_at", loaded: "_l"} | {a: f"_a{i}" for i, a in enumerate(attrs)} | {t: f"_t{i}" for i, t in enumerate(tie)}
    state = [f"_a{i}" for i in range(len(attrs))]
    d = raw.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(*[F.col(c).alias(n) for c, n in names.items()])
    order = F.struct("_l", *[f"_t{i}" for i in range(len(tie))], *state)
    d = d.groupBy("_k", "_at").agg(F.max_by(F.struct(*state), order).alias("_s"))
    d = d.withColumn("_c", F.date_trunc(chunk, F.col("_at").cast("timestamp")))
    d = _neighbour(d, "_k", "_c", "_at", F.col("_s"), "_before", after=False)
    d = d.where(F.col("_before").isNull() | ~F.col("_s").eqNullSafe(F.col("_before"))).drop("_before")
    d = _neighbour(d, "_k", "_c", "_at", F.col("_at"), "_to", after=True)
    return d.select(
        F.col("_k").alias(key),
        *[F.col(f"_s.{s}").alias(a) for s, a in zip(state, attrs, strict=True)],
        F.col("_at").alias("valid_from"),
        F.col("_to").alias("valid_to"),
    )


def rebuild_chains(
    history: DataFrame, raw: DataFrame, updates: DataFrame, key: str, at: str, loaded: str, attrs: Sequence[str], tie: Sequence[str] = (), chunk: str = "month"
) -> DataFrame:
    """The history after ``updates``: chains of entities with an update are rebuilt from all their raw rows.

    ``raw`` must already hold ``updates``. Untouched chains are taken over as they are. Updates without a key touch
    nothing; an update that changes nothing gives the same chain again.
    """
    touched = updates.where(F.col(key).isNotNull()).select(key).distinct()
    rebuilt = build_history(raw.join(touched, key, "left_semi"), key, at, loaded, attrs, tie, chunk)
    return history.join(touched, key, "left_anti").unionByName(rebuilt)


class HistoryStore:
    """A history on shared storage in hash buckets; a manifest names the folder of each bucket.

    An update writes the touched buckets to new folders and then publishes the next manifest, whose number must be
    free. A reader sees all of an update or nothing of it; an update that dies leaves only folders that no manifest
    names; of two updates at once the later one starts again from the manifest of the earlier. ``vacuum`` removes what
    no manifest needs any longer.
    """

    #: So often an update starts again if others were faster.
    TRIES = 20

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _hadoop(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return jvm, conf, jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        jvm, conf, path = self._hadoop()
        fs = path(self.path).getFileSystem(conf)
        if not fs.exists(path(self.path)):
            return []
        found = (re.fullmatch(r"manifest-(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(path(self.path)))
        return sorted(int(m[1]) for m in found if m)

    def _manifest(self, number: int | None = None) -> tuple[int, dict[str, str]]:
        """The number and the content of a manifest, by default the newest; 0 and nothing before the first."""
        if number is None:
            number = max(self._numbers(), default=0)
        if not number:
            return 0, {}
        return number, json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{number:09}.json").collect()))

    def _publish(self, number: int, manifest: dict[str, str]) -> bool:
        """Whether the manifest became number ``number``; False if another has that number."""
        jvm, conf, path = self._hadoop()
        new, here = path(f"{self.path}/.manifest.{uuid.uuid4().hex}.tmp"), path(f"{self.path}/manifest-{number:09}.json")
        fs = new.getFileSystem(conf)
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, here, options)
        except Exception as error:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> dict[str, str]:
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        out = df.withColumn("_bucket", self._bucket())
        out.repartition("_bucket", F.year("valid_from")).write.partitionBy("_bucket").parquet(folder)
        jvm, conf, path = self._hadoop()
        names = (f.getPath().getName() for f in path(folder).getFileSystem(conf).listStatus(path(folder)))
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def read(self) -> DataFrame | None:
        """The current history, or None before the first write."""
        folders = sorted(set(self._manifest()[1].values()))
        return self.spark.read.parquet(*folders) if folders else None

    def create(self, history: DataFrame) -> None:
        """The first history, in place of whatever is there."""
        written = self._write(history)
        while not self._publish(self._manifest()[0] + 1, written):
            pass

    def update(self, raw: DataFrame, updates: DataFrame, at: str, loaded: str, attrs: Sequence[str], tie: Sequence[str] = (), chunk: str = "month") -> None:
        """Rebuilds the chains of the entities in ``updates`` from ``raw`` and replaces them in one step."""
        hit = updates.where(F.col(self.key).isNotNull()).select(self._bucket().alias("b")).distinct().collect()  # at most self.buckets rows
        buckets = [str(r[0]) for r in hit]
        if not buckets:
            return
        number, manifest = self._manifest()
        for _ in range(self.TRIES):
            folders = [manifest[b] for b in buckets if b in manifest]
            scope = raw.where(self._bucket().isin([int(b) for b in buckets])) if len(buckets) < self.buckets else raw
            if folders:
                new = rebuild_chains(self.spark.read.parquet(*folders), scope, updates, self.key, at, loaded, attrs, tie, chunk)
            else:
                new = build_history(scope, self.key, at, loaded, attrs, tie, chunk)
            written = self._write(new)
            while not self._publish(number + 1, {k: v for k, v in manifest.items() if k not in buckets} | written):
                number, now = self._manifest()
                mine = any(now.get(b) != manifest.get(b) for b in buckets)
                manifest = now
                if mine:
                    break  # another update changed the same buckets: begin again from what it left
            else:
                return
        raise RuntimeError(f"{self.TRIES} other updates of the same buckets were faster")

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all manifests but the last ``keep``, and the folders that none of these name; no update may run meanwhile."""
        jvm, conf, path = self._hadoop()
        numbers = self._numbers()
        needed = {v.split("/_bucket=")[0].rsplit("/", 1)[-1] for n in numbers[-keep:] for v in self._manifest(n)[1].values()}
        fs = path(self.path).getFileSystem(conf)
        for n in numbers[:-keep]:
            fs.delete(path(f"{self.path}/manifest-{n:09}.json"), False)
        for s in fs.listStatus(path(self.path)):
            name = s.getPath().getName()
            if name.startswith("data-") and name not in needed:
                fs.delete(s.getPath(), True)


def bible_periods(snapshots: DataFrame, late_after: str = "1 day") -> DataFrame:
    """Periods of (version, source, description) of every character.

    Rows loaded within ``late_after`` of their snapshot make the first history of a store below the checkpoint folder;
    the rest are late or corrected updates, whose characters' chains are rebuilt from all their rows and replaced there.
    """
    spark = snapshots.sparkSession
    args = ("character_id", "taken_at", "loaded_at", ["version", "source", "description"], ["snapshot_id"])
    late = F.coalesce(F.col("loaded_at") > F.col("taken_at") + F.expr(f"interval {late_after}"), F.lit(True))
    store = HistoryStore(spark, f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex}", "character_id")
    store.create(build_history(snapshots.where(~late), *args))
    store.update(snapshots, snapshots.where(late), *args[1:])
    history = store.read()
    return history.drop("_bucket") if history is not None else build_history(snapshots, *args)
