"""Queue-like processing on streams: dedupe, rate limits, stale jobs, carried state, caches and ledgers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedupe(stream: DataFrame, key: list[str], at: str, within: str = "1 hour") -> DataFrame:
    """The first entry of each key; the state of a key is dropped once the watermark is ``within`` past it."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def token_bucket(stream: DataFrame, key: str, at: str, capacity: float, per_second: float) -> DataFrame:
    """(key, at, allowed, tokens, retry_after): each entry takes one token of its key's bucket, which refills steadily.

    Entries of a batch are taken by time; an entry older than the last one seen of its key finds the bucket as it is.
    """
    schema = f"{key} string, at double, allowed boolean, tokens double, retry_after double"

    def take(k: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = kept.get if kept.exists else (float(capacity), None)
        rows = []
        for now in sorted(t for part in parts for t in part["at"].tolist()):
            if last is not None and now > last:
                tokens = min(capacity, tokens + (now - last) * per_second)
            last = now if last is None else max(last, now)
            allowed = tokens >= 1
            tokens -= allowed
            rows.append((k[0], now, allowed, tokens, 0.0 if allowed else (1 - tokens) / per_second))
        kept.update((tokens, last))
        yield pd.DataFrame(rows, columns=[key, "at", "allowed", "tokens", "retry_after"])

    d = stream.select(F.col(key).cast("string").alias(key), F.unix_micros(F.col(at).cast("timestamp")).cast("double").alias("u")).select(key, (F.col("u") / 1e6).alias("at"))
    return d.groupBy(key).applyInPandasWithState(take, schema, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def stale_jobs(stream: DataFrame, key: str, at: str, minutes: int = 15, late: str = "0 seconds") -> DataFrame:
    """(key, status, last): a row when a job has had no news for ``minutes`` of event time."""
    schema = f"{key} string, status string, last double"

    def watch(k: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            (last,) = kept.get
            kept.remove()
            yield pd.DataFrame([(k[0], "failed", last)], columns=[key, "status", "last"])
            return
        last = max([t for part in parts for t in part["u"].tolist()] + ([kept.get[0]] if kept.exists else []))
        kept.update((last,))
        kept.setTimeoutTimestamp(max(int(last * 1000) + minutes * 60_000, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=[key, "status", "last"])

    d = stream.select(F.col(key).cast("string").alias(key), F.col(at).cast("timestamp").alias("t")).withWatermark("t", late)
    d = d.withColumn("u", F.unix_micros("t") / 1e6)
    return d.groupBy(key).applyInPandasWithState(watch, schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, key: str, at: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Entries per key and window of event time, tumbling or sliding; an extension, the reference has none."""
    t = F.col(at).cast("timestamp")
    d = stream.withColumn("_t", t).withWatermark("_t", late)
    return d.groupBy(F.window("_t", width, slide) if slide else F.window("_t", width), key).agg(F.count(F.lit(1)).alias("entries"))


def session_gaps(stream: DataFrame, key: str, at: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of entries of one key without a gap longer than ``gap``."""
    d = stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    return d.groupBy(F.session_window("_t", gap), key).agg(F.count(F.lit(1)).alias("entries"))


def carry_over(states: DataFrame, chapters: DataFrame, version: str) -> DataFrame:
    """Per chapter what becomes of the state saved for its book: 'applied' or why not.

    ``states`` has book_id, chapter_index, parser_version, payload (JSON); ``chapters`` book_id and chapter_index.
    """
    s = states.select("book_id", F.col("chapter_index").alias("_at"), F.col("parser_version").alias("_v"), F.col("payload").alias("_p"))
    d = chapters.join(s, "book_id", "left")
    parsed = F.expr("try_parse_json(_p)")
    reason = (
        F.when(F.col("_at").isNull(), "no-row").when(~F.col("_v").eqNullSafe(F.lit(version)), "version-mismatch").when(F.col("_at") >= F.col("chapter_index"), "stale-chapter")
        .when(F.coalesce(F.trim("_p"), F.lit("")).isin("", "{}", "null"), "empty-payload").when(parsed.isNull(), "corrupt-payload").otherwise("applied")
    )
    return d.select(*chapters.columns, reason.alias("reason"), F.when(reason == "applied", F.col("_p")).alias("state"))


def to_compute(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What the cache doesn't hold under the same keys (such as id, time of change and parser version)."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def unprocessed(chapters: DataFrame, ledger: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """What no entry of the ledger has finished."""
    return chapters.join(ledger.where(F.col(status) == "done").select(*keys).distinct(), keys, "left_anti")


def progress(rows: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100.0 * rows / total)).otherwise(F.lit(0.0))


def once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what there is and stops; the result is the in-memory table ``name`` (for tests and small sinks)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def payload(state: dict) -> str:
    return json.dumps(state, ensure_ascii=False, sort_keys=True)
