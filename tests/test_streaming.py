"""Streams run over what there is, and are compared with what a batch or a hand count gives."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from quire.sources.logs import read_log, tail_log
from quire.streaming import jobs as J

T0 = datetime(2031, 1, 1)


def stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


SCHEMA = "k string, t timestamp"
at = lambda s: T0 + timedelta(seconds=s)


def test_dedupe(spark, rows, tmp_path):
    s = stream(spark, tmp_path, [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(3)), ("c", at(4))]], SCHEMA)
    assert [r[0] for r in rows(J.once(J.dedupe(s, ["k"], "t"), "deduped", str(tmp_path / "cp")), "k")] == ["a", "b", "c"]


def test_token_bucket(spark, rows, tmp_path):
    s = stream(spark, tmp_path, [[("a", at(0)), ("a", at(0)), ("a", at(0)), ("b", at(0))], [("a", at(30)), ("a", at(31))]], SCHEMA)
    d = J.once(J.token_bucket(s, "k", "t", 2, 1 / 30), "bucket", str(tmp_path / "cp"))
    got = rows(d, "k", "allowed")
    assert got.count(("a", True)) == 3 and got.count(("a", False)) == 2 and got.count(("b", True)) == 1
    assert all(r.retry_after > 0 for r in d.where("not allowed").collect())


def test_stale_jobs(spark, rows, tmp_path):
    s = stream(spark, tmp_path, [[("a", at(0)), ("b", at(0))], [("b", at(1200))], [("c", at(1300))]], SCHEMA)
    d = J.once(J.stale_jobs(s, "k", "t", 15), "stale", str(tmp_path / "cp"))
    assert ("a", "failed") in rows(d, "k", "status") and ("b", "failed") not in rows(d, "k", "status")


def test_windows_and_sessions(spark, rows, tmp_path):
    batch = spark.createDataFrame([("a", at(0)), ("a", at(50)), ("a", at(70)), ("b", at(500))], SCHEMA)
    assert sorted(r.entries for r in J.windowed_counts(batch, "k", "t", "1 minute").collect()) == [1, 1, 2]
    assert sorted(r.entries for r in J.session_gaps(batch, "k", "t", "30 seconds").collect()) == [1, 1, 2]
    s = stream(spark, tmp_path, [[("a", at(0)), ("a", at(50))], [("a", at(70)), ("b", at(5000))]], SCHEMA)
    d = J.once(J.windowed_counts(s, "k", "t", "1 minute", late="10 seconds"), "windows", str(tmp_path / "cp"))
    assert sorted(r.entries for r in d.collect())[:2] == [1, 2]


def test_carry_over(spark, rows):
    states = spark.createDataFrame(
        [("a", 3, "v", '{"x": 1}'), ("b", 3, "old", "{}"), ("c", 3, "v", "{"), ("d", 3, "v", " "), ("e", 9, "v", '{"x": 1}')], "book_id string, chapter_index int, parser_version string, payload string"
    )
    chapters = spark.createDataFrame([(b, 4) for b in "abcdef"], "book_id string, chapter_index int")
    got = dict(rows(J.carry_over(states, chapters, "v"), "book_id", "reason"))
    assert got == {"a": "applied", "b": "version-mismatch", "c": "corrupt-payload", "d": "empty-payload", "e": "stale-chapter", "f": "no-row"}


def test_cache_and_ledger(spark, rows):
    want = spark.createDataFrame([("a", 1), ("b", 2)], "id string, mtime int")
    have = spark.createDataFrame([("a", 1), ("b", 1)], "id string, mtime int")
    assert rows(J.to_compute(want, have, ["id", "mtime"])) == [("b", 2)]
    ledger = spark.createDataFrame([("a", "done"), ("b", "failed")], "id string, status string")
    assert rows(J.unprocessed(want, ledger, ["id"]), "id") == [("b",)]


def test_logs(spark, rows, tmp_path):
    entry = lambda ts, m: json.dumps({"ts": ts, "level": "info", "stage": "s", "message": m, "meta": {"k": 1}})
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_text("\n".join([entry(2, "b"), "", "{broken", entry(1, "a"), entry(3, "c")]))
    assert rows(read_log(spark, str(tmp_path / "log"), 1), "entry", "message") == [(1, "a"), (2, "c")]  # offsets go by lines, not by time
    d = J.once(tail_log(spark, str(tmp_path / "log")), "tail", str(tmp_path / "cp"))
    assert sorted(r.message for r in d.collect()) == ["a", "b", "c"]
