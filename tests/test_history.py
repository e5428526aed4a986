"""Problem 6 on small tables."""

from __future__ import annotations

from datetime import datetime

import pytest

from quire.operators.history import HistoryStore, bible_periods, build_history, rebuild_chains
from quire.plans.history_queries import ORACLES, QUERIES
from tests.oracles import compare, connect

T = lambda d, h=0: datetime(2031, 1, d, h)
SCHEMA = "character_id string, taken_at timestamp_ntz, loaded_at timestamp_ntz, version int, source string, description string, snapshot_id string, valid_from string"
ARGS = ("character_id", "taken_at", "loaded_at", ["version", "source", "description"], ["snapshot_id"])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


ROWS = [
    ("a", T(1), T(1, 1), 1, "llm", "x", "s1"),
    ("a", T(1), T(1, 1), 1, "llm", "x", "s1"),  # repeated
    ("a", T(2), T(2, 1), 1, "llm", "x", "s2"),
    ("a", T(3), T(9), None, "llm", None, "s3"),  # late, nulls
    ("a", T(4), T(4, 1), None, "llm", None, "s4"),
    ("a", T(5), T(5, 1), 1, "llm", "x", "s5"),  # returns
    ("b", T(1), T(1, 1), 1, "llm", "old", "s6"),
    ("b", T(1), T(7), 1, "llm", "new", "s7"),  # sent again
    (None, T(1), T(1), 1, "llm", "x", "s8"),
    ("c", None, T(1), 1, "llm", "x", "s9"),
]
WANTED = [("a", 1, "x", T(1), T(3)), ("a", None, None, T(3), T(5)), ("a", 1, "x", T(5), None), ("b", 1, "new", T(1), None)]


def periods(df):
    return sorted(((r.character_id, r.version, r.description, r.valid_from, r.valid_to) for r in df.collect()), key=lambda r: (r[0], r[3]))


@pytest.mark.parametrize("chunk", ["day", "month", "year"])
def test_periods_whatever_the_chunks(spark, chunk):
    assert periods(build_history(table(spark, ROWS), *ARGS, chunk=chunk)) == WANTED


def test_order_and_partitions_do_not_matter(spark):
    assert periods(build_history(table(spark, ROWS[::-1]).repartition(7), *ARGS)) == WANTED


def test_late_rows_rebuild_only_their_chains(spark):
    assert periods(bible_periods(table(spark, ROWS))) == WANTED
    before = build_history(table(spark, ROWS[:2] + ROWS[6:7]), *ARGS)
    after = rebuild_chains(before, table(spark, ROWS), table(spark, ROWS[3:4]), *ARGS)
    got = periods(after)
    assert [r for r in got if r[0] == "a"] == WANTED[:3]
    assert [r for r in got if r[0] == "b"] == [("b", 1, "old", T(1), None)]  # not touched, so as it was


def test_empty(spark):
    assert build_history(table(spark, []), *ARGS).count() == 0
    assert bible_periods(table(spark, [])).count() == 0


def test_store_replaces_chains_at_once(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), "character_id", buckets=4)
    assert store.read() is None
    raw = table(spark, ROWS[:3] + ROWS[6:7])
    store.create(build_history(raw, *ARGS))
    store.update(table(spark, ROWS), table(spark, ROWS[3:6] + ROWS[7:8]), *ARGS[1:])
    assert periods(store.read()) == WANTED
    store.update(table(spark, ROWS), table(spark, []), *ARGS[1:])
    assert periods(store.read()) == WANTED


def test_queries(spark, sf):
    con = connect(sf)
    for name, sql in ORACLES.items():
        compare(con, QUERIES[name](spark, sf), sql)


def test_two_updates_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    """Another update is published between the reading and the publishing of one; both must be there in the end."""
    store = HistoryStore(spark, str(tmp_path / "h"), "character_id", buckets=1)
    store.create(build_history(table(spark, ROWS[:3] + ROWS[6:7]), *ARGS))
    other = HistoryStore(spark, str(tmp_path / "h"), "character_id", buckets=1)
    write, first = store._write, []

    def meanwhile(df):
        out = write(df)
        if not first:
            first.append(1)
            other.update(table(spark, ROWS), table(spark, ROWS[7:8]), *ARGS[1:])
        return out

    monkeypatch.setattr(store, "_write", meanwhile)
    store.update(table(spark, ROWS), table(spark, ROWS[3:6]), *ARGS[1:])
    assert periods(store.read()) == WANTED
    store.vacuum()
    assert periods(store.read()) == WANTED and len([p for p in (tmp_path / "h").iterdir() if p.name.startswith("data-")]) == 1
