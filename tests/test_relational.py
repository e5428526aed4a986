"""Relational operators on small tables: nulls, ties, empty tables, repeated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import relational as R


def test_search(spark, rows):
    d = spark.createDataFrame([("Ánh Trăng", "x", "vi"), ("moon", None, "en"), (None, "MOON", "en")], "title string, author string, language string")
    assert R.search(d, {"language": None}, {"title": ""}, (["title", "author"], "moon")).count() == 2
    assert R.search(d, {"language": "vi"}).count() == 1
    assert R.search(d, any_contains=(["title"], "%")).count() == 0  # no wildcard


def test_top_and_latest(spark, rows):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, None), ("b", None, "z")], "g string, n int, rank_ string")
    assert rows(R.top_per_group(d, ["g"], [F.desc("n")], 2), "g", "n", "rank") == [("a", 2, 2), ("a", 3, 1), ("b", None, 1)]
    assert rows(R.latest_per_key(d, ["g"], ["n"])) == [("a", 3, "y"), ("b", None, "z")]
    assert R.latest_per_key(d.limit(0), ["g"], ["n"]).count() == 0


def test_offsets(spark, rows):
    d = spark.createDataFrame([("a", 1, 10), ("a", 2, 0), ("a", 3, 5), ("a", 4, None)], "g string, i int, ms long")
    assert rows(R.running_offsets(d, ["g"], ["i"], "ms"), "i", "start_ms", "end_ms") == [(1, 0, 10), (3, 10, 15)]


def test_counters(spark, rows):
    old = spark.createDataFrame([("p", 2, 1), ("q", 1, 1)], "phrase string, hits long, seen long")
    new = spark.createDataFrame([("p", 1, 5), ("r", 1, 5), (None, 1, 5)], "phrase string, hits long, seen long")
    assert rows(R.merge_counters(old, new, "phrase", "hits", "seen")) == [("p", 3, 5), ("q", 1, 1), ("r", 1, 5)]
    assert rows(R.touch_counters(old, new, "phrase", "hits"), "phrase", "hits") == [("p", 3), ("q", 1)]
    assert rows(R.insert_or_ignore(old, new.where("phrase is not null"), ["phrase"]), "phrase", "hits") == [("p", 2), ("q", 1), ("r", 1)]


def test_missing_and_even(spark, rows):
    d = spark.createDataFrame([("a", 1), ("a", 4), ("b", 1)], "g string, n int")
    assert rows(R.missing_numbers(d, ["g"], "n")) == [("a", 2), ("a", 3)]
    e = spark.createDataFrame([("a", i) for i in range(10)], "g string, n int")
    assert [r[1] for r in rows(R.evenly_spaced(e, ["g"], ["n"], 4))] == [0, 3, 6, 9]
    assert R.evenly_spaced(e, ["g"], ["n"], 1).collect()[0].n == 0
    assert R.evenly_spaced(d, ["g"], ["n"], 5).count() == 3


def test_islands_with_nulls(spark, rows):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, None)], "g string, i int, v string")
    assert [tuple(r) for r in R.islands(d, ["g"], ["i"], "v").orderBy("run").collect()] == [("a", 1, None, 2), ("a", 2, "x", 1), ("a", 3, None, 1)]


def test_settings_and_edges(spark, rows):
    d = spark.createDataFrame([("", "b"), (None, "b")], "a string, b string")
    assert [r[0] for r in d.select(R.first_not_null("a", "b")).collect()] == ["", "b"]
    e = spark.createDataFrame([("y", "x"), ("x", None)], "f string, t string")
    assert rows(R.unordered(e, "f", "t"), "low", "high") == [("x", "y")]
