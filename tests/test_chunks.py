"""Chunks, stitching, made entities and pool voices."""

from __future__ import annotations

import random

import pytest

from quire.operators import entities as E
from quire.operators.chunks import chunk, chunked, stitch


def test_chunks_and_stitching():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) + rng.choice(["", "", "."]) for _ in range(500))
    parts = chunk(text, 300, 40)
    assert all(len(p) <= 300 for p in parts) and len(parts) > 10
    assert stitch(parts) == text
    assert any(p.endswith(".") for p in parts[:-1])
    assert chunk(None) == chunk("") == [] and chunk("abc", 3, 0) == ["abc"]
    with pytest.raises(ValueError, match="overlap"):
        chunk("abc", 5, 5)


def test_chunked(spark, rows):
    d = spark.createDataFrame([(1, "x" * 25), (2, None), (3, "")], "id int, t string")
    assert rows(chunked(d, "id", "t", 10, 0)) == [(1, 0, "x" * 10), (1, 1, "x" * 10), (1, 2, "x" * 5)]


def test_ensure_and_voices(spark, rows):
    roster = spark.createDataFrame([("1", "Lan")], "character_id string, name string")
    aliases = spark.createDataFrame([], "character_id string, alias string")
    got = {r.name: (r.character_id, r.created) for r in E.ensure(spark.createDataFrame([("LAN",), ("Mai",), ("mai ",), (None,), (" ",)], "name string"), roster, aliases).collect()}
    assert got["LAN"] == ("1", False) and got["Mai"] == got["mai "] and got["Mai"][1] and len(got) == 3
    c = spark.createDataFrame([("b", "x", 1), ("b", "y", 9), ("b", "z", 5)], "book string, k string, importance int")
    assert rows(E.assign_voices(c, "book", "k", 2), "k", "voice") == [("x", 0), ("y", 0), ("z", 1)]


def test_no_tag_is_cut_and_other_chunkers():
    from quire.operators.chunks import packed_paragraphs, read_aloud

    parts = chunk("<p>" + "a" * 100 + "</p><p>" + "b" * 100 + "</p>", 120, 10)
    assert parts[0].endswith("</p>") and all(len(p) <= 120 for p in parts)
    assert packed_paragraphs("aaa\n\nbbb\n\n" + "c" * 12 + "\n\nd", 9) == ["aaa\n\nbbb", "c" * 12, "d"]
    assert packed_paragraphs("One. Two! Three", 9) == ["One.", "Two!", "Three"]
    assert packed_paragraphs("", 5) == packed_paragraphs(None, 5) == [] and packed_paragraphs("ab", 5) == ["ab"]
    assert read_aloud("  Short.  ") == ["Short."] and read_aloud(None) == read_aloud(" ") == []
    assert read_aloud("Aa bb. " + "c" * 50 + ". Dd", 30, 5) == ["Aa bb.", "c" * 50 + ".", "Dd"]
