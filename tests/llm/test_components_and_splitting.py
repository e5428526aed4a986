"""Problems 1 and 2."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import components as C
from quire.llm import splitting as S


def table(spark, pairs):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "survivor_id string, absorbed_id string, vertex string, rank int")


def groups(spark, pairs):
    return {r.id: r.group_id for r in C.connected_components(table(spark, pairs), "survivor_id", "absorbed_id").collect()}


CASES = {
    "empty": [],
    "nothing to link": [("a", None), (None, "b"), ("c", "c"), (None, None)],
    "chain": [(f"{i:04}", f"{i + 1:04}") for i in range(300)],
    "star": [("hub", f"{i:04}") for i in range(500)],
    "reversed, repeated, self": [("b", "a"), ("a", "b"), ("a", "b"), ("a", "a"), ("c", "b"), ("z", None)],
    "code points": [("ä", "z"), ("Z", "z"), ("😀", "ä")],
    "random": [(str(a), str(b)) for a, b in (random.Random(3).sample(range(900), 2) for _ in range(500))],
}


@pytest.mark.parametrize("name", CASES)
def test_components_against_brute_force(spark, name, monkeypatch):
    monkeypatch.setattr(C, "CELL_EDGES", 40)  # many cells
    pairs = CASES[name]
    assert groups(spark, pairs) == C.brute_force_components(pd.DataFrame(pairs, columns=["a", "b"]), "a", "b")


def test_components_whatever_the_partitions(spark):
    pairs = CASES["random"]
    a, b = (C.connected_components(table(spark, pairs[::d]).repartition(n), "survivor_id", "absorbed_id") for d, n in ((1, 1), (-1, 7)))
    assert sorted(a.collect()) == sorted(b.collect())


def test_visible_text():
    html = "<html><head><title>t</title></head><body><!-- <p>no</p> --><h2>A</h2><p class='x>y'>b&nbsp; <em>c</em>d &amp;\n e</p><script>var a = '<p>';</script><p> </p><img src=\"data:\"/>&#273;</body>"
    assert S.visible_blocks(html) == ["A", "b cd & e", "đ"]
    assert S.visible_blocks(None) == S.visible_blocks("") == S.visible_blocks("<p></p>") == []
    assert S.visible_blocks("a < b\t c\n\nd", markup=False) == ["a < b c", "d"]


words = st.text(st.sampled_from("ab é漢。. ́!"), min_size=0, max_size=250)


@settings(max_examples=80, deadline=None)
@given(st.lists(words, max_size=4), st.integers(1, 90), st.integers(0, 120))
def test_pieces_hold_for_any_text(texts, most, overlap):
    blocks = [b for b in (" ".join(t.split()) for t in texts) if b]
    text, pieces = S.split_text(blocks, most, overlap)
    if not text:
        assert not pieces
        return
    overlap = min(overlap, most // 2)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 < b - a <= most for a, b, _ in pieces)
    for (_, end, _), (start, _, _) in zip(pieces, pieces[1:], strict=False):
        assert end - overlap <= start <= end or text[end:start].isspace()  # nothing is lost but a space
    if len(text) <= most:
        assert len(pieces) == 1


def test_pieces_snap_to_the_strongest_boundary():
    blocks = ["one two three. four five six."] * 8
    _, pieces = S.split_text(blocks, 80, 10)
    assert {s for *_, s in pieces} == {S.BLOCK}
    text, pieces = S.split_text(["x" * 1000], 300, 50)
    assert {s for *_, s in pieces[:-1]} == {S.NONE} and len(pieces) == 4
    assert [a[1] - b[0] for a, b in zip(pieces, pieces[1:], strict=False)] == [50, 50, 50]
    with pytest.raises(ValueError, match="limit"):
        S.split_text(["x"], 0, 0)


def test_split_items(spark):
    items = spark.createDataFrame(
        [("chapter", "1", "<p>" + "word " * 50 + "</p>", True), ("chapter", "2", None, True), ("chapter", "3", "", True), ("request", "4", "a " * 50, False), ("other", "5", "b " * 50, False)],
        "item_kind string, item_id string, body string, markup boolean",
    )
    limits = spark.createDataFrame([("chapter", 100, 20), ("request", 99, 5)], "item_kind string, max_chars int, overlap_chars int")
    got = {}
    for r in S.split_oversized(items, limits).collect():
        got.setdefault(r.item_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"1": 3, "4": 1, "5": 1}
    assert all(len(r.text) <= 100 for r in got["1"])
    assert {r.item_id for r in S.split_oversized(items, limits, only_oversized=True).where("n_pieces > 1").collect()} == {"1"}
    assert S.split_oversized(items.limit(0), limits).count() == 0


def test_found_is_what_the_text_says(spark, sf):
    """p1_found against a plain computation over the whole tables."""
    import duckdb

    from quire.llm.splitting_queries import p1_found

    con = duckdb.connect()
    limits = dict((k, m) for k, m, _ in con.execute(f"select * from '{sf}/piece_limits.parquet'").fetchall())
    want = {("chapter", i) for i, h in con.execute(f"select chapter_id, html from '{sf}/chapters.parquet'").fetchall() if len(" ".join(S.visible_blocks(h))) > limits["chapter"]}
    want |= {("request", i) for i, t in con.execute(f"select request_id, text from '{sf}/synth_requests.parquet'").fetchall() if len(" ".join((t or "").split())) > limits["request"]}
    assert {tuple(r) for r in p1_found(spark, sf).collect()} == want


def test_p2_sql(spark, sf):
    from quire.llm.component_queries import ORACLES, QUERIES
    from tests.oracles import compare, connect

    compare(connect(sf), QUERIES["p2_found"](spark, sf), ORACLES["p2_found"])


@pytest.mark.parametrize(("most", "overlap"), [(500, 50), (200, 20), (40, 5), (12, 3)])
def test_small_limits_still_snap_and_stay_near_the_least_number(most, overlap):
    rng = random.Random(8)
    blocks = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(5, 60))) + "." for _ in range(600)]
    text, pieces = S.split_text(blocks, most, overlap)
    assert all(0 < b - a <= most for a, b, _ in pieces)
    least = -(-(len(text) - overlap) // (most - overlap))
    assert len(pieces) <= {500: 1.3, 200: 1.2, 40: 1.3, 12: 2}[most] * least
    if most >= 40:
        assert sum(s == S.NONE for *_, s in pieces) <= 0.02 * len(pieces)
