"""Problems 7, 8 and 9."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import mixing as M
from quire.llm import packing as P
from quire.llm import tokens as K
from quire.llm import truncation as T


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=15))
def test_plan_places_everything(capacity, histogram):
    histogram = {k: n for k, n in histogram.items() if k <= capacity}
    plan = P.plan_best_fit(histogram, capacity)
    placed = Counter()
    for n, held, space in plan:
        assert sum(length * each for length, each in held.items()) + space == capacity and space >= 0
        for length, each in held.items():
            placed[length] += n * each
    assert placed == Counter({k: n for k, n in histogram.items() if n})
    total = sum(k * n for k, n in histogram.items())
    if total:
        assert sum(n for n, *_ in plan) <= 2 * total / capacity + 1


def test_plan_rejects_what_does_not_fit():
    with pytest.raises(ValueError, match="fit"):
        P.plan_best_fit({9: 1}, 8)


def test_pack(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([5, 5, 5, 7, 90, 250, None, 0])) for i in range(400)]
    d = spark.createDataFrame([(i, n, "x", 0) for i, n in sizes], "doc_id long, n_tokens long, length string, rank int")
    got = P.pack(d, "doc_id", "n_tokens", 100).collect()
    per_box, per_doc = Counter(), defaultdict(list)
    for r in got:
        per_box[r.container] += r.length
        per_doc[r.item_id].append((r.part_no, r.start_token, r.length, r.n_parts))
    assert max(per_box.values()) <= 100
    assert {i: sum(x[2] for x in v) for i, v in per_doc.items()} == {i: n for i, n in sizes if n}
    assert all(len(v) == (1 if dict(sizes)[i] <= 100 else 3) == v[0][3] or dict(sizes)[i] == 250 for i, v in per_doc.items())
    assert sorted(per_doc[next(i for i, n in sizes if n == 250)]) == [(1, 0, 100, 3), (2, 100, 100, 3), (3, 200, 50, 3)]
    assert sum(per_box.values()) / (100 * len(per_box)) > 0.95
    assert P.pack(d.limit(0), "doc_id", "n_tokens", 100).count() == 0
    again = P.pack(d.repartition(5), "doc_id", "n_tokens", 100)
    assert sorted(again.collect()) == sorted(got)


def test_tokens_are_exact():
    counter = K.Counter()
    rng = random.Random(4)
    texts = ["", "a", " a", "a  b", "Dưới gốc đa,  vị", "河边\n\n等你 ok", "x" * 3000] + ["".join(rng.choice("ab é漢.'s\n\t 1 ") for _ in range(80)) for _ in range(300)]
    assert [counter.count(t) for t in texts] == [len(counter.encode(t)) for t in texts]
    assert counter.count(None) == 0


def test_quotas():
    q = {x.source: x for x in M.quotas({"a": 100, "b": 1000, "z": 5}, {"a": (0.5, 2), "b": (0.25, 1), "gone": (0.25, 3), "zero": (0.0, 3)})}
    assert set(q) == {"a", "b"}
    assert (q["a"].quota, q["a"].passes, q["a"].rest) == (200, 2, 0) and q["b"].quota == 100
    assert M.quotas({}, {"a": (1.0, 1)}) == []


def test_tree_splits_exactly():
    parts = M.split_tree([100, 7, 0, 993], 7, np.random.default_rng(1))
    assert np.array(parts).sum(axis=0).tolist() == [100, 7, 0, 993]
    sizes = [sum(p) for p in parts]
    assert max(sizes) - min(sizes) <= 3


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(0, 30), 1) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, block int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.3, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = M.mix(d, targets, shards=3)
    got = mixed.collect()
    uses = Counter(r.doc_id for r in got)
    assert len({(r.doc_id, r.repeat) for r in got}) == len(got)
    assert max(uses.values()) <= 4 and {r.source for r in got} == {"a", "b", "c"}
    total = sum(r.n_tokens for r in got)
    for s in "abc":
        assert sum(r.n_tokens for r in got if r.source == s) / total == pytest.approx(1 / 3, abs=0.01)
    by_shard = Counter(r.shard for r in got)
    assert len(by_shard) == 3 and max(by_shard.values()) < 2 * min(by_shard.values())
    assert all(sorted(r.position for r in got if r.shard == s) == list(range(1, n + 1)) for s, n in by_shard.items())
    assert sorted(M.mix(d.repartition(6), targets, shards=3).collect()) == sorted(got)
    report = {r.source: r for r in M.shares(mixed, targets).collect()}
    assert report["gone"].tokens == 0 and report["gone"].share == 0 and report["c"].most_uses <= 4
    assert M.mix(d.limit(0), targets).count() == 0 and M.mix(d, targets.limit(0)).count() == 0


SENTENCE = "The old clerk counted the river map in the rain. "


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows, cut = [], set()

    def add(text, source, is_cut=False):
        i = len(rows)
        rows.append((i, text, source, "x"))
        if is_cut:
            cut.add(i)

    body = lambda n: "".join(rng.choice(["The clerk sold a map. ", "She found the key! ", "Nobody came in the rain. ", "Was it true that he left? "]) for _ in range(n))
    for k in range(60):
        add(body(rng.randrange(2, 40)).strip(), "web")
        add(body(rng.randrange(2, 40)).strip() + "\nTHE END", "web")
        add(body(3).strip() + f"\nEnd of chapter {k}", "feed")
        add(body(3).strip() + f"\nTranslated by {rng.choice(['Anna Bell', 'Tom Reed', 'Kate Orr'])}", "web")
        add("the rain fell on the roof\nthe clerk sold a map\nshe found the roof", "web")
        add("Chapter 1: The map\nChapter 2: The key\nChapter 3: The map", "web")
        add(body(4).strip() + " She turned away…", "feed")
        text = (body(30) + "The younger clerk forgot the lantern and ")[:500]
        text = text[:499].rstrip(" .!?")
        add(text + "x" * (499 - len(text)) + "…", "feed", True)
    for text in ("The clerk sold the ma", body(5) + "Nobody in the", body(5) + "She fou�", body(5) + "She said &quo", body(2) + "and then <e", "“Who took it,” she said, “Let it"):
        add(text, "web", True)
    add(rows[-1][1], "letters", True)  # a copy
    for text in (None, "", " \n", "ฝนตกบนหลังคา เขาไป", "Er packte Lampen usw."):
        add(text, None)
    return rows, cut


def test_truncated(spark, docs):
    rows, cut = docs
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, tail string")
    got = {r.doc_id: r.reason for r in T.truncated(d).collect()}
    missed, wrong = cut - set(got), set(got) - cut
    assert not missed, [rows[i][1][-60:] for i in list(missed)[:5]]
    assert not wrong, [(rows[i][1][-60:], got[i]) for i in list(wrong)[:5]]
    limits = {(r.source, r["size"]) for r in T.hidden_limits(d).where("measure = 'chars'").collect()}
    assert ("feed", 500) in limits
    by = {r.source: r for r in T.truncation_by_source(d).collect()}
    assert by["feed"].cut == 60 and by[None].cut == 0
    assert T.truncated(d.limit(0)).count() == 0


def test_copies_make_no_closing_line(spark):
    cut = "The clerk sold a map.\nNobody came in the"
    rows = [(i, cut, "web") for i in range(6)] + [(10 + i, f"The clerk sold {i} maps.\nEND OF PART", "web") for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in T.truncated(d).collect()} == set(range(6))


def test_measures(spark):
    d = spark.createDataFrame([(1, 'a&b<c>"é\n😀\\', "s")], "doc_id long, text string, source string")
    got = {r.measure: r["size"] for r in T.measured(d).collect()}
    text = 'a&b<c>"é\n😀\\'
    assert got["chars"] == len(text) and got["bytes"] == len(text.encode()) and got["utf16"] == len(text.encode("utf-16-be")) // 2
    assert got["chars, entities"] == len(text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    assert got["chars, crlf"] == len(text) + 1 and got["chars, json"] == len(text) + 3


def test_queries_run(spark, sf):
    from quire.llm.queries import oracles, queries

    assert set(oracles()) <= set(queries())
    fill = {r.pack_id: r.fill for r in queries()["p7_fill"](spark, sf).collect()}
    assert len(fill) == 3 and max(fill.values()) > 0.9
    shares = queries()["p8_shares"](spark, sf)
    assert shares.agg(F.round(F.sum("share"), 2)).first()[0] == 1.0
    assert queries()["p9_found"](spark, sf).columns == ["doc_id"]


def test_any_range_of_the_tree_is_the_same():
    counts = [1000, 7, 0, 993]
    whole = list(M.split_range(counts, 11, 0, 11, 5))
    assert [s for s, *_ in whole] == list(range(11))
    assert np.array([own for *_, own in whole]).sum(axis=0).tolist() == counts
    assert [x for lo in (0, 4, 7) for x in M.split_range(counts, 11, lo, {0: 4, 4: 7, 7: 11}[lo], 5)] == whole
    so_far = np.zeros(4, int)
    for _, before, own in whole:
        assert before == so_far.tolist()
        so_far += own
    sizes = [sum(own) for *_, own in whole]
    assert max(sizes) - min(sizes) <= 4
    huge = list(M.split_range([3_000_000_000, 40], 7, 0, 7, 1))
    assert sum(own[0] for *_, own in huge) == 3_000_000_000 and sum(own[1] for *_, own in huge) == 40
    assert max(sum(own) for *_, own in huge) - min(sum(own) for *_, own in huge) <= 8


def test_mix_with_many_blocks_and_shards(spark, monkeypatch):
    """Blocks numbered in several parts, more shards than a source once had blocks; shards of equal size."""
    monkeypatch.setattr(M, "RANKED", 100)
    d = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 7 + 5).alias("n_tokens"))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mix(d, targets, shards=40)
    by = [r.t for r in mixed.groupBy("shard").agg(F.sum("n_tokens").alias("t")).collect()]
    assert len(by) == 40 and max(by) < 1.25 * min(by)  # some 1,500 documents each
    share = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert share["a"] == pytest.approx(share["b"], rel=1e-3)
    assert mixed.groupBy("doc_id", "repeat").count().where("count > 1").count() == 0


def test_endings_of_any_length(spark):
    rows = [(1, "She left." + "”" * 300), (2, "She le" + "�" * 300), (3, "She left." + " \n" * 300), (4, "The clerk sold a map.\n" + "word " * 3000 + "and then"), (5, "word " * 3000 + "end.")]
    d = spark.createDataFrame([(*r, "web") for r in rows], "doc_id long, text string, source string")
    assert {r.doc_id for r in T.truncated(d).collect()} == {2, 4}
