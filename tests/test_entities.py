"""Entity operators on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import entities as E


def test_resolve(spark, rows):
    roster = spark.createDataFrame([("1", "Yến Vương"), ("2", "Lan"), ("3", "lan")], "character_id string, name string")
    aliases = spark.createDataFrame([("2", "Bé Lan")], "character_id string, alias string")
    names = spark.createDataFrame([("LAN ",), ("bé  lan",), ("Yến Vương điện hạ",), ("nobody",), (None,)], "name string")
    got = dict(rows(E.resolve(names, roster, aliases)))
    assert got == {"LAN ": "2", "bé  lan": "2", "Yến Vương điện hạ": "1", "nobody": None, None: None}


def test_clusters_and_best(spark, rows):
    d = spark.createDataFrame(
        [("b", "1", "Linh Hong", None, 3), ("b", "2", "Linh Hồng", ["Cô Linh", ""], 1), ("b", "3", "LinhHong", None, 0), ("b", "4", "!", None, None), ("c", "5", "Linh Hong", None, 1)],
        "g string, r string, name string, aliases array<string>, lines int",
    )
    c = E.clusters(d, "g", "r", "name")
    assert rows(c, "r", "cluster") == [("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("5", "5")]
    best = E.representatives(d.join(c.select("r", "cluster"), "r"), ["cluster"], "name", "aliases", "lines")
    assert [tuple(r) for r in best.where("cluster = '1'").collect()] == [("1", "Linh Hồng", ["Cô Linh", "Linh Hong", "LinhHong"], 3)]


def test_subsets(spark, rows):
    d = spark.createDataFrame([("b", "1", "Anna Bell"), ("b", "2", "Anna Maria Bell"), ("b", "3", "Bell"), ("b", "4", "Anna Bell Anna")], "g string, r string, name string")
    assert rows(E.word_subsets(d, "g", "r", "name"), "small", "large") == [("1", "2"), ("4", "2")]


def test_profile_merge(spark, rows):
    old = spark.createDataFrame([("1", "brave", None, {"a": "user", "b": "llm"})], "k string, a string, b string, sources map<string,string>")
    patch = spark.createDataFrame([("1", {"a": "shy", "b": "tall", "z": "?"}), ("2", {"a": "new", "b": None}), ("3", {})], "k string, fields map<string,string>")
    got = rows(E.merge_profile(old, patch, "k", ["a", "b"]))
    assert got == [("1", "a", "conflict", "brave"), ("1", "b", "applied", "tall"), ("2", "a", "applied", "new"), ("2", "b", "skipped", None)]
    s = spark.createDataFrame([({"a": "user", "b": "llm"},), ({"a": "mixed"},), ({"a": "llm"},)], "m map<string,string>")
    assert [r[0] for r in s.select(E.profile_source(F.col("m"))).collect()] == ["user", "mixed", "llm"]


def test_routes(spark, rows):
    known = spark.createDataFrame([("Lan",), (None,)], "name string")
    p = spark.createDataFrame([("1", "new", "q", "Lan"), ("2", "new", "q", "Mai"), ("3", "update", "q", "Mai"), ("4", "update", " ", "Lan"), ("5", "update", "q", None)], "i string, kind string, evidence_quote string, target_name string")
    assert rows(E.route_patches(p, known), "i", "route", "reason") == [
        ("1", "queue", "known name"), ("2", "apply", None), ("3", "queue", "unknown target"), ("4", "queue", "no evidence"), ("5", "queue", "no target"),
    ]


def test_merges(spark, rows):
    moves = spark.createDataFrame([("2", "1"), (None, "1"), ("3", "3")], "absorbed_id string, survivor_id string")
    a = spark.createDataFrame([("1", "Lan", 0.5, "llm"), ("2", "lan", 0.5, "user"), ("2", "Mai", 0.9, "user")], "character_id string, alias string, confidence double, source string")
    assert rows(E.merge_aliases(a, moves)) == [("1", "Lan", 0.5, "llm"), ("1", "Mai", 0.9, "user")]
    p = spark.createDataFrame([("1", 1, 2), ("2", 1, 3), ("2", 2, 1)], "character_id string, chapter int, mentions int")
    assert rows(E.merge_appearances(p, moves)) == [("1", 1, 5), ("1", 2, 1)]
    e = spark.createDataFrame([("1", "2", "f"), ("2", "3", "f"), ("1", "3", "f")], "from_id string, to_id string, relationship string")
    assert rows(E.rewire_edges(e, moves)) == [("1", "3", "f")]


def test_split_and_upsert(spark, rows):
    a = spark.createDataFrame([("1", "Lan", "llm"), ("1", "Mai", "llm")], "character_id string, alias string, source string")
    assert rows(E.split_aliases(a, "1", "9", [" MAI "]), "character_id", "alias", "source") == [("1", "Lan", "llm"), ("9", "Mai", "user")]
    old = spark.createDataFrame([("1", "female"), ("2", None)], "k string, g string")
    new = spark.createDataFrame([("1", "unknown"), ("2", "male"), ("3", None), (None, "x")], "k string, g string")
    assert rows(E.upsert_characters(old, new, "k", ["g"])) == [("1", "female"), ("2", "male"), ("3", None)]
    assert spark.range(1).select(E.patched_confidence(F.lit(1.239))).first()[0] == 1.0


def test_queries_over_all_names(spark, tmp_path):
    import re
    import unicodedata

    from quire.plans import registry

    names = {"1": "Kelsar Orveltam", "2": "kélsar-orveltam", "3": "Холкел", "4": "傅寒沈", "5": None, "6": "O'Brien Kel", "7": "Kel O Brien Zan", "8": ""}
    spark.createDataFrame([(i, "b", n, None, "x") for i, n in names.items()], "character_id string, book_id string, name string, aliases array<string>, role string").write.parquet(str(tmp_path / "characters.parquet"))
    titles = {1: ("Đêm mưa", "mua"), 2: (None, "web"), 3: ("web", None), 4: ("日本", "web")}
    spark.createDataFrame([(i, *t) for i, t in titles.items()], "doc_id long, title string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    folded = {i: None if n is None else "".join(c for c in unicodedata.normalize("NFD", n.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c)).lower() for i, n in names.items()}
    canon = {i: " ".join(re.sub(r"[^a-z0-9_\s]", " ", n or "").split()) for i, n in folded.items()}
    loose = {i: c.replace(" ", "") for i, c in canon.items()}
    cluster = {i: min(j for j in names if loose[j] == loose[i]) if len(loose[i]) >= 2 else i for i in names}
    assert {r.character_id: r.folded for r in run("name_folded_all")} == folded
    assert {r.character_id: r.cluster for r in run("name_clusters_all")} == cluster
    assert {(r.canon, r.records) for r in run("name_canonical_all")} == {(c, list(canon.values()).count(c)) for c in canon.values() if c}
    assert {(r.small, r.large) for r in run("word_subset_names_all")} == {("6", "7")}
    assert sorted(r.members for r in run("cluster_representatives_all")) == [1] * 6 + [2]
    assert {r.doc_id: r.jaccard for r in run("word_jaccard_all")} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}
