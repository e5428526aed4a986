"""Problems 4 and 5."""

from __future__ import annotations

import itertools
import re

import pytest

from quire.llm import lookalikes as L
from quire.llm import names as N


def flat(t):
    return 1.0


@pytest.mark.parametrize(
    ("a", "b", "link"),
    [
        ("Kelsar Orveltam", "Orveltam, Kelsar", "same"), ("Kelsar Orveltam", "KELSAR_ORVELTAM", "same"), ("Kelsar Orveltam", "Keslar Orveltam", "same"),
        ("Kelsar Orveltam", "KelsarOrveltam", "same"), ("Kelsar Orveltam", "Dame Kelsar Orveltam", "same"), ("Kelsar Orveltam", "K. Orveltam", "b"),
        ("Kelsar Orveltam", "Kelsar Z. Orveltam", "b"), ("Kelsar Orveltam", "Helgwen Orveltam", ""), ("Kelsar Orveltam", "Dr. Orveltam", "b"),
        ("Lê Bích Khuê", "Bích Khuê", "b"), ("Lê Bích Khuê", "Le Bich Khue", "b"), ("Lê Nhật Vượng", "Lee Nhaatj Vuwowngj", "b"), ("Lê Bích Khuê", "Hồ Bích Khuê", ""),
        ("傅寒沈", "Fu Han Shen", "b"), ("傅寒沈", "Hanshen Fu", "b"), ("傅寒沈", "傅寒风", ""),
    ],
)
def test_links(a, b, link):
    fa, fb = N.form_of(a)[0], N.form_of(b)[0]
    got = "same" if fa == fb else N.verify(fa, fb, flat, {})
    assert got == link
    back = "same" if fa == fb else N.verify(fb, fa, flat, {})
    assert back == {"a": "b", "b": "a"}.get(link, link)


def test_forms():
    assert N.form_of("Ｋelsar  Οrveltam") == ("kelsar orveltam", False)
    assert N.form_of("老溫鶴柳公子") == N.form_of("温·鹤柳") == ("温鹤柳", False)
    assert N.form_of("the boy", alias=True) is None and N.form_of("") is None and N.form_of(None) is None and N.form_of("Dr.") is None
    assert N.form_of("Dr. Dormar") == ("dormar", True)
    assert N.untyped("nguyeetj") == "nguyet"
    assert N.slip("abcd", "abdc") and N.slip("abcd", "abd") and not N.slip("abcd", "badc")


def test_candidates_miss_no_pair(spark):
    names = ["kelsar orveltam", "keslar orveltam", "orvltam kelsar", "helgwen orveltam", "bacal vanhel", "vanhel bacall", "傅寒沈", "fu han shen", "x"]
    forms = spark.createDataFrame([("b", n, False) for n in names], "book_id string, form string, weak boolean")
    got = {(r.a, r.b) for r in N.candidates(forms).collect()}
    sets = {n: [set(v) for v in N.variants(n)] for n in names}
    want = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if any(len(x & y) >= N.SHARED * len(x | y) for x in sets[a] for y in sets[b])}
    assert got == want and want


def test_entities(spark):
    rows = [
        ("b", "1", "Kelsar Orveltam", None), ("b", "2", "Orveltam, Kelsar", ["boss", None, ""]), ("b", "3", "the Grey Anvil", ["Kelsar Orveltam"]), ("b", "4", "Helgwen Orveltam", []),
        ("b", "5", "Mr. Orveltam", None),  # two could be meant
        ("b", "6", "Lantor Bel", None), ("b", "7", "L. Bel", None), ("b", "7", "L. Bel", None), ("c", "8", "Kelsar Orveltam", None), ("b", "9", None, ["boss"]), (None, "0", "Lantor Bel", None), ("b", "10", "", None),
    ]
    d = spark.createDataFrame([(*r, "x") for r in rows], "book_id string, record string, name string, aliases array<string>, form string")
    got = {tuple(r) for r in N.entity_pairs(N.same_entities(d)).collect()}
    assert got == {("1", "2"), ("1", "3"), ("2", "3"), ("6", "7")}
    assert N.same_entities(d.limit(0)).count() == 0


def test_parts_of_names_with_long_other_tokens(spark):
    rows = [
        ("b", "1", "Holsarthal Jortel"), ("b", "2", "Captain Jortel"), ("b", "3", "Garulcal Melul"), ("b", "4", "Dr. Melul"), ("b", "5", "Lady Mellul"), ("b", "6", "Dr. Sel"),
        ("b", "7", "Anders Bram Corvin Dunst Elgar Fenrosthal"), ("b", "8", "A. B. C. D. E. Fenrosthal"), ("b", "9", "An Bao Le"), ("b", "10", "AnBaoLe"), ("c", "11", "Captain Jortel"),
    ]
    d = spark.createDataFrame([(*r, None) for r in rows], "book_id string, record string, name string, aliases array<string>")
    got = {tuple(r) for r in N.entity_pairs(N.same_entities(d)).collect()}
    assert got == {("1", "2"), ("3", "4"), ("3", "5"), ("4", "5"), ("7", "8"), ("10", "9")}


def test_one_word_aliases(spark):
    rows = [
        ("b", "1", "Lorren Dunbe", None), ("b", "2", "Dunbe Lorren", None), ("b", "3", "the Laughing Anvil", ["LorrenDunbe"]),
        ("b", "4", "Kelsar Orveltam", None), ("b", "5", "the Grey Otter", ["Orveltam"]), ("b", "6", "Garhel Lanros", ["Stoneeye"]), ("b", "7", "Stoneeye", None),
        ("b", "8", "Torjor Lortel", ["Auntie"]), ("b", "9", "Fenba Narbe", ["Auntie"]), ("b", "10", "Sargar Wendorda", ["Auntie"]), ("b", "11", "Auntie", None),
        ("b", "12", "Bagri Deldunvan", None), ("b", "13", "Mormal Deldunvan", None), ("b", "14", "the Iron Kestrel", ["Deldunvan"]),
    ]
    d = spark.createDataFrame(rows, "book_id string, record string, name string, aliases array<string>")
    got = {tuple(r) for r in N.entity_pairs(N.same_entities(d)).collect()}
    assert got == {("1", "2"), ("1", "3"), ("2", "3"), ("4", "5"), ("6", "7")}


def test_normal_and_repairs():
    assert L.normal("Ｄ‌elｖ­el x\ny") == "Delvel x\ny"
    assert L.normal("é") == "é" and L.normal("⼈林") == "人林"
    assert L.repairs("Тhúу Mai") == [("Тhúу", ["Thúy"])]
    assert L.repairs("Улгравeл") == [("Улгравeл", ["Улгравел"])]
    assert L.repairs("plain text") == [] == L.repairs("Только русский")
    assert L.repaired("Тhúу Mai", {"Thúy"}) == "Thúy Mai"
    assert L.repaired("Тhúу Mai", set()) == "Тhúу Mai"
    assert dict(L.repairs("B этот час")) == {"B": ["В"]}


def test_pairs(spark):
    rows = [
        ("name", "b", "1", "Mai Thúy"), ("name", "b", "2", "Маi Тhúу"), ("name", "b", "3", "Mai  Thúy"), ("name", "b", "4", "mai thúy"), ("name", "b", "5", "Mai Thúy"), ("name", "b", "5", "Mai Thúy"),
        ("name", "b", "6", "Mai Thúy​"), ("name", "c", "7", "Ｍai Thúy"), ("paragraph", "b", "8", "Mai Thúy"), ("name", "b", "9", None), ("name", "b", "10", ""), ("name", "b", "11", "​"), ("name", None, "12", "Mai Thúy"),
        ("name", "b", "13", "Mai Thuý"), ("name", "b", "14", "Mai\nThúy"),
    ]
    d = spark.createDataFrame([(*r, 1) for r in rows], "item_kind string, book_id string, item_id string, text string, raw int")
    got = {tuple(r) for r in L.look_alike_pairs(L.consistent_forms(d)).collect()}
    same = ["1", "2", "5", "6"]
    want = {("name", a, b) for a, b in itertools.combinations(sorted(same), 2)} - {("name", "1", "5")} | {("name", "10", "11")}
    assert got == want
    assert L.consistent_forms(d.limit(0)).count() == 0


def test_rarity_decides():
    """The same two forms are linked or not by how rare their tokens are."""
    link = lambda a, b, n, total=1000: N.verify(a, b, lambda t: N.token_weight(n.get(t, 1), total), n, total)
    # what is left over counts by its rarity: a common word hardly, a rare one much
    assert link("acme harbour widgets of", "acme harbour widgets the", {"of": 900, "the": 800, "acme": 1, "harbour": 2, "widgets": 2}) in ("a", "b")
    assert link("acme harbour widgets of", "acme harbour widgets the", {"of": 1, "the": 2, "acme": 300, "harbour": 400, "widgets": 300}) == ""
    # a part of a name links if it is rare, not if every second one has it
    assert link("orvel", "kelsar orvel", {"orvel": 2, "kelsar": 2}) == "a"
    assert link("orvel", "kelsar orvel", {"orvel": 900, "kelsar": 1}) == "a?"
    # a slip is one only beside a token that is far more common, or if it is rare itself
    assert link("mai nat", "mai nhat", {"mai": 9, "nat": 3, "nhat": 300}) == "a"
    assert link("mai nat", "mai nhat", {"mai": 9, "nat": 200, "nhat": 300}) == ""
    # an abbreviation without its full stop stands for a word that many names have
    assert link("acme corp", "acme corporation", {"acme": 2, "corp": 5, "corporation": 90}) == "a"
    assert link("acme corp", "acme corporation", {"acme": 2, "corp": 5, "corporation": 3}) == ""


def test_learned_nicknames_and_addresses(spark):
    rows = [(f"b{i}", f"r{i}", f"Robert Smit{x}", [f"Bob Smit{x}"]) for i, x in enumerate("abcd")] + [("b9", "p", "Robert Gronar", None), ("b9", "q", "Bob Gronar", None)]
    rows += [(f"b{i}", f"x{i}{k}", f"{pre}Korvel Darsen{x}", None) for i, x in enumerate("abcdef") for k, pre in enumerate(("", "Grand Vizier ", "Grand Vizier "))]
    d = spark.createDataFrame([*rows, ("b9", "s", "Grand Vizier Gronar", None)], "book_id string, record string, name string, aliases array<string>")
    forms = d.where("record like 'r%'").mapInArrow(N._forms(frozenset()), "book_id string, record string, form string, weak boolean, alias boolean")
    assert N.nicknames(forms) == {("bob", "robert")}
    assert "grand vizier" in N.forms_of_address(d)
    got = {tuple(r) for r in N.entity_pairs(N.same_entities(d)).collect()}
    assert ("p", "q") in got and ("x00", "x01") in got


def test_hot_grams_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    names = [f"kelsar orvel{x}{y}" for x in "abcd" for y in "mnop"]
    forms = spark.createDataFrame([("b", n, False) for n in names], "book_id string, form string, weak boolean")
    got = sorted((r.a, r.b) for r in N.candidates(forms).collect())
    assert got == sorted(itertools.combinations(sorted(names), 2))


def test_two_mixed_spellings_vouch_for_each_other(spark):
    rows = [("name", "b", "1", "Τamselbro"), ("name", "b", "2", "Таmselbro"), ("name", "b", "3", "Lοrgwenbro")]  # Greek, Cyrillic, alone
    d = spark.createDataFrame(rows, "item_kind string, book_id string, item_id string, text string")
    forms = L.consistent_forms(d)
    assert {tuple(r) for r in L.look_alike_pairs(forms).collect()} == {("name", "1", "2")}
    assert {r.item_id: r.form for r in forms.collect()} == {"1": "Tamselbro", "2": "Tamselbro", "3": "Lοrgwenbro"}


def test_twins_within_a_script(spark):
    rows = [("name", "b", "1", "Ðào Mai"), ("name", "b", "2", "Đào Mai"), ("name", "b", "3", "Ðorn"), ("name", "b", "4", "đào Mai")]
    d = spark.createDataFrame(rows, "item_kind string, book_id string, item_id string, text string")
    assert {tuple(r) for r in L.look_alike_pairs(L.consistent_forms(d)).collect()} == {("name", "1", "2")}


def test_names_are_not_joined_through_the_driver(spark, sf):
    """Only the counted table of hot q-grams is broadcast: Spark takes exploded columns for as small as what they came from."""
    from quire.llm.name_queries import p4_found

    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    runs = store.executionsList()
    before = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)
    assert p4_found(spark, sf).count() > 0
    bus.waitUntilEmpty()
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size()) if runs.apply(i).executionId() > before]
    assert any("SortMergeJoin" in p for p in plans)
    assert [k for p in plans for k in re.findall(r"\) Broadcast\w+Join.*\n(?:Left keys \[\d+\]: (.*))?", p) if "gram#" not in k or "row#" in k] == []
