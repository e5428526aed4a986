"""Segments and the voice plan on chapters worked out by hand."""

from __future__ import annotations

from quire.operators import narration as N
from quire.operators.attribution import AUDIOBOOK, SECOND, Fold, State, layered_by_confidence
from quire.operators.cues import ENGLISH

ROSTER = [("La Dạ", ["Dạ"], "male"), ("Ưu Nhi", None, "female")]


def said(text, roster=ROSTER):
    return [(s.kind, s.text, s.speaker) for s in N.chapter_segments(Fold(roster, N.AUDIOBOOK_CUES, dialect=AUDIOBOOK), text)]


def test_each_search():
    assert said("La Dạ nhìn Ưu Nhi rồi nói: “Đi thôi.”")[1] == ("dialogue", "Đi thôi.", "La Dạ")  # Ưu Nhi is an object
    assert said("“Đi thôi.” Ưu Nhi khẽ nói.")[0][2] == "Ưu Nhi"
    assert said("“Đi thôi.” — La Dạ.")[0][2] == "La Dạ"
    assert said("Ưu Nhi đứng bên La Dạ. “Sai!” Cô hừ một tiếng.")[1][2] == "Ưu Nhi"
    assert said("Ưu Nhi quay phắt lại, “Long!”")[1][2] == "Ưu Nhi"


def test_mute_quotations_are_narrated():
    got = said("La Dạ thầm nghĩ: “Nguy rồi.” Hết.")
    assert got == [("narration", "La Dạ thầm nghĩ:", None), ("narration", "Nguy rồi.", None), ("narration", "Hết.", None)]
    assert said(None) == said("") == [] and said("“”") == [("narration", "“”", None)]


def test_plan():
    texts = [(0, "Anna came in."), (1, "“Who is it?” she said."), (2, "“Wait. Go on"), (3, "and on.” Dark."), (4, "Tom sat down."), (5, "“No.”"), (6, "")]
    names = {"Anna": [], "Tom": ["Tommy"]}
    rows = N.plan(texts, {1: ("Anna", 0.9)}, names)
    got = [(para, text, who, unsure) for _, para, text, who, _, _, unsure in rows]
    assert got == [
        (0, "Anna came in.", None, False), (1, "“Who is it?”", "Anna", False), (1, "she said.", None, False), (2, "“Wait.", "Anna", False), (2, "Go on", "Anna", False),
        (3, "and on.”", None, False), (3, "Dark.", None, False), (4, "Tom sat down.", None, False), (5, "“No.”", "Tom", True),
    ]


def test_second_dialect():
    fold, state = Fold([("Anna", None, "female"), ("Tom", None, "male")], ENGLISH, dialect=SECOND), State()
    assert fold.step(state, 0, "Anna met Tom.") is None
    v = fold.step(state, 1, "“Go.” And the wind blew long over the fields and the houses beyond the river there.", parsed=("Tom", 0.8))
    assert v.speaker == "Tom" and v.source == "parser" and ("parser", 0.72) in v.evidence
    v = Fold([("Anna", None, "female")], ENGLISH, dialect=SECOND).step(State(), 0, "“Go away now,” Peter Smith said to no one in particular.")
    assert v.speaker is None and v.source == "unresolved-actor"


def test_layers(spark, rows):
    t = lambda *r: spark.createDataFrame(list(r), "chapter_id string, para_index int, speaker string, confidence double")
    parsed = t(("c", 0, "P", 0.8), ("c", 1, "P", 0.6), ("c", 2, None, 0.9))
    got = rows(layered_by_confidence(parsed, t(("c", 0, "R", 0.55), ("c", 1, "R", 0.55)), t(("c", 2, "L", 0.7))))
    assert got == [("c", 0, "P", 0.8, "parser"), ("c", 1, "R", 0.55, "regex"), ("c", 2, "L", 0.7, "llm")]


def test_tables(spark, rows):
    roster = spark.createDataFrame([("b", *r) for r in ROSTER], "book_id string, name string, aliases array<string>, gender string")
    chapters = spark.createDataFrame([("c", "b", "La Dạ nói: “Đi.” Hết."), ("c", "b", "La Dạ nói: “Đi.” Hết."), ("d", "x", "“Ai?”"), ("e", "b", None)], "chapter_id string, book_id string, text string")
    assert rows(N.segments(chapters, roster), "chapter_id", "seq", "kind", "text", "speaker") == [
        ("c", 0, "narration", "La Dạ nói:", None), ("c", 1, "dialogue", "Đi.", "La Dạ"), ("c", 2, "narration", "Hết.", None), ("d", 0, "dialogue", "Ai?", None),
    ]
    p = spark.createDataFrame([("c", "b", 0, "La Dạ nói: “Đi!”"), ("c", "b", 0, "La Dạ nói: “Đi!”"), ("z", "q", 0, None)], "chapter_id string, book_id string, para_index int, text string")
    a = spark.createDataFrame([("c", 0, "La Dạ", 0.9)], "chapter_id string, para_index int, speaker string, confidence double")
    assert rows(N.voice_plan(p, a, roster), "i", "text", "speaker") == [(0, "La Dạ nói: “Đi!”", "La Dạ")]
    assert N.voice_plan(p.limit(0), a, roster).count() == 0 and N.segments(chapters.limit(0), roster).count() == 0
