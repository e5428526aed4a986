"""Problem 3: sentences on texts written for the test."""

from __future__ import annotations

import random

import pytest

from quire.llm import sentences as S

LEARNED = S.Learned({"dr": False, "etc": True, "p": False, "p.m": True, "no": False, "st": False, "i.e": False}, {"mai"})
RUSSIAN = S.Learned({"г": False, "д": True, "т": False, "стр": False}, script="CYRILLIC")

# every text is written as its sentences, parted by |
CASES = [
    "She went.| He stayed!| Why?",
    "Dr. Faltel kept no. 4 of it.| She left.",
    "He packed rope, lamps, etc.| The widow slept.| He took rope, etc. and left.",
    "It cost 1,230.75 crowns.| J. R. Marlow paid.",
    "He came at 2 p.m.| Nobody saw him.",
    "Am 7. Mai kam er.| Seite 43.| Der Wirt ging.",
    "He paused... then went on.| She fell...| The end.",
    "“Mind it. Wait!”| The door shut.",
    "“Mind it. Wait!” said Anna.| The door shut.",
    "“Rain?” Anna asked.| He nodded.",
    "“Shut it,” Tom said, “I wait.”| Then dark.",
    "Tom said, “I wait. Go.”| Then dark.",
    "„Geht!“, rief Ralf.| »Bleib!« sagte er.| „Nun?“| Stille.",
    "« Viens. Pars, cria Luc, où est-il. »| Il part.| « Va ! » dit-il.",
    "—Sal ya —dijo Ana.| El fin.",
    "– Đi thôi, Chờ đã – Lan nói.| Hết.",
    "«Где он?» — шепчет Анна.| Всё.",
    "“走吧。快！”林舟喊道。|他走了。|“谁？”|村长睡了。",
    "林舟说：“走吧。”|他走了……|天亮了！！",
    "「行く。待て」と彼が言った。|終わり。",
    "«من هو؟» سأل كريم.| ذهب.| «لا.»| عاد.",
    "“चलो!” राम ने कहा।| वह गया।",
    "It fell.|The miller ran.| File a01.xhtml is here.",
    "It was the end",
    "(He left.)| She came.",
    "l’homme dit ‘oui.’| Non.",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    parts = case.split("|")
    text = case.replace("|", "")
    assert [text[a:b] for a, b in S.spans(text, LEARNED)] == [p.strip() for p in parts]


def test_russian_and_thai():
    text = "Он живёт в г. Орле, д. 7. Взял хлеб, соль и т. д. Потом ушёл на стр. 5."
    assert [text[a:b] for a, b in S.spans(text, RUSSIAN)] == ["Он живёт в г. Орле, д. 7.", "Взял хлеб, соль и т. д.", "Потом ушёл на стр. 5."]
    text = " ฝนตก3.4ครั้ง  เขาไป จบ "
    assert [text[a:b] for a, b in S.spans(text, LEARNED)] == ["ฝนตก3.4ครั้ง", "เขาไป", "จบ"]


@pytest.mark.parametrize("text", [None, "", " \n "])
def test_blank(text):
    assert S.spans(text, LEARNED) == []


def test_any_text_is_covered():
    rng = random.Random(5)
    for _ in range(600):
        text = "".join(rng.choice("ab AB.,!?…“”„«»'\"‘’「」–—。？1 \n​́") for _ in range(rng.randrange(60)))
        got = S.spans(text, LEARNED)
        inside = {i for a, b in got for i in range(a, b)}
        assert all(i in inside for i, c in enumerate(text) if not c.isspace())
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_long_text_is_whole():
    text = ("a " * 50_000) + "b. " + "C d." * 1
    assert len(S.spans(text, LEARNED)) == 2


def test_learning(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("aeiou") + rng.choice("lmnrt") for _ in range(3)).capitalize()
    texts = []
    for _ in range(300):
        texts.append((rng.choice([f"Dr. {name()} saw the river.", f"They took rope, bread, etc.", f"The dog met Dr. {name()}. It ran home.", f"He had rope, etc. The sun rose."]), "en"))
        texts.append((f"Er kam am {rng.randrange(1, 29)}. Mai nach {name()}. Das Haus war leer, das Tor auf.", "DE"))
    texts += [(None, "en"), ("", None), ("x", None)]
    d = spark.createDataFrame(texts, "text string, lang string")
    words = S.language_words(d)
    got = S.learn(d, words)
    assert got["en"].abbreviations["dr"] is False and got["en"].abbreviations["etc"] is True
    assert got["en"].abbreviations.get("river", True)  # always last here, so it may pass for one, but it can close
    assert "mai" in got["de"].collocations
    assert S._language("das Haus war leer und das Tor auf", None, words) == "de"
    assert S._language("它走了", "en", words) == "zh"


def test_table(spark):
    d = spark.createDataFrame([(1, "A b. C d.", "en", 1), (1, "A b. C d.", "en", 1), (2, None, None, 1), (3, " ", "xx", 1)], "para_id long, text string, lang string, start_pos int")
    assert sorted(tuple(r) for r in S.sentences(d, "para_id").collect()) == [(1, 0, 4), (1, 5, 9)]
    assert S.sentences(d.limit(0), "para_id").count() == 0


def test_quotations_of_any_length_are_not_cut():
    long = "“" + " ".join(f"Clause {i} stands here." for i in range(4000)) + "” said Anna."
    assert S.spans(long, LEARNED) == [(0, len(long))]
    dash = "– " + "word " * 500 + "– Lan nói. Hết."
    assert [dash[a:b] for a, b in S.spans(dash, LEARNED)][1:] == ["Hết."]
    open_ended = "“Never closed. " * 3000  # each opening is looked up once, so this takes no time
    assert len(S.spans(open_ended, LEARNED)) == 3000
    speech = "“First part.\n“Second part.” She left."
    assert [speech[a:b] for a, b in S.spans(speech, LEARNED)][-1] == "She left."


def test_script_is_that_of_the_whole_text():
    assert S.script_language("Plain Latin words all along the line. " * 300 + "漢") == ""
    assert S.script_language("а" * 10 + "plain words " * 500) == "" and S.script_language("a" * 10 + "слово " * 500) == "ru"


def test_speakers_words_and_starters_are_learned(spark):
    """Words that stand in no list: made-up verbs of speech and an abbreviation that closes sentences."""
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("aeiou") + rng.choice("lmnrt") for _ in range(3)).capitalize()
    texts = []
    for _ in range(400):
        texts.append((f"“{name()} waits here!” {name()} {rng.choice(['blorped', 'fremmed'])}. The {rng.choice(['river', 'tower', 'lamp'])} was dark, the yard was cold.", "qq"))
        texts.append((f"Nobody saw the lamp. Grv. {name()} came by, the yard was dark. {name()} met Grv. {name()}! The end of it.", "qq"))
        texts.append((f"Then {rng.choice(['blorped', 'fremmed'])} the miller by the river, the lamp and the tower, the yard was cold.", "qq"))
    d = spark.createDataFrame(texts, "text string, lang string")
    own = S.learn(d, S.language_words(d))["qq"]
    assert {"blorped", "fremmed"} <= own.last and "said" not in own.last and "the" in own.starters and own.abbreviations["grv"] is False
    text = "“Go!” Anna blorped. He paid Grv. Anna. He paid Grv. The tower fell."
    assert [text[a:b] for a, b in S.spans(text, own)] == ["“Go!” Anna blorped.", "He paid Grv. Anna.", "He paid Grv.", "The tower fell."]
