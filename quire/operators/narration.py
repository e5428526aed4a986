"""From attribution to what is read aloud: segments of a chapter, quotation by quotation, and a voice plan by sentence.

``segments`` is the dialect of audiobooks: the chapter is one text, and every quotation is a turn of its own, found by a
list of searches in fixed order and then weighed with the state of the conversation. ``voice_plan`` takes paragraphs
with their verdicts, carries speakers over unnamed quotations, and gives every sentence a character or the narrator.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.attribution import AUDIOBOOK, FLOOR, LONG, LONGER, QUIET, Fold, State, Turn, chapters_with_rosters, rosters, weigh
from quire.operators.chunks import read_aloud
from quire.operators.cues import Cues, Event, Kind, Reading, lower

# Verbs of speech, acts that introduce or follow a quotation, acts that call for an exclamation.
AUDIOBOOK_CUES = Cues(
    speech=(
        "nói|hỏi|đáp|kêu|thì thầm|quát|hét|lẩm bẩm|nói nhỏ|cười nói|trả lời|gọi|thét|lên tiếng|quát tháo|cất tiếng|mở miệng|cất giọng|la lên|hỏi han|gào|kêu gào|tiếp lời"
        "|nói tiếp|nói khẽ|khẽ nói|hỏi lại|hỏi thăm|bảo|đọc|kể|xướng|hát|hỏi rằng|nói rằng|nói với|nói thầm|phát biểu|giải thích|giảng giải|xung phong|reo lên|hét lên"
    ),
    introduces=(
        "gọi|hét|kêu|nói|hỏi|đáp|trả lời|thét|la|reo|than|giận|dỗi|hừ|hắng|hắng giọng|cười|cười khẽ|cười nói|mỉm cười|nhếch mép|quay phắt|quay đầu|ngoái đầu|ngoảnh đầu"
        "|ngoái lại|ngoảnh lại|nhéo|vặn|xoắn|bẻ|giật|kéo|lôi|cầm|nhặt|cúi|ngẩng|nghiêng|lắc|gật|vẫy|cất tiếng|mở miệng|tiếp lời|nói tiếp|nói rằng|khẽ nói|nói khẽ|thì thầm"
        "|thủ thỉ|thề|nguyền rủa|chửi|mắng|quát|quát tháo|gào|kêu gào|gào thét|hô|hô to|hô lớn|đánh|đấm|nắm|véo|vỗ|thở dài|thở ra|thở|nhíu|nhíu mày|lườm|liếc|trừng|ngước"
    ),
    reacts=(
        "cười|mỉm cười|nhếch mép|nháy mắt|chớp mắt|vỗ vai|vỗ lưng|ôm|ghé tai|nắm tay|kéo tay|vuốt tóc|xoa đầu|gõ nhẹ|vẫy tay|giơ tay|chỉ vào|nhìn|liếc nhìn|nhìn trộm"
    ),
)
# Marks of spoken quotations, the longest one, and the signs around one that are searched.
SPOKEN = regex.compile("(?:[“「『\"]|<<)([^“「『\"”」』]{1,1200}?)(?:[”」』\"]|>>)", regex.S)
MARKS = "“「『\"”」』"
BEFORE, AFTER, GAP, OBJECT_NEAR, PRONOUN_BACK, REACTION_BACK, REACTION_GAP = 80, 40, 70, 12, 400, 500, 40
SHORT, LEAST_SURE = 120, 0.6


@dataclass
class Place:
    """A quotation within its chapter, as the searches see it."""

    reading: Reading
    gender: dict[str, str]
    start: int
    end: int
    past: int  # where the quotation before ended, 0 for none

    @property
    def begin(self) -> int:
        return self.past or max(0, self.start - BEFORE)

    @property
    def stop(self) -> int:
        return min(len(self.reading.text), self.end + AFTER)

    def names(self, start: int, end: int, objects: bool = False) -> Iterator[Event]:
        """Names between two places that begin a word and, unless ``objects``, are no one's object."""
        for e in self.reading.of(Kind.NAME, start, end):
            if self.reading.free(e, right=False) and (objects or not self.reading.spaced(Kind.OBJECT, max(start, e.start - OBJECT_NEAR), e.start)):
                yield e

    def verbs(self, kind: Kind, at: int, end: int, most: int = GAP, letters: bool = True) -> list[int]:
        """How far behind ``at`` verbs of a kind stand without a quotation between."""
        text = self.reading.text
        out = []
        for v in self.reading.of(kind, at, end):
            gap = text[at : v.start]
            if len(gap) - 1 > most or (gap and (gap[0].isalpha() or any(c in MARKS for c in gap))) or (not letters and any(c.isalpha() for c in gap)):
                continue
            out.append(len(gap))
        return out


def nearest_verb(p: Place) -> str | None:
    """The name before with a verb of speech behind it, the shorter the way the better."""
    found = [(len(lower(p.reading.text[e.start : e.end])) + max(far), -e.start, -(e.end - e.start), e.name) for e in p.names(p.begin, p.start) if (far := [x for x in p.verbs(Kind.SPEECH, e.end, p.start) if x])]
    return min(found)[3] if found else None


def named_behind(p: Place) -> str | None:
    for e in p.names(p.end, p.stop, objects=True):
        before = p.reading.text[e.start - 1 : e.start]
        if (e.start == p.end or before.isspace() or before in "—-–:：,，") and any(p.verbs(Kind.SPEECH | Kind.INTRODUCES, e.end, p.stop)):
            return e.name
    return None


def after_dash(p: Place) -> str | None:
    m = re.compile(r"\s*[—\-–]\s*").match(p.reading.text, p.end)
    for e in p.reading.of(Kind.NAME, m.end(), p.stop) if m else ():
        if e.start == m.end() and re.fullmatch(r"\s*[.,!?:：]?\s*", p.reading.text[e.end : p.stop]):
            return e.name
    return None


def _of_gender(p: Place, gender: str | None) -> str | None:
    """The last one of a gender who was named before the quotation."""
    return next((e.name for e in reversed(list(p.names(max(0, p.start - PRONOUN_BACK), p.start))) if gender and p.gender.get(e.name) == gender), None)


def pronoun_behind(p: Place) -> str | None:
    text = p.reading.text
    at = p.end + len(text[p.end : p.stop]) - len(text[p.end : p.stop].lstrip())
    who = next((e for e in p.reading.of(Kind.PRONOUN, at, p.stop) if e.start == at and text[e.end : e.end + 1].isspace()), None)
    return _of_gender(p, "female" if who.kinds & Kind.FEMALE else "male") if who and p.verbs(Kind.SPEECH | Kind.INTRODUCES, who.end, p.stop) else None


def pronoun_before(p: Place) -> str | None:
    return _of_gender(p, p.reading.pronoun(p.begin, p.start))


def acting_before(p: Place) -> str | None:
    found = [(e.start, e.end, e) for e in p.names(p.begin, p.start, objects=True) if p.verbs(Kind.INTRODUCES, e.end, p.start, letters=False)]
    last = max(found, default=(0, 0, None))[2]
    return last.name if last and not p.reading.spaced(Kind.OBJECT, max(p.begin, last.start - OBJECT_NEAR), last.start) else None


def reacting_before(p: Place) -> str | None:
    begin = max(p.past, p.start - REACTION_BACK)
    found = [(e.start, e.end, e) for e in p.names(begin, p.start, objects=True) if any(p.verbs(Kind.REACTS, e.end, p.start, REACTION_GAP))]
    last = max(found, default=(0, 0, None))[2]
    return last.name if last and not p.reading.spaced(Kind.OBJECT, max(begin, last.start - OBJECT_NEAR), last.start) else None


#: The searches in their order; the first that finds someone decides.
SEARCHES: tuple[Callable[[Place], str | None], ...] = (nearest_verb, named_behind, after_dash, pronoun_behind, pronoun_before, acting_before, reacting_before)


@dataclass
class Segment:
    kind: str  # narration or dialogue
    text: str
    speaker: str | None = None
    confidence: float | None = None
    source: str | None = None


def chapter_segments(machine: Fold, text: str | None) -> list[Segment]:
    """Segments of a chapter in order: narration in pieces, and each quotation with its speaker; thoughts and written matter are narrated."""
    text = text or ""
    whole, state, out, cursor = Reading(text, machine.words), State(), [], 0
    places = [(m.start(), m.end(), m[1].strip()) for m in SPOKEN.finditer(text)]
    clean = str.maketrans("", "", MARKS)
    past = 0
    for n, (start, end, said) in enumerate(places):
        state.fade()
        tale = text[cursor:start].translate(clean)
        length = len(tale.strip())
        heard = Reading(tale, machine.words)
        if length > LONGER or (state.quiet >= QUIET and length and (length > LONG or heard.new_scene())):
            state.reset()
        if length:
            state.learn(heard.mentions(), None, n)
        out += [Segment("narration", piece) for piece in read_aloud(tale)]
        beside = Reading(f"{tale} {text[end : end + AFTER]}".strip(), machine.words)
        mentions = beside.mentions()
        verdict = None
        if whole.mute((start, end), past):
            out.append(Segment("narration", said, None, 1.0, "narrator-non-spoken-quote"))
        else:
            place = Place(whole, machine.gender, start, end, past)
            near = next(filter(None, (search(place) for search in SEARCHES)), None)
            turn = Turn(state, beside, [(0, len(said) + 2)], mentions, machine.gender, near, {}, machine.dialect)
            turn.__dict__["implicit"] = not near and len(said) <= SHORT
            verdict, _ = weigh(turn, machine.floor)
            out.append(Segment("dialogue", said, verdict.speaker, round(verdict.confidence, 6), verdict.source) if verdict else Segment("dialogue", said))
        state.learn(mentions, verdict.speaker if verdict else None, n)
        cursor = past = end
    return out + [Segment("narration", piece) for piece in read_aloud(text[cursor:])]


_SEGMENTS = "chapter_id string, seq int, kind string, text string, speaker string, confidence double, source string"


def segments(chapters: DataFrame, roster: DataFrame, cues: Cues = AUDIOBOOK_CUES, floor: float = FLOOR) -> DataFrame:
    """What is read aloud of every chapter, in order: (chapter_id, seq, kind, text, speaker, confidence, source).

    ``chapters`` has chapter_id, book_id and text; ``roster`` book_id, name, aliases and gender. A chapter that stands
    in several books counts once for each text, the least first; null and empty texts give no segments; a chapter
    without a roster has a narrator for everything.
    """
    d = chapters.where("chapter_id is not null and text is not null").groupBy("chapter_id", "book_id").agg(F.min("text").alias("text"))
    per = chapters_with_rosters(d, roster).select(F.col("chapter").alias("chapter_id"), F.col("book").alias("book_id"), "roster")
    d = d.join(per, ["chapter_id", "book_id"], "left").select("chapter_id", "text", "roster")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for chapter, text, roster in part.itertuples(index=False):
                machine = Fold(rosters({"roster": [roster if roster is not None else []]}), cues, floor, AUDIOBOOK)
                rows += [(chapter, i, s.kind, s.text, s.speaker, s.confidence, s.source) for i, s in enumerate(chapter_segments(machine, text))]
            yield pd.DataFrame(rows, columns=["chapter_id", "seq", "kind", "text", "speaker", "confidence", "source"])

    return d.mapInPandas(run, _SEGMENTS)


# the voice plan

# What opens and closes a quotation here, how far names are looked for, and how sure that is.
PLAN_OPEN = tuple("\"“”'‘「『")
PLAN_QUOTE = re.compile("[\"“”'‘「『].*?[\"’”」』]", re.S)
PLAN_SENTENCE = re.compile("[^.!?]+(?:[.!?]+[\"”'’»]?|…+(?![\"”'’»]))")
LOOK_BACK, LOOK_AROUND, MOST_NAMED, UNSURE, NEARER = 6, 3, 3, 0.55, 0.02


def plan_sentences(text: str) -> list[str]:
    """Sentences of one paragraph: a run of end marks closes one, with the quotation mark behind it; what is left is the last."""
    matches = list(PLAN_SENTENCE.finditer(text))
    rest = text[matches[-1].end() :] if matches else text
    return [s for s in (x.strip() for x in [*(m[0] for m in matches), rest]) if s]


def is_quoted(text: str) -> bool:
    return text[:1] in PLAN_OPEN and bool(text) or bool(PLAN_QUOTE.search(text))


def carried(texts: list[str], spoken: list[tuple[str, float] | None], named: Callable[[str], set[str]]) -> list[tuple[str, float] | None]:
    """``spoken`` with guesses for unnamed quotations: the speaker before, unless the text between names others; else
    the only one named nearby, before or behind."""
    out, last = list(spoken), None
    quoted = [is_quoted(t) for t in texts]
    for i, verdict in enumerate(spoken):
        if not quoted[i]:
            continue
        if verdict is None:
            goes_on = last is not None and not _others_between(i, texts, quoted, last[0], named)
            verdict = out[i] = last if goes_on else _named_nearby(i, texts, named)
        last = verdict or last
    return out


def _others_between(i: int, texts: list[str], quoted: list[bool], who: str, named: Callable[[str], set[str]]) -> bool:
    for k in range(i - 1, max(0, i - LOOK_BACK - 1), -1):
        if quoted[k]:
            return False
        names = named(texts[k])
        if 1 <= len(names) <= MOST_NAMED and who not in names:
            return True
    return False


def _named_nearby(i: int, texts: list[str], named: Callable[[str], set[str]]) -> tuple[str, float] | None:
    for way in (-1, 1):
        for far in range(1, LOOK_AROUND + 1):
            if not 0 <= i + way * far < len(texts):
                break
            names = named(texts[i + way * far])
            if len(names) == 1:
                return next(iter(names)), UNSURE + (LOOK_AROUND - far) * NEARER
            if names:
                break
    return None


def plan(texts: list[tuple[int, str]], spoken: dict[int, tuple[str, float]], names: dict[str, list[str]]) -> list[tuple]:
    """Rows (i, para, text, speaker, source, confidence, uncertain) of one chapter; ``names`` are names with their aliases."""
    find = lambda text: {n for n, own in names.items() if any(a and a in text for a in [n, *own])}
    verdicts = carried([t for _, t in texts], [spoken.get(i) for i, _ in texts], find)
    rows: list[tuple] = []
    open_before = False
    for (para, text), verdict in zip(texts, verdicts, strict=True):
        balance, running = 0, open_before
        for sentence in plan_sentences(text):
            speaks = verdict if is_quoted(sentence) or running else None
            rows.append((len(rows), para, sentence, speaks and speaks[0], "character" if speaks else "narration", speaks and speaks[1], bool(speaks) and speaks[1] < LEAST_SURE))
            balance += sum(map(sentence.count, "“‘「『")) - sum(map(sentence.count, "”’」』"))
            running = balance > 0
        open_before = balance > 0
    return rows


_PLAN = "chapter_id string, i int, para int, text string, speaker string, source string, confidence double, uncertain boolean"


def voice_plan(paragraphs: DataFrame, attributed: DataFrame, roster: DataFrame) -> DataFrame:
    """A voice for every sentence: (chapter_id, i, para, text, speaker, source, confidence, uncertain).

    ``paragraphs`` has chapter_id, book_id, para_index and text, ``attributed`` chapter_id, para_index, speaker and
    confidence. Repeated rows of a paragraph count once, the least text first; null texts have no sentences. A chapter
    is one ordered group; a book's roster comes as one array.
    """
    p = paragraphs.where("chapter_id is not null and para_index is not null and text is not null").groupBy("chapter_id", "book_id", "para_index").agg(F.min("text").alias("text"))
    a = attributed.where("speaker is not null").groupBy("chapter_id", "para_index").agg(F.max(F.struct("confidence", "speaker")).alias("said"))
    p = p.join(a, ["chapter_id", "para_index"], "left").withColumn("said", F.col("said").cast("struct<confidence:double,speaker:string>"))
    per = chapters_with_rosters(p, roster)

    def run(texts: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame([], columns=["chapter_id", "i", "para", "text", "speaker", "source", "confidence", "uncertain"])
        texts = texts.sort_values("para_index")
        known: dict[str, list[str]] = {}
        for name, aliases, _ in rosters(names) if len(names) else []:
            known.setdefault(name, []).extend(aliases or [])
        spoken = {int(i): (s["speaker"], s["confidence"]) for i, s in zip(texts["para_index"], texts["said"], strict=True) if s is not None}
        rows = plan([(int(i), t) for i, t in zip(texts["para_index"], texts["text"], strict=True)], spoken, known)
        return pd.DataFrame([(texts["chapter_id"].iloc[0], *row) for row in rows], columns=["chapter_id", "i", "para", "text", "speaker", "source", "confidence", "uncertain"])

    return p.groupBy("chapter_id").cogroup(per.groupBy("chapter")).applyInPandas(run, _PLAN)
