"""What a paragraph shows: one scan for all words of a lexicon gives typed events, from which everything else is read."""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from enum import IntFlag

import ahocorasick
import regex

# Words of the Vietnamese cues. A Cues object takes those of another language.
_SPEECH = (
    "nói|hỏi|đáp|kêu|thì thầm|quát|hét|lẩm bẩm|nói nhỏ|cười nói|trả lời|gọi|thét|lên tiếng|cất tiếng|mở miệng|la lên|gào|tiếp lời|nói tiếp|khẽ nói|nói khẽ"
    "|hỏi lại|bảo|kể|reo lên|hét lên|thủ thỉ"
)
_ACTION = (
    "gọi|hét|kêu|nói|hỏi|đáp|trả lời|thét|la|reo|than|hừ|hắng giọng|cười|mỉm cười|nhếch mép|quay đầu|ngoái lại|gật|lắc|vẫy|cất tiếng|mở miệng|tiếp lời"
    "|nói tiếp|khẽ nói|nói khẽ|thì thầm|thủ thỉ|quát|gào|nhìn|liếc|thở dài|thở ra|ngước|cúi|bước|đứng|ngồi|đi tới|tiến tới"
)
_OBJECT = "nhìn|thấy|gặp|với|của|cho|cùng|gọi|kể|về|bằng|từ|đến|giúp|trả|đưa|đối với|về phía|phía sau|bên cạnh|trước mặt"
_RECIPIENT = "với|cho|nói với|hỏi|đáp|trả lời|gọi"
_SCENE = "hôm sau|ngày hôm sau|sáng hôm sau|đêm đó|lúc này|trong khi đó|một lúc lâu sau|vài ngày sau|một lát sau|sau đó|ở một nơi khác|bên ngoài|trong phòng|trên đường"
_SILENT = "nghĩ thầm|thầm nghĩ|tự nhủ|thầm nhủ|tự hỏi|trong lòng|trong đầu|ý nghĩ|suy nghĩ|nghĩ rằng|nghĩ bụng"
_WRITTEN = "bức thư|lá thư|thư viết|tin nhắn|dòng chữ|tấm biển|biển báo|tiêu đề|tựa đề|cuốn sách|quyển sách|tác phẩm|đoạn trích|trích dẫn|mật khẩu|cụm từ"
_FEMALE, _MALE = "cô|chị|bà|em gái|con gái|nàng|nữ", "anh|ông|chú|bác|em trai|con trai|chàng|nam"
_NEAR = "nói|hỏi|đáp|kêu|gọi|thét|la|reo|cất tiếng|mở miệng|tiếp lời|nói rằng|khẽ nói|nói khẽ|hỏi rằng|nói với|quát|hét"
# Marks that open and close quotations.
OPEN, CLOSE = "\"“”'‘「『", "\"“”'‘」』"
#: Marks after which a pronoun begins a clause, and which no clause with a pronoun crosses.
CLAUSE_MARKS, STOPS = ",。.!?:；、…—–-\"'“”", ",。.!?\"'“”「」『』"
#: Signs around a name or a quotation within which a cue counts.
OBJECT_BEFORE, RECIPIENT_BEFORE, ACT_AFTER, ACT_WITHIN, NAME_TO_VERB, CLAUSE, MUTE_BEFORE, MUTE_AFTER, SAID_BEFORE, SAID_AFTER = 22, 24, 80, 100, 70, 70, 180, 100, 80, 40


@dataclass(frozen=True)
class Cues:
    """The words by which a language shows speech, thought, writing, scenes and gender."""

    speech: str = _SPEECH
    action: str = _ACTION
    object: str = _OBJECT
    recipient: str = _RECIPIENT
    scene: str = _SCENE
    silent: str = _SILENT
    written: str = _WRITTEN
    female: str = _FEMALE
    male: str = _MALE
    near: str = _NEAR
    introduces: str = ""  # acts that introduce or follow a quotation (audiobooks only)
    reacts: str = ""  # acts that call for a short exclamation (audiobooks only)


#: The same for English test texts.
ENGLISH = Cues(
    speech="said|asked|answered|called|shouted|whispered", action="said|asked|answered|called|shouted|whispered|looked|turned|walked|opened|dropped|found", object="saw|met|with|for|to|at|toward",
    recipient="with|for|to", scene="the next day|that night|meanwhile|a year later|that morning|at dusk", silent="thought|wondered|told herself|told himself", written="the letter|the sign|the note|the title",
    female="she|the girl|the widow", male="he|the boy|the steward", near="said|asked|answered|called|shouted|whispered",
)




class Kind(IntFlag):
    SPEECH = 1
    ACTION = 2
    OBJECT = 4
    RECIPIENT = 8
    SCENE = 16
    SILENT = 32
    WRITTEN = 64
    FEMALE = 128
    MALE = 256
    NEAR = 512
    NAME = 1024
    INTRODUCES = 2048
    REACTS = 4096
    VERB = SPEECH | ACTION
    PRONOUN = FEMALE | MALE


@dataclass(frozen=True)
class Event:
    start: int
    end: int
    kinds: Kind
    name: str | None = None


#: Scripts whose words no space parts.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")


def _part_of_word(c: str) -> bool:
    return c.isalnum() or c == "_" or bool(c and unicodedata.combining(c))


def lower(text: str) -> str:
    """Small letters, sign by sign, so places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Lexicon:
    """All words of the cues and all names of a roster in one automaton."""

    def __init__(self, cues: Cues, names: dict[str, str]):
        words: dict[str, Kind] = {}
        for kind in (Kind.SPEECH, Kind.ACTION, Kind.OBJECT, Kind.RECIPIENT, Kind.SCENE, Kind.SILENT, Kind.WRITTEN, Kind.FEMALE, Kind.MALE, Kind.NEAR, Kind.INTRODUCES, Kind.REACTS):
            for word in getattr(cues, kind.name.lower()).split("|"):
                words[lower(word)] = words.get(lower(word), Kind(0)) | kind
        for alias in names:
            words[alias] = words.get(alias, Kind(0)) | Kind.NAME
        self.automaton = ahocorasick.Automaton()
        for word, kinds in words.items():
            if word:
                self.automaton.add_word(word, (len(word), kinds, names.get(word)))
        if words:
            self.automaton.make_automaton()

    def scan(self, text: str) -> list[Event]:
        """Every word of the lexicon, overlapping ones too, by its place; the longest first."""
        if not len(self.automaton):
            return []
        found = (Event(last - size + 1, last + 1, kinds, name) for last, (size, kinds, name) in self.automaton.iter(lower(text)))
        return sorted(found, key=lambda e: (e.start, -e.end))


@functools.lru_cache(maxsize=64)
def lexicon(cues: Cues, names: tuple[tuple[str, str], ...]) -> Lexicon:
    """One automaton per roster and process, however many chapters a book has."""
    return Lexicon(cues, dict(names))


@dataclass(frozen=True)
class Mention:
    name: str
    start: int
    end: int
    as_object: bool
    as_recipient: bool
    acts: bool


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans from an opening mark to the next closing one of any style."""
    return [m.span() for m in re.finditer(f"[{OPEN}][^{CLOSE}]*[{CLOSE}]", text)]


class Reading:
    """The events of one text, asked by kind and place."""

    def __init__(self, text: str, words: Lexicon):
        self.text = text
        self.events = words.scan(text)
        self._of: dict[Kind, tuple[list[int], list[Event]]] = {}

    def of(self, kind: Kind, start: int = 0, end: int | None = None) -> Iterator[Event]:
        """Events of ``kind`` that lie within ``start`` and ``end``, in order."""
        if kind not in self._of:
            mine = [e for e in self.events if e.kinds & kind]
            self._of[kind] = ([e.start for e in mine], mine)
        starts, mine = self._of[kind]
        end = len(self.text) if end is None else end
        for k in range(bisect.bisect_left(starts, start), len(mine)):
            if mine[k].start >= end:
                return
            if mine[k].end <= end:
                yield mine[k]

    def last(self, kind: Kind, start: int, end: int) -> int:
        """Where the last event of ``kind`` between the two places ends; -1 if there is none."""
        return max((e.end for e in self.of(kind, start, end)), default=-1)

    def first(self, kind: Kind, start: int, end: int) -> int:
        """Where the first one begins; a place behind the text if there is none."""
        return next((e.start for e in self.of(kind, start, end)), len(self.text) + 1)

    def free(self, e: Event, left: bool = True, right: bool = True) -> bool:
        """Whether no sign of a word touches the event on the sides asked for; scripts without spaces have no such sides."""
        if UNSPACED.search(self.text, e.start, e.end):
            return True
        return not (left and _part_of_word(self.text[e.start - 1 : e.start])) and not (right and _part_of_word(self.text[e.end : e.end + 1]))

    def spaced(self, kind: Kind, start: int, end: int) -> bool:
        """Whether an event of ``kind`` stands between white space, spaces included, within the two places."""
        return any(e.start > start and e.end < end and self.text[e.start - 1].isspace() and self.text[e.end].isspace() for e in self.of(kind, start, end))

    def mentions(self) -> list[Mention]:
        """Names in order, the longest of those that begin together; none within another."""
        out: list[Mention] = []
        past = 0
        for e in self.of(Kind.NAME):
            if e.start < past or not self.free(e):
                continue
            past = e.end
            as_object = self.spaced(Kind.OBJECT, max(0, e.start - OBJECT_BEFORE), e.start)
            as_recipient = as_object and self.spaced(Kind.RECIPIENT, max(0, e.start - RECIPIENT_BEFORE), e.start)
            verb = self.first(Kind.VERB, e.end, min(len(self.text), e.end + ACT_WITHIN))
            acts = verb - e.end <= ACT_AFTER and "\n" not in self.text[e.end : verb] and verb <= len(self.text)
            out.append(Mention(e.name, e.start, e.end, as_object, as_recipient, acts))
        return out

    def new_scene(self) -> bool:
        text = self.text
        return any(
            (e.start == 0 or text[e.start - 1].isspace()) and (e.end == len(text) or text[e.end].isspace() or text[e.end] in ",.:;!?…") for e in self.of(Kind.SCENE)
        )

    def mute(self, quote: tuple[int, int], past: int) -> bool:
        """Whether a quotation is a thought or written matter; ``past`` is where the one before it ended."""
        start, end = quote
        begin = max(past, self.text.rfind("\n", 0, start) + 1, start - MUTE_BEFORE)
        loud = self.last(Kind.SPEECH, begin, start)
        written = max((e.end for e in self.of(Kind.WRITTEN, begin, start) if self.free(e, left=False)), default=-1)
        if self.last(Kind.SILENT, begin, start) > loud or written > max(-1, loud - 1):
            return True
        line = self.text.find("\n", end)
        stop = min(end + MUTE_AFTER, len(self.text) if line < 0 else line)
        silent = self.first(Kind.SILENT, end, stop)
        return silent <= len(self.text) and silent < self.first(Kind.SPEECH, end, stop)

    def named_before(self, start: int, end: int) -> str | None:
        """The first name between the two places that a verb of speech follows without a quotation between."""
        for e in self.of(Kind.NAME, start, end):
            if self.free(e, right=False):
                for verb in self.of(Kind.NEAR, e.end, min(end, e.end + NAME_TO_VERB + 30)):
                    gap = self.text[e.end : verb.start]
                    if len(gap) <= NAME_TO_VERB and not any(c in OPEN + CLOSE for c in gap):
                        return e.name
        return None

    def named_at(self, at: int) -> str | None:
        """The name that follows ``at`` at once, or after a dash."""
        m = re.compile(r"\s*[—–\-]?\s*").match(self.text, at)
        stop = min(len(self.text), at + SAID_AFTER)
        return next((e.name for e in self.of(Kind.NAME, m.end(), stop) if e.start == m.end() and self.free(e, left=False)), None)

    def said_by(self, quotes: list[tuple[int, int]]) -> str | None:
        """Who is named beside a quotation; the last quotation is asked first."""
        for (start, end), before in reversed(list(zip(quotes, [None, *quotes], strict=False))):
            past = before[1] if before else max(0, start - SAID_BEFORE)
            if who := self.named_before(past, start) or self.named_at(end):
                return who
        return None

    def pronoun(self, start: int = 0, end: int | None = None, anywhere: bool = False) -> str | None:
        """The gender of the first pronoun between the two places that begins a clause with a verb; ``anywhere``: of the last in any place."""
        found = None
        for e in self.of(Kind.PRONOUN, start, end):
            before = self.text[start : e.start].rstrip()
            if anywhere:
                if not self.free(e) or self.spaced(Kind.OBJECT, max(start, e.start - 12), e.start):
                    continue
            elif before and (before[-1] not in CLAUSE_MARKS):
                continue
            stop = len(self.text) if end is None else end
            for verb in self.of(Kind.VERB, e.end, min(stop, e.end + CLAUSE + 60)):
                gap = self.text[e.end : verb.start]
                if not gap or (gap[0].isspace() and len(gap.lstrip()) <= CLAUSE and not any(c in STOPS for c in gap)):
                    found = "female" if e.kinds & Kind.FEMALE else "male"
                    break
            if found and not anywhere:
                return found
        return found


def roster_names(roster: Iterable[tuple[str, list[str] | None, str | None]]) -> tuple[dict[str, str], dict[str, str]]:
    """(alias in small letters: name, name: gender); of two names with one alias the first by code point has it."""
    known: dict[str, str] = {}
    gender: dict[str, str] = {}
    for name, aliases, g in sorted((r for r in roster if r[0]), key=lambda r: r[0]):
        gender.setdefault(name, g if g in ("female", "male") else "unknown")
        for alias in [name, *(aliases or [])]:
            if alias and alias.strip():
                known.setdefault(lower(alias).strip(), name)
    return known, gender
