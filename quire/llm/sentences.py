"""Problem 3: sentence boundaries across languages and scripts.

Abbreviations, collocations, sentence starters and the words that name a speaker beside a quotation are learned per
language, without labels, from counts over all texts by log-likelihood ratios (after Kiss and Strunk, 2006); every
full stop is then judged by them. Marks that are never ambiguous, quotations and the spaces of Thai are read from the
text itself.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalikes import _counts, _substituted, normal
from quire.session import cut

#: Thresholds of the log-likelihood scores: abbreviations, collocations, sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Longer types need more evidence: the score falls by this exponent per letter.
LENGTH_PENALTY = 0.8
#: An abbreviation can close a sentence if so large a share of its places ends a text or line.
CLOSING_SHARE = 0.03
#: A word names speakers if it begins or ends so large a share of the clauses after quotations, and stands there so often among all its places.
SPOKEN, SPEAKING = 0.02, 0.1
#: The same share for the last signs of clauses without spaces, of which many are endings of any verb.
ENDING = 0.6
#: A starter has a capital within sentences so rarely at most, so names are none.
CAPITAL_SHARE = 0.01
#: What has a smaller share of its language's words (full stops, ordinals, starts) is not learned: at most 1 / share items of each kind are.
WORD_SHARE, LEAST_SHARE = 1e-4, 1e-5

# Words by which a clause beside a quotation names its speaker, for corpora too small to learn them from.
SPEECH_WORDS = frozenset(
    "said asked answered called shouted whispered replied cried murmured muttered"
    " sagte fragte antwortete rief flüsterte dit demanda répondit cria murmura dijo preguntó respondió gritó susurró"
    " nói hỏi đáp gọi quát thầm khẽ kêu"
    " говорит спрашивает отвечает кричит шепчет сказал сказала спросил спросила ответил ответила"
    " قال قالت سأل سألت أجاب أجابت همس همست صاح صاحت".split()
)
SPEECH_ENDINGS = frozenset("说 道 問 问 答 喊 言った 尋ねた 答えた 叫んだ ささやいた".split())
SPEECH_TAILS = frozenset("कहा पूछा दिया फुसफुसाया चिल्लाया पुकारा बोला to lên".split())
# Quotation marks and what closes them.
QUOTES = {"“": "”", "„": "“”\"", "«": "»", "»": "«", "‘": "’", "「": "」", "『": "』", '"': '"', "‹": "›"}
ENDS = ".!?。！？｡…؟।॥．"
CLOSERS = "”’»」』)）]\"›"

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}.’'\-­​-‍⁠﻿]*")
_EVENT = regex.compile(r"[.!?。！？｡…؟।॥．“”„«»‘「『\"‹–—]")
_CASELESS = regex.compile(r"[\p{Script=Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_THAI, _KANA, _HAN = regex.compile(r"\p{Thai}"), regex.compile(r"[\p{Hiragana}\p{Katakana}]"), regex.compile(r"\p{Han}")
_SCRIPTS = [(regex.compile(r"\p{Arabic}"), "ar"), (regex.compile(r"\p{Devanagari}"), "hi")]
_OWN_SCRIPT = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Thai}\p{Arabic}\p{Devanagari}\p{Cyrillic}\p{Han}]")
_LETTERS = [regex.compile(r"\p{Latin}"), regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Greek}")]
_VIETNAMESE = regex.compile("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹĂĐƠƯ]")


@dataclass
class Learned:
    """What one language's texts have taught."""

    abbreviations: dict[str, bool] = field(default_factory=dict)  # type: whether it can close a sentence
    collocations: set[str] = field(default_factory=set)  # words after a number with a full stop
    starters: set[str] = field(default_factory=set)
    script: str = "LATIN"
    pairs: set[str] = field(default_factory=set)  # an abbreviation and the word that belongs to it
    first: set[str] = field(default_factory=lambda: set(SPEECH_WORDS))  # what begins or ends a clause that names a speaker
    last: set[str] = field(default_factory=lambda: set(SPEECH_WORDS | SPEECH_TAILS))
    endings: set[str] = field(default_factory=lambda: set(SPEECH_ENDINGS))  # the same without spaces


@functools.lru_cache(maxsize=100_000)
def word_type(word: str, script: str = "LATIN") -> str:
    """The type by which a word is counted: normal form, in ``script``, lower case, without the full stop at its end."""
    w = normal(word)
    if (script != "LATIN" or not w.isascii()) and any(own != script for own in _counts(w)):
        w = _substituted(w, script)
    return w.rstrip(".").lower()


def script_of(lang: str) -> str:
    return "CYRILLIC" if lang == "ru" else "LATIN"


def script_language(text: str) -> str:
    """The language that the script alone decides, else 'ru' or ''."""
    if text.isascii() or not _OWN_SCRIPT.search(text):
        return ""
    if _KANA.search(text):
        return "ja"
    if _THAI.search(text):
        return "th"
    for rx, name in _SCRIPTS:
        if rx.search(text):
            return name
    latin, cyrillic, greek = (len(rx.findall(text)) for rx in _LETTERS)
    if cyrillic and cyrillic > max(latin, greek):
        return "ru"
    if _HAN.search(text) and latin < len(text) / 3:
        return "zh"
    return ""


def label(lang: str | None) -> str:
    lang = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    return lang if 2 <= len(lang) <= 3 and lang != "und" else ""


def _language(text: str, lang: str | None, words: dict[str, dict[str, float]] | None) -> str | None:
    """The language of a text: by its script, its label, its accents, else by ``words``; None without these."""
    own = script_language(text)
    if own:
        return own
    lang = label(lang)
    if lang and lang not in _BY_SCRIPT:
        return lang
    if len(_VIETNAMESE.findall(normal(text))) * 12 > len(text):
        return "vi"
    if words is None:
        return None
    best: Counter = Counter()
    for w in _WORD.findall(text):
        for name, weight in words.get(word_type(w), {}).items():
            best[name] += weight
    return max(sorted(best), key=lambda k: best[k]) if best else ""


#: Languages that have a script of their own, so a label that the text's script doesn't bear out is wrong.
_BY_SCRIPT = ("ja", "th", "ar", "hi", "ru", "zh")
_FIRST = regex.compile(r"\s*(\p{L}[\p{L}\p{M}\p{N}.’'\-­​-‍⁠﻿]*)")
_START = regex.compile(r"[!?؟।]\s*(\p{L}[\p{L}\p{M}\p{N}.’'\-­​-‍⁠﻿]*)")
_BEFORE_DOT = regex.compile(r"(?r)\p{L}[\p{L}\p{M}\p{N}.’'\-­​-‍⁠﻿]*")
_AFTER_DOT = regex.compile(r"( *(?:\n|\Z))|\s+(\p{L}[\p{L}\p{M}]*)")
_IN_WORD = regex.compile(r"[\p{L}\p{M}\p{N}.’'\-­​-‍⁠﻿]")
_ORDINAL = regex.compile(r"(?<![\p{N}.,])\p{N}{1,3}\.[\s]+(\p{L}[\p{L}\p{M}]*)")
_AFTER = regex.compile(r"(?:[”」』]\s*|[\"“’»]\s+)(\p{L}[^.!?。！？｡…؟।,，:：;「『“„«\"\n–—]*)[.。।!！]")
_MID = regex.compile(r"(?<=[\p{Ll},] )(\p{Lu}[\p{L}\p{M}]*)")
_TAIL = regex.compile(r"([\p{Han}\p{Hiragana}\p{Katakana}]{1,3})[。！？!?.]")
_NO_SPACES = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]\Z")


def _dotted(text: str) -> Iterator[tuple[str, bool, str]]:
    """Every word that ends with a full stop, whether it closes the text or a line, and the word that follows it."""
    at = text.find(".")
    while at >= 0:
        if not _IN_WORD.match(text, at + 1) and (m := _BEFORE_DOT.match(text, 0, at)):
            after = _AFTER_DOT.match(text, at + 1)
            yield m[0] + ".", bool(after) and after[1] is not None, (after[2] or "") if after else ""
        at = text.find(".", at + 1)


class _Tally:
    """Counts of one language within a batch, first of what the texts hold and in the end of types."""

    def __init__(self, script: str):
        self.script = script
        self.n: Counter = Counter()
        self.raw: Counter = Counter()
        self.dotted: Counter = Counter()
        self.start: Counter = Counter()
        self.ordinal: Counter = Counter()
        self.after: Counter = Counter()
        self.tail: Counter = Counter()
        self.mid: Counter = Counter()

    def add(self, text: str) -> None:
        self.raw.update(_WORD.findall(text))
        if "." in text:
            self.dotted.update(_dotted(text))
            self.ordinal.update(_ORDINAL.findall(text))
        self.start.update(_START.findall(text))
        if m := _FIRST.match(text):
            self.start[m[1]] += 1
        self.after.update(_AFTER.findall(text))
        self.tail.update(_TAIL.findall(text))
        self.mid.update(_MID.findall(text))

    def rows(self) -> Iterator[tuple[str, str, int]]:
        n, script = self.n, self.script

        def kind_of(w: str) -> str:
            return "" if _CASELESS.search(w) else word_type(w, script)

        for w, k in self.raw.items():
            if kind := kind_of(w):
                n["type", kind] += k
        for (w, ends, after), k in self.dotted.items():
            if not w.endswith("..") and (kind := kind_of(w)):
                n["dot", kind] += k
                if ends:
                    n["end", kind] += k
                if after and not after.islower() and (nxt := kind_of(after)):
                    n["pair", f"{kind} {nxt}"] += k
        for w, k in self.start.items():
            if kind := kind_of(w):
                n["start", kind] += k
        for w, k in self.mid.items():
            if kind := kind_of(w):
                n["mid", kind] += k
        for w, k in self.ordinal.items():
            n["ordinal", word_type(w, script)] += k
        for clause, k in self.after.items():
            clause = normal(clause).strip()
            if _NO_SPACES.search(clause):
                n["clauses", "endings"] += k
                for size in range(1, min(3, len(clause)) + 1):
                    n["ending", clause[-size:]] += k
            elif words := _WORD.findall(clause):
                n["clauses", "words"] += k
                # what begins in small letters goes on anyway, so only scripts without them need a first word
                if words[0].lower() == words[0].upper():
                    n["first", word_type(words[0], script)] += k
                if words[-1] == words[-1].lower():
                    n["last", word_type(words[-1], script)] += k
        for signs, k in self.tail.items():
            for size in range(1, len(signs) + 1):
                n["tail", signs[-size:]] += k
        for (kind, word), k in n.items():
            if word and k:
                yield kind, word, k


def _count(words: dict[str, dict[str, float]] | None):
    """Counts per language: of types, with a capital within a sentence, with a full stop, with one at the end of a text or line; of what
    follows such a word, or a number with a full stop; of what begins sentences for sure; of the words at either end of
    the clauses after quotations, and of the last signs of sentences. Texts without a language are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tallies: dict[str, _Tally] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if text and (name := _language(text, lang, words)) is not None:
                    if name not in tallies:
                        tallies[name] = _Tally(script_of(name))
                    tallies[name].add(text)
            rows = [(name, *row) for name, t in tallies.items() for row in t.rows()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in rows], pa.string()) for i in range(3)] + [pa.array([x[3] for x in rows], pa.int64())], names=["lang", "kind", "word", "n"]
            )

    return run


def _counted(texts: DataFrame, words: dict[str, dict[str, float]] | None) -> DataFrame:
    """Rows (lang, kind, word, n): without ``words`` of the texts whose language stands without them, else of the others."""
    d = texts.select("text", "lang")
    if words is not None:
        first = F.split(F.replace(F.lower(F.trim("lang")), F.lit("_"), F.lit("-")), "-")[0]
        d = d.where(F.col("lang").isNull() | ~F.length(first).between(2, 3) | first.isin("und", *_BY_SCRIPT))
        d = d.mapInArrow(_only_unknown, "text string, lang string")
    return d.mapInArrow(_count(words), "lang string, kind string, word string, n bigint").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))


def _only_unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
        yield b.filter(pa.array([bool(t) and _language(t, lang, None) is None for t, lang in zip(texts, langs, strict=True)], pa.bool_()))


def _language_words(counts: DataFrame) -> dict[str, dict[str, float]]:
    n = counts.where("kind = 'type'").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    whole = n.groupBy("lang").agg(F.sum("n").alias("whole"))
    d = n.join(F.broadcast(whole), "lang").withColumn("share", F.col("n") / F.col("whole")).where((F.col("share") >= WORD_SHARE) & (F.col("n") > 1))  # one row per language
    out: dict[str, dict[str, float]] = {}
    for r in d.select("lang", "word", "share").collect():  # at most 1 / WORD_SHARE rows per language
        out.setdefault(r["word"], {})[r["lang"]] = math.log(r["share"] * 1e6 + 1)
    return out


def language_words(texts: DataFrame) -> dict[str, dict[str, float]]:
    """For every word with a share of WORD_SHARE in a language its log weight there."""
    return _language_words(_counted(texts, None))


def learn(texts: DataFrame, words: dict[str, dict[str, float]]) -> dict[str, Learned]:
    """What all texts (columns text and lang) teach, per language."""
    return _learn(_counted(texts, None).unionByName(_counted(texts, words)))


def _association(both, left, right, whole):
    """Log-likelihood ratio of ``right`` standing with ``left``, if it does so more often than elsewhere."""
    log = lambda p: F.log(F.greatest(p, F.lit(1e-12)))
    rest, whole = F.greatest(right - both, F.lit(0)), F.greatest(whole, F.lit(1))
    p0, p1, p2 = right / whole, both / F.greatest(left, F.lit(1)), rest / F.greatest(whole - left, F.lit(1))
    like = lambda k, m, q: k * log(q) + (m - k) * log(1 - q)
    ratio = -2 * (like(both, left, p0) + like(rest, whole - left, p0) - like(both, left, p1) - like(rest, whole - left, p2))
    return F.when((both > 3) & (p1 > p0), ratio).otherwise(0.0)


def _learn(counts: DataFrame) -> dict[str, Learned]:
    """Abbreviations, collocations, starters and speakers' words from counts (lang, kind, word, n)."""
    c = cut(counts.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")))
    kinds = ["type", "mid", "dot", "end", "ordinal", "start", "first", "last", "ending", "tail"]
    sums = {k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in kinds}
    n = c.where(F.col("kind").isin(kinds)).groupBy("lang", "word").agg(*[v.alias(k) for k, v in sums.items()])
    whole = {"N": "type", "D": "dot", "O": "ordinal", "S": "start", "T": "tail"}
    totals = c.groupBy("lang").agg(
        *[sums[k].alias(v) for v, k in whole.items()], *[F.sum(F.when((F.col("kind") == "clauses") & (F.col("word") == k), F.col("n")).otherwise(0)).alias(v) for v, k in (("A", "words"), ("B", "endings"))]
    )
    d = n.join(F.broadcast(totals), "lang")  # one row per language
    log = lambda p: F.log(F.greatest(p, F.lit(1e-12)))
    col = F.col
    p = col("D") / F.greatest(col("N"), F.lit(1))
    without = F.greatest(col("type") - col("dot"), F.lit(0))
    null = col("dot") * log(p) + without * log(1 - p)
    alternative = col("dot") * math.log(0.99) + without * math.log(0.01)
    letters = F.length(F.replace(col("word"), F.lit("."))) + 0.0
    inner = F.length("word") - letters
    score = -2 * (null - alternative) * F.exp(-LENGTH_PENALTY * letters) * (inner + 1) * F.pow(1 / F.greatest(letters, F.lit(1.5)), without)
    d = d.withColumns(
        {
            "abbreviation": score,
            "collocation": _association(col("ordinal"), col("O"), col("type"), col("N")),
            "starter": _association(col("start"), col("S"), col("type"), col("N")),
        }
    )
    speaks = lambda k, many, base, all_, share=SPEAKING: (
        (col(k) >= SPOKEN * col(many)) & (col(k) >= share * col(base)) & (_association(col(k), col(many), F.greatest(col(base), col(k)), F.greatest(all_, col(many))) >= STARTER)
    )
    d = d.select(
        "lang", "word", "dot", "end",
        ((col("dot") > 1) & (col("dot") >= LEAST_SHARE * col("D")) & (col("abbreviation") >= ABBREVIATION)).alias("is_abbreviation"),
        ((col("ordinal") >= LEAST_SHARE * col("O")) & (col("ordinal") >= 0.5 * col("type")) & (col("collocation") >= COLLOCATION)).alias("is_collocation"),
        ((col("start") >= LEAST_SHARE * col("S")) & (col("starter") >= STARTER)).alias("begins"), (col("mid") <= CAPITAL_SHARE * col("type")).alias("low"),
        speaks("first", "A", "type", col("N")).alias("is_first"), speaks("last", "A", "type", col("N")).alias("is_last"), speaks("ending", "B", "tail", col("T"), ENDING).alias("is_ending"),
    ).where("is_abbreviation or is_collocation or begins or is_first or is_last or is_ending")
    d = cut(d)
    out: dict[str, Learned] = {}
    for r in d.collect():  # at most 1 / LEAST_SHARE rows of each kind per language
        own = out.setdefault(r["lang"], Learned(script=script_of(r["lang"]), first=set(), last=set(), endings=set()))
        if r["is_abbreviation"]:
            few = 4 if len(r["word"]) < 5 else 15  # a name may stand at the end of a few sentences only by chance
            own.abbreviations[r["word"]] = r["dot"] < few or r["end"] >= max(1, CLOSING_SHARE * r["dot"])
        if r["begins"] and r["low"]:
            own.starters.add(r["word"])
        if r["is_collocation"] and not r["begins"]:
            own.collocations.add(r["word"])
        for flag, found in ((r["is_first"], own.first), (r["is_last"], own.last), (r["is_ending"], own.endings)):
            if flag:
                found.add(r["word"])
    # the words that belong to an abbreviation: they follow it more often than other full stops
    pairs = c.where("kind = 'pair'").select("lang", F.substring_index("word", " ", 1).alias("word"), F.substring_index("word", " ", -1).alias("after"), col("n").alias("both"))
    pairs = pairs.join(d.where("is_abbreviation").select("lang", "word", "dot"), ["lang", "word"])
    follows = c.where("kind = 'pair'").groupBy("lang", F.substring_index("word", " ", -1).alias("after")).agg(F.sum("n").alias("places"))
    ends = follows.groupBy("lang").agg(F.sum("places").alias("P"))
    pairs = pairs.join(follows, ["lang", "after"]).join(F.broadcast(ends), "lang")  # one row per language
    pairs = pairs.where((col("both") >= LEAST_SHARE * col("P")) & (_association(col("both"), col("dot"), col("places"), col("P")) >= STARTER))
    for r in pairs.select("lang", "word", "after").collect():  # at most 1 / LEAST_SHARE rows per language
        out[r["lang"]].pairs.add(f"{r['word']} {r['after']}")
    return out


class _Closings:
    """Finds what closes the quotations of one text; every stretch of it is searched once for each closing mark."""

    def __init__(self, text: str):
        self.text = text
        self.next: dict[str, int] = {}  # mark: its first place not before the last place asked for

    def _find(self, mark: str, at: int) -> int:
        text, k = self.text, self.next.get(mark, -1)
        if k < at:
            k = text.find(mark, at)
            while mark == "’" and k > 0 and text[k - 1].isalpha() and text[k + 1 : k + 2].isalpha():
                k = text.find(mark, k + 1)  # an apostrophe
            self.next[mark] = k = len(text) if k < 0 else k
        return k

    def after(self, at: int) -> int | None:
        """The place after the mark that closes the quotation opened at ``at``; None if nothing does.

        A quotation that is opened once more in a new line before it closes was not closed: so do speeches of several paragraphs.
        """
        sign = self.text[at]
        marks = QUOTES[sign] + ('"' if sign == "“" else "")
        close = min(self._find(m, at + 1) for m in marks)
        if close >= len(self.text) or (sign not in marks and self._find("\n" + sign, at + 1) < close):
            return None
        return close + 1


def _is_opening(text: str, i: int) -> bool:
    """Whether the sign at ``i``, outside any quotation, opens one."""
    c, before, after = text[i], text[i - 1 : i], text[i + 1 : i + 2]
    if c not in QUOTES:
        return False
    if c in '»"‘':
        return not before.isalnum() and bool(after) and not after.isspace() and after not in ",，;"
    return True


def _closers(text: str, at: int) -> int:
    """The place after the closing signs that stand at ``at``."""
    while at < len(text) and text[at] in CLOSERS and not _is_opening(text, at):
        at += 1
    return at


_DASH = regex.compile(r"\s[–—]|[“”„«»「『\"\n]")
_CLAUSE = regex.compile(r"[^.!?。！？｡…؟।,，:：;「『“„«\"\n–—]*")


def _names_speaker(text: str, at: int, own: Learned) -> bool:
    """Whether the clause from ``at`` on says who spoke the quotation before, and ends there."""
    m = _CLAUSE.match(text, at)
    clause = normal(m[0]).strip()
    mark = text[m.end() : m.end() + 1]
    if not clause or mark in tuple(",，:：「『“„«\"–—;") and mark:
        return False
    if _NO_SPACES.search(clause):
        return any(clause[-k:] in own.endings for k in (1, 2, 3, 4, 5))
    words = clause.split()
    return word_type(words[0], own.script) in own.first or word_type(words[-1], own.script) in own.last


def _goes_on(text: str, end: int, inside: str, own: Learned) -> bool:
    """Whether the sentence goes on after a quotation that closed at ``end``; ``inside`` is its last sign."""
    rest = end
    while rest < len(text) and text[rest].isspace():
        rest += 1
    if rest >= len(text):
        return False
    c = text[rest]
    if rest == end and c in ",，、;；:：" + ENDS:
        return True
    if c in ",，、":
        return True
    if c in "–—":
        after = text[rest + 1 :].lstrip()[:1]
        return bool(after) and after.islower()
    if c == "と":
        return True
    if inside not in tuple(ENDS):
        return not _is_opening(text, rest) or inside in tuple(",，")
    if c.islower():
        return True
    return c.isalpha() and _names_speaker(text, rest, own)


def _judge(text: str, i: int, end: int, begin: int, own: Learned) -> bool:
    """Whether the full stop at ``i`` (its marks end at ``end``) ends the sentence that began at ``begin``."""
    after = text[end : end + 1]
    k = end
    while k < len(text) and text[k].isspace():
        k += 1
    if k >= len(text):
        return True
    nxt = text[k]
    j = i
    while j > begin and not text[j - 1].isspace() and text[j - 1] not in "“”„«»\"‘「『(":
        j -= 1
    token = text[j:i]
    kind = word_type(token, own.script)
    if not after.isspace() and after not in CLOSERS:
        # no space: the next sentence may follow at once, but not inside numbers, initials and names of files
        if not (after.isalpha() or after in QUOTES) or not token or token[-1].isdigit():
            return False
        if after.islower() or len(kind) < 2 or kind in own.abbreviations and not own.abbreviations[kind]:
            return False
        return "." not in kind
    if nxt.islower():
        return False
    if not kind:
        return True
    if kind[-1].isdigit():
        m = _WORD.match(text, k)
        return not (m and word_type(m[0], own.script) in own.collocations and regex.search(r"(?:^|[^\p{N}.,])\p{N}{1,3}$", token) is not None)
    bare = kind.replace(".", "")
    if len(bare) == 1 and "." not in kind:
        if token[-1:].isupper() or not token[-1:].islower():
            return False  # an initial
    if kind in own.abbreviations:
        if nxt.isdigit():
            return own.abbreviations[kind] and len(bare) > 1
        m = _WORD.match(text, k)
        following = word_type(m[0], own.script) if m else ""
        if f"{kind} {following}" in own.pairs:
            return False  # the two belong together
        return own.abbreviations[kind] or following in own.starters
    if len(bare) == 1 and nxt.isdigit():
        return False
    return True


def spans(text: str | None, own: Learned, thai: bool | None = None) -> list[tuple[int, int]]:
    """Places (start, end) of the sentences of ``text``; none if it is null or blank."""
    if not text or text.isspace():
        return []
    cuts: list[int] = []
    if thai if thai is not None else bool(_THAI.search(text)):
        cuts = [m.start() for m in regex.finditer(r"\s+", text)]
    else:
        i, begin = 0, 0
        closings = _Closings(text)
        while True:
            m = _EVENT.search(text, i)
            if not m:
                break
            at, c = m.start(), m[0]
            done = None
            if c in QUOTES and _is_opening(text, at):
                close = closings.after(at)
                if close is None:
                    i = at + 1
                    continue
                inside = text[at + 1 : close - 1].rstrip()[-1:]
                i = close = _closers(text, close)
                if not _goes_on(text, close, inside, own):
                    done = close
            elif c in "–—":
                # a dash at the beginning opens a quotation, the next one closes it
                i = at + 1
                if not text[begin:at].strip() and text[at + 1 : at + 2]:
                    k = _DASH.search(text, at + 2)  # the next dash, unless another quotation or a new line comes first
                    if k and k[0][-1] in "–—":
                        i = k.end()
                        after = i
                        while after < len(text) and text[after] == " ":
                            after += 1
                        i = after
            elif c in ENDS:
                end = at + 1
                while end < len(text) and text[end] in ENDS:
                    end += 1
                run = text[at:end]
                k = end
                while k < len(text) and text[k].isspace():
                    k += 1
                nxt = text[k : k + 1]
                i = end
                if run in (".", "．"):
                    ends = _judge(text, at, end, begin, own)
                elif set(run) <= {".", "…"}:
                    ends = not nxt.islower()
                elif run in ("!", "?", "?!", "!!") and nxt and nxt.islower() and k > end:
                    ends = False
                else:
                    ends = True
                if ends:
                    i = done = _closers(text, end)
            else:
                i = at + 1
            if done is not None:
                cuts.append(done)
                begin = done
    out, start = [], 0
    for cut in [*cuts, len(text)]:
        a, b = start, cut
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        start = cut
    return out


def _split(learned: dict[str, Learned], words: dict[str, dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Learned()
        for b in batches:
            ids, starts, ends = [], [], []
            for i, (text, lang) in enumerate(zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True)):
                if text:
                    name = _language(text, lang, words)
                    for s, e in spans(text, learned.get(name, none), name == "th"):
                        ids.append(i)
                        starts.append(s)
                        ends.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[b.schema.names[0], "start_pos", "end_pos"])

    return run


def sentences(texts: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, start_pos, end_pos): every sentence of every text, in code points, without white space at its ends.

    ``texts`` has the id, text and lang (any notation, may be null or wrong; the script of the text decides first).
    Null and blank texts give no rows; repeated rows give theirs once; texts of any length are treated whole.
    """
    d = texts.select(F.col(id_col), "text", "lang").where("text is not null")
    counts = cut(_counted(d, None))
    words = _language_words(counts)
    learned = _learn(counts.unionByName(_counted(d, words)))
    schema = f"{id_col} {d.schema[id_col].dataType.simpleString()}, start_pos int, end_pos int"
    return d.mapInArrow(_split(learned, words), schema).distinct()
