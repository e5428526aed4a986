"""Problem 5: one consistent form for text that looks the same.

Compatibility forms, accents, widths, spaces and invisible characters have one normal form. Look-alike letters are
repaired token by token: a token's dominant script is determined, letters of other scripts that look like letters of it
are replaced, and the result counts only if it occurs in the vocabulary of tokens written in one script throughout.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

# Letters that look alike; each line of Cyrillic and of Greek stands over the Latin letters it resembles.
_CYRILLIC_LIKE = "АВСЕНІЈКМОРЅТХУаеіјорсѕухһԁԛԝ"
_CYRILLIC_LATIN = "ABCEHIJKMOPSTXYaeijopcsyxhdqw"
_GREEK_LIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυχ"
_GREEK_LATIN = "ABEZHIKMNOPTYXovaipux"

_CYRILLIC_TO_LATIN = dict(zip(_CYRILLIC_LIKE, _CYRILLIC_LATIN, strict=True))
_GREEK_TO_LATIN = dict(zip(_GREEK_LIKE, _GREEK_LATIN, strict=True))
_LATIN_TO_CYRILLIC = {b: a for a, b in _CYRILLIC_TO_LATIN.items() if a not in "һԁԛԝ"}
_LATIN_TO_GREEK = {b: a for a, b in _GREEK_TO_LATIN.items()}
_TO = {
    "LATIN": _GREEK_TO_LATIN | _CYRILLIC_TO_LATIN,
    "CYRILLIC": _LATIN_TO_CYRILLIC | {a: _LATIN_TO_CYRILLIC[b] for a, b in _GREEK_TO_LATIN.items() if b in _LATIN_TO_CYRILLIC},
    "GREEK": _LATIN_TO_GREEK | {a: _LATIN_TO_GREEK[b] for a, b in _CYRILLIC_TO_LATIN.items() if b in _LATIN_TO_GREEK},
}
#: Letters of one script that look alike, and the one that Vietnamese has.
_TWINS = str.maketrans({"Ð": "Đ", "Ɖ": "Đ"})
_TOKEN = re.compile("[^\\W\\d_]+(?:[\\u0300-\\u036f]+[^\\W\\d_]*)*")
_FOREIGN = re.compile("[\\u00d0\\u0189\\u0370-\\u052f\\u1f00-\\u1fff]")
_INVISIBLE = re.compile(
    "[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0]"
)
_SPACES = re.compile("[\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]")


@functools.lru_cache(maxsize=1 << 16)
def script(letter: str) -> str:
    """LATIN, CYRILLIC or GREEK; '' for any other."""
    o = ord(letter)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "LATIN" if letter.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "GREEK"
    if 0x400 <= o < 0x530:
        return "CYRILLIC"
    return ""


def normal(text: str) -> str:
    """Compatibility form with composed accents, without invisible characters, every kind of space a plain one."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", _SPACES.sub(" ", _INVISIBLE.sub("", text)))


def _counts(text: str) -> dict[str, int]:
    n: dict[str, int] = {}
    for letter in text:
        s = script(letter)
        if s:
            n[s] = n.get(s, 0) + 1
    return n


@functools.lru_cache(maxsize=1 << 18)
def _in_one_script(token: str) -> bool:
    return len(_counts(token)) == 1


def _substituted(token: str, into: str) -> str:
    table = _TO[into]
    out = []
    for letter in unicodedata.normalize("NFD", token):
        out.append(table.get(letter, letter) if script(letter) not in ("", into) else letter)
    return unicodedata.normalize("NFC", "".join(out))


def _dominant(counts: dict[str, int], whole: dict[str, int]) -> str:
    return max(counts, key=lambda s: (counts[s], whole.get(s, 0), s == "LATIN"))


def repairs(text: str) -> list[tuple[str, list[str]]]:
    """Tokens of a normal text that may hold look-alikes, each with what it may stand for, likeliest first.

    A token of several scripts is turned into its dominant one, then into the text's. A token of one script in a text
    of which another is dominant is no case of mixed script; it is asked about only if every letter looks like one of
    the text's script.
    """
    if not _FOREIGN.search(text):
        return []  # no letter that resembles another
    whole = _counts(text)
    main = _dominant(whole, whole) if whole else ""
    out = []
    for token in set(_TOKEN.findall(text)):
        twin = token.translate(_TWINS)
        own = _counts(twin)
        if len(whole) < 2 or not own or (len(own) == 1 and main in own):
            options = [twin] if twin != token else []
        else:
            scripts = ([_dominant(own, whole)] if len(own) > 1 else []) + [main] + [s for s in own if len(own) > 1]
            made = [_substituted(twin, s) for s in dict.fromkeys(scripts)]
            options = [m for m in dict.fromkeys(made) if m != token and len(_counts(m)) == 1]
        if options:
            out.append((token, options))
    return out


def repaired(text: str, known, agreed=frozenset()) -> str:
    """``text`` with every token replaced by its first repair that is ``known``, else by its first that is ``agreed``."""
    swap = {}
    for token, options in repairs(text):
        for made in [m for m in options if m in known] or [m for m in options if m in agreed]:
            swap[token] = made
            break
    return _TOKEN.sub(lambda m: swap.get(m[0], m[0]), text) if swap else text


_ASKED = pa.list_(pa.struct([("made", pa.string()), ("token", pa.string())]))


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns before the last are kept; the last, the text, becomes its normal form, and what may be asked about it."""
    for b in batches:
        texts = [None if t is None else normal(t) for t in b.column(b.num_columns - 1).to_pylist()]
        asked = [sorted({(made, token) for token, options in repairs(t) for made in options}) if t else [] for t in texts]
        asked = [[{"made": made, "token": token} for made, token in a] for a in asked]
        columns = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array(asked, _ASKED)]
        yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "normal", "asked"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of one script, each once per batch."""
    for b in batches:
        found: set[str] = set()
        for t in b.column(0).to_pylist():
            if t:
                found.update(_TOKEN.findall(t))
        found = {w for w in found if _in_one_script(w)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("normal", "known", "agreed"))
        made = pa.array([repaired(t, set(k), set(a)) for t, k, a in zip(*columns, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("item_kind"), b.column("book_id"), b.column("item_id"), b.column("raw"), made], names=["item_kind", "book_id", "item_id", "raw", "form"])


def consistent_forms(items: DataFrame) -> DataFrame:
    """Rows (item_kind, book_id, item_id, raw, form): the digest of the text as it is, and its consistent form.

    ``items`` has item_kind, book_id, item_id and text. Rows with a null text give none; an empty text has the empty
    form; repeated rows give one row. Letter case, accents, the number of spaces, line breaks, and simplified or
    traditional signs stay as they are. Very long texts are treated whole.
    """
    d = items.where(F.col("text").isNotNull()).select("item_kind", "book_id", F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    d = d.select("item_kind", "book_id", "item_id", F.md5(F.encode("text", "UTF-8")).alias("raw"), "text")
    d = d.mapInArrow(_ask, "item_kind string, book_id string, item_id string, raw string, normal string, asked array<struct<made:string,token:string>>")
    d = cut(d)
    asked = d.where(F.size("asked") > 0)
    wanted = asked.select(F.explode("asked").alias("a")).groupBy(F.col("a.made").alias("word")).agg(F.min("a.token").alias("x"), F.max("a.token").alias("y"))
    wanted = cut(wanted)
    vocabulary = d.select("normal").mapInArrow(_words, "word string").join(wanted, "word", "left_semi").distinct().withColumn("pure", F.lit(True))
    # a word that two differently mixed tokens stand for is agreed on by that, even if no text has it pure
    vocabulary = vocabulary.unionByName(wanted.where("x <> y").select("word", F.lit(False).alias("pure"))).groupBy("word").agg(F.max("pure").alias("pure"))
    told = asked.select("item_kind", "book_id", "item_id", "raw", F.explode("asked.made").alias("word")).join(vocabulary, "word")
    # Per text the known answers: as many as it has tokens to repair.
    told = told.groupBy("item_kind", "book_id", "item_id", "raw").agg(F.collect_set(F.when(F.col("pure"), F.col("word"))).alias("known"), F.collect_set(F.when(~F.col("pure"), F.col("word"))).alias("agreed"))
    keys = ["item_kind", "book_id", "item_id", "raw"]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    fixed = asked.alias("a").join(told.alias("t"), same[0] & same[1] & same[2] & same[3], "left")
    fixed = fixed.select(*[F.col(f"a.{k}").alias(k) for k in keys], "normal", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("known", "agreed")])
    fixed = fixed.mapInArrow(_settle, "item_kind string, book_id string, item_id string, raw string, form string")
    plain = d.where(F.size("asked") == 0).select(*keys, F.col("normal").alias("form"))
    return plain.unionByName(fixed)


def look_alike_pairs(forms: DataFrame) -> DataFrame:
    """Pairs of one book and kind with one form but different texts: (item_kind, first_id, second_id).

    Classes whose texts are all equal are dropped before anything is joined. Rows without a book pair with none. All
    pairs of a class are the result asked for; ``consistent_forms`` gives the classes themselves.
    """
    d = forms.where("book_id is not null").select("item_kind", "book_id", "item_id", "raw", F.md5(F.encode("form", "UTF-8")).alias("form"))
    mixed = d.groupBy("item_kind", "book_id", "form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").drop("a", "b")
    d = cut(d.join(mixed, ["item_kind", "book_id", "form"], "left_semi"))
    # the differing texts of a form are paired, and only then their items: copies of one text never meet each other
    texts = d.select("item_kind", "book_id", "form", "raw").distinct()
    side = lambda n: texts.select("item_kind", "book_id", "form", F.col("raw").alias(f"raw{n}"))
    of = lambda n: d.select("item_kind", "book_id", "form", F.col("raw").alias(f"raw{n}"), F.col("item_id").alias(f"id{n}"))
    keys = ["item_kind", "book_id", "form"]
    pairs = side(1).join(side(2), keys).where("raw1 < raw2").join(of(1), [*keys, "raw1"]).join(of(2), [*keys, "raw2"]).where("id1 <> id2")
    pairs = pairs.select("item_kind", F.least("id1", "id2").alias("first_id"), F.greatest("id1", "id2").alias("second_id"))
    return pairs.select("item_kind", "first_id", "second_id").distinct()
