"""Problem 1: splitting oversized items at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import bisect
import html
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of a boundary.
BLOCK, SENTENCE, WORD, NONE = 3, 2, 1, 0
NAMES = {BLOCK: "block", SENTENCE: "sentence", WORD: "word", NONE: "inside"}

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(head|script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK_TAG = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|center|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header"
    r"|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_MARK = "\u2029"
_SENTENCE_END = re.compile(r"(?:[.!?…؟।]+[\"'”’»)\]]*(?= |$))|[。！？]+[”’」』）]*|……[”’」』）]*")
_CLAUSE_END = re.compile(r"[，、；：]")


def visible_blocks(source: str | None, markup: bool = True) -> list[str]:
    """The blocks of text that a reader sees, each with single spaces and none at its ends; empty ones are left out."""
    if not source:
        return []
    if markup:
        source = _HIDDEN.sub("", source)
        source = _TAG.sub("", _BLOCK_TAG.sub(_MARK, source))
        if "&" in source:
            source = html.unescape(source)
    else:
        source = source.replace("\n", _MARK)
    return [b for b in (" ".join(x.split()) for x in source.split(_MARK)) if b]


def boundaries(blocks: list[str]) -> tuple[str, list[int], list[int], list[int]]:
    """The visible text and the places where a piece may end: at ends of blocks, of sentences, of words."""
    text = " ".join(blocks)
    at, ends = 0, []
    for b in blocks:
        at += len(b)
        ends.append(at)
        at += 1
    sentences = [m.end() for m in _SENTENCE_END.finditer(text)]
    words = [m.start() for m in re.finditer(" ", text)]
    words = sorted({*words, *(m.end() for m in _CLAUSE_END.finditer(text))})
    return text, ends[:-1], sentences, words


def _nearest(places: list[int], target: int, low: int, high: int) -> int | None:
    i = bisect.bisect_left(places, target)
    best = None
    for k in (i - 1, i):
        if 0 <= k < len(places) and low <= places[k] <= high and (best is None or abs(places[k] - target) < abs(best - target)):
            best = places[k]
    return best


def _whole(text: str, at: int, low: int) -> int:
    """``at``, moved back so that no combining mark or joiner is parted from its letter, if that is possible after ``low``."""
    k = at
    while k > low and k < len(text) and (unicodedata.combining(text[k]) or unicodedata.category(text[k]) in ("Mn", "Mc", "Me", "Cf")):
        k -= 1
    return k if k > low else at


def _try(text: str, levels: list[tuple[int, list[int]]], most: int, overlap: int, n: int) -> list[tuple[int, int, int]] | None:
    """Pieces (start, end, strength of the end) for ``n`` balanced targets, or None if one of them breaks the limit."""
    size = len(text)
    step = (size - overlap) / n  # new text per piece
    slack = max(1, int(step * 0.3))
    words = levels[-1][1]
    pieces, start, end = [], 0, 0
    for i in range(1, n):
        target = round(overlap + i * step)
        low, high = max(end + 1, start + 1, target - slack), min(target + slack, start + most, size - 1)
        if low > high:
            if size - start <= most:
                break  # nothing is left to part
            return None
        target = max(low, min(target, high))
        cut, strength = None, NONE
        for strength, places in levels:
            cut = _nearest(places, target, low, high)
            if cut is not None:
                break
        if cut is None:  # a word's end farther back is still better than a cut inside a word
            cut, strength = _nearest(words, target, max(end, start) + 1, high), WORD
        if cut is None:
            cut, strength = _whole(text, target, low - 1), NONE
        pieces.append((start, cut, strength))
        end = cut
        back = max(start + 1, cut - overlap)
        k = bisect.bisect_left(words, back - 1)
        snapped = words[k] + 1 if k < len(words) and text[words[k]] == " " else back
        begin = snapped if overlap and snapped < cut and cut - snapped >= 0.6 * (cut - back) else back
        if not overlap:
            begin = cut
        start = begin + 1 if begin < size and text[begin] == " " else _whole(text, begin, begin - 8) if begin > start + 8 else begin
        start = max(start, cut - overlap)
    if size - start > most or size <= start:
        return None
    pieces.append((start, size, BLOCK))
    return pieces


def _forward(text: str, levels: list[tuple[int, list[int]]], most: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces one after the other, each as long as the limit allows and cut at the strongest boundary in its second half."""
    pieces, start, end = [], 0, 0
    while len(text) - start > most:
        low, high = max(end + 1, start + most // 2), start + most
        cut, strength = high, NONE
        for level, places in levels:
            k = bisect.bisect_right(places, high) - 1
            if k >= 0 and places[k] >= low:
                cut, strength = places[k], level
                break
        pieces.append((start, cut, strength))
        end, start = cut, max(start + 1, cut - overlap)
    return [*pieces, (start, len(text), BLOCK)]


def split_text(blocks: list[str], most: int, overlap: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The visible text and its pieces (start, end, strength of the end), all of ``most`` code points at most.

    As few pieces as the limit allows get targets of equal length; each target snaps to the strongest boundary near it
    (end of a block, a sentence, a word); if some piece then breaks the limit, more pieces are tried and
    the least number of pieces that holds is taken. A text within the limit is one piece, an empty one none. ``overlap`` is cut to half of ``most`` if it is larger.
    """
    if most < 1:
        raise ValueError("the limit must be at least 1")
    overlap = max(0, min(overlap, most // 2))
    text, ends, sentences, words = boundaries(blocks)
    if not text:
        return text, []
    if len(text) <= most:
        return text, [(0, len(text), BLOCK)]
    levels = [(BLOCK, ends), (SENTENCE, sentences), (WORD, words)]
    least = max(2, math.ceil((len(text) - overlap) / (most - overlap)))
    # more pieces are shorter and so hold sooner: steps that double find a number that holds, bisection the least near it
    fails, step = least - 1, 1
    n, found = least, _try(text, levels, most, overlap, least)
    while found is None and n < len(text):
        fails, n = n, min(n + step, len(text))
        found, step = _try(text, levels, most, overlap, n), step * 2
    while found is not None and n - fails > 1:
        middle = (fails + n) // 2
        fewer = _try(text, levels, most, overlap, middle)
        if fewer is None:
            fails = middle
        else:
            n, found = middle, fewer
    if found is None:  # not even one new sign a piece holds: only where marks that can't be parted fill the limit
        found = _forward(text, levels, most, overlap)
    return text, found


_SCHEMA = pa.schema(
    [
        ("item_kind", pa.string()), ("item_id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("visible_chars", pa.int32()),
        ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("cut_at", pa.string()), ("text", pa.string()),
    ]
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in _SCHEMA]
        for kind, item, body, markup, most, overlap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks = visible_blocks(body, markup)
            if most is None:  # a kind without a limit stays whole
                text = " ".join(blocks)
                pieces = [(0, len(text), BLOCK)] if text else []
            else:
                text, pieces = split_text(blocks, most, overlap or 0)
            for i, (a, b, strength) in enumerate(pieces, 1):
                for column, value in zip(out, (kind, item, i, len(pieces), len(text), a, b, NAMES[strength], text[a:b]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)


def split_oversized(items: DataFrame, limits: DataFrame, *, only_oversized: bool = False) -> DataFrame:
    """Pieces of every item: (item_kind, item_id, piece_no, n_pieces, visible_chars, start_pos, end_pos, cut_at, text).

    ``items`` has item_kind, item_id, body and markup (whether body is HTML); ``limits`` has item_kind, max_chars and
    overlap_chars, one row per kind (a fixed table of a few rows, so it is broadcast). Places count code points of the
    visible text, from 0, the end exclusive. An item within its limit, or of a kind without a limit, is one piece; one
    with a null or empty body, or nothing visible in it, gives no row. Repeated rows of an item are split once each.
    With ``only_oversized`` items that cannot be over the limit, since already their source isn't, are skipped.
    """
    d = items.join(F.broadcast(limits.select("item_kind", "max_chars", "overlap_chars")), "item_kind", "left")
    d = d.select("item_kind", "item_id", "body", "markup", "max_chars", "overlap_chars")
    if only_oversized:
        d = d.where(F.length("body") > F.col("max_chars"))
    schema = "item_kind string, item_id string, piece_no int, n_pieces int, visible_chars int, start_pos int, end_pos int, cut_at string, text string"
    return d.mapInArrow(_pieces, schema)
