"""Chunks for services with a size limit, and stitching their answers together again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A chunk ends at a sentence if one ends in this last part of it.
TAIL_SHARE = 0.7
#: What a chunk may end after, and how many signs of it stay in the chunk.
ENDS = ((". ", 1), ("! ", 1), ("? ", 1), (".\n", 1), ("</p>", 4))
#: Signs that two answers share at most and at least where they are stitched.
MOST_SHARED, LEAST_SHARED = 80, 10


def chunk(text: str | None, most: int = 8000, overlap: int = 200) -> list[str]:
    """Chunks of ``most`` signs at most, each but the first beginning ``overlap`` signs before the end of the one before.

    A chunk ends after the last end mark or closed paragraph in its last part, else at the limit; no tag is cut at its
    closing bracket. Null and empty texts have no chunks.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be smaller than the limit")
    out, at = [], 0
    while text and at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            stop = max((k + keep for mark, keep in ENDS if (k := text.rfind(mark, at, end)) >= 0), default=0)
            if stop - at > most * TAIL_SHARE and stop - overlap > at:
                end = stop
        out.append(text[at:end])
        if end == len(text):
            break
        at = end - overlap
    return out


def packed_paragraphs(text: str | None, most: int) -> list[str]:
    """Whole paragraphs gathered into chunks of ``most`` signs at most, a blank line between them.

    A text that is one paragraph is gathered by sentences. A paragraph above the limit is a chunk of its own, uncut.
    """
    if not text:
        return []
    if len(text) <= most:
        return [text]
    parts = re.split(r"\n\s*\n", text)
    if len(parts) == 1:
        parts = re.split(r"(?<=[.!?。！？…])\s+", text)
    out: list[str] = []
    open_ = False  # whether the last chunk takes more
    for part in filter(None, map(str.strip, parts)):
        fits = open_ and len(out[-1]) + len(part) + 2 <= most
        if fits:
            out[-1] += "\n\n" + part
        else:
            out.append(part)
        open_ = len(part) <= most
    return out


def read_aloud(text: str | None, target: int = 1200, least: int = 40) -> list[str]:
    """Pieces of narration: a text within ``target`` is one; another ends a piece with every sentence that makes it ``least`` long."""
    text = (text or "").strip()
    if len(text) <= target:
        return [text] if text else []
    out, held = [], ""
    for m in re.finditer(r"(.*?)(?:([.!?。！？]+)\s+|\Z)", text, re.S):
        body, marks = m[1], m[2]
        if held and body and len(held) + len(body) > target:
            out.append(held)
            held = ""
        held += body + (marks or "")
        if marks and body and len(held) >= least:
            out.append(held)
            held = ""
    return [p for p in map(str.strip, [*out, held]) if p]


def stitch(parts: list[str]) -> str:
    """Parts joined over the longest text that the end of one and the beginning of the next share."""
    out = ""
    for part in parts:
        shared = next((n for n in range(min(MOST_SHARED, len(out), len(part)), LEAST_SHARED - 1, -1) if out.endswith(part[:n])), 0)
        out += part[shared:]
    return out


def chunked(docs: DataFrame, key: str, text: str, most: int = 8000, overlap: int = 200) -> DataFrame:
    """(key, chunk_no, chunk) of every text; whole texts, in Arrow batches."""
    d = docs.select(key, F.col(text).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, c) for i, t in enumerate(b.column("_t").to_pylist()) for n, c in enumerate(chunk(t, most, overlap))]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=[b.schema.names[0], "chunk_no", "chunk"])

    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, chunk_no int, chunk string")
