"""Repeated boilerplate: phrases that many chapters of one book share, their removal, and a memory of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def phrase_counts(chapters: DataFrame, book: str, chapter: str, phrases: Column) -> DataFrame:
    """(book, phrase, chapters, total): in how many chapters of the book a phrase occurs, and how many chapters it has.

    Phrases of one chapter count once: a distinct on (book, chapter, phrase) before the count. Both aggregations
    combine before their shuffle, so a book with a third of all chapters is no hot key. Chapters or books that are null
    are left out; a chapter without phrases counts in ``total``.
    """
    d = chapters.where(F.col(book).isNotNull() & F.col(chapter).isNotNull())
    totals = d.groupBy(book).agg(F.countDistinct(chapter).alias("total"))
    found = d.select(book, chapter, F.explode(phrases).alias("phrase")).distinct().groupBy(book, "phrase").agg(F.count(F.lit(1)).alias("chapters"))
    return found.join(totals, book)


def boilerplate(counts: DataFrame, percent: int = 40, least: int = 2) -> DataFrame:
    """Phrases in at least ``percent`` of the chapters, rounded up, and in ``least`` at least; books of one chapter give none."""
    needed = F.greatest(F.lit(least), F.expr(f"(total * {percent} + 99) div 100"))
    return counts.where((F.col("total") >= 2) & (F.col("chapters") >= needed))


def candidates(counts: DataFrame, book: str, percent: int = 25, k: int = 50) -> DataFrame:
    """Per book at most ``k`` phrases in ``percent`` of the chapters, rounded down, with their share; frequent and long ones first."""
    from pyspark.sql import Window

    needed = F.greatest(F.lit(2), F.expr(f"total * {percent} div 100"))
    w = Window.partitionBy(book).orderBy(F.desc("chapters"), F.desc(F.length("phrase")), "phrase")
    d = counts.where(F.col("chapters") >= needed).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return d.withColumn("pct", F.round(100.0 * F.col("chapters") / F.col("total")))


def new_phrases(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("phrase"), "phrase", "left_anti")


def remembered(memory: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Insert or increment: phrases of 4 to 200 signs with collapsed white space; hits add up, last_seen is the latest."""
    fresh = found.select(T.collapse(F.col("phrase")).alias("phrase")).where(F.length("phrase").between(4, 200))
    fresh = fresh.groupBy("phrase").agg(F.count(F.lit(1)).alias("hits")).withColumn("last_seen", now)
    return memory.select("phrase", "hits", "last_seen").unionByName(fresh).groupBy("phrase").agg(F.sum("hits").alias("hits"), F.max("last_seen").alias("last_seen"))


_ELEMENTS = "p|div|span|h[1-6]"


def element_spans(html: str) -> list[tuple[int, int, str]]:
    """Places and plain texts of block elements; the search stops at the first one that is not closed, and doesn't look inside."""
    out, lower, at = [], html.lower(), 0
    opening = re.compile(f"<({_ELEMENTS})\\b[^>]*>", re.I)
    while m := opening.search(html, at):
        end = f"</{m[1].lower()}>"
        k = lower.find(end, m.end())
        if k < 0:
            break
        at = k + len(end)
        plain = re.sub(r"<[^>]+>", " ", html[m.end() : k])
        for name, sign in T.ENTITIES.items():
            plain = plain.replace(name, sign)
        out.append((m.start(), at + (html[at : at + 1] == "\n"), " ".join(plain.split())))
    return out


def stripped(html: str, phrases: list[str]) -> str:
    """Without elements that hold a phrase, then without the phrases themselves; the longest phrase first."""
    for phrase in sorted({p.strip() for p in phrases if p and p.strip()}, key=lambda p: (-len(p), p)):
        kept, at = [], 0
        for a, b, plain in element_spans(html):
            if phrase.lower() in plain.lower():
                kept.append(html[at:a])
                at = b
        html = "".join([*kept, html[at:]])
        html = re.sub(re.escape(phrase), "", html, flags=re.I)
    return html


def hits(html: str, phrase: str) -> int:
    """Elements that hold the phrase, and its occurrences outside of them."""
    phrase = phrase.strip()
    if not phrase:
        return 0
    n, rest, at = 0, [], 0
    for a, b, plain in element_spans(html):
        if phrase.lower() in plain.lower():
            n += 1
            rest.append(html[at:a])
            at = b
    rest.append(html[at:])
    return n + sum(len(re.findall(re.escape(phrase), part, re.I)) for part in rest)


def strip_elements(chapters: DataFrame, key: str, html: str, phrases: str) -> DataFrame:
    """(key, html, hits): every chapter without its phrases (an array column), and how often they occurred.

    Whole elements can't be matched by the JVM's patterns in linear time, so this runs in Arrow batches, on the columns
    it needs only. Null phrases strip nothing; null html stays null.
    """
    d = chapters.select(key, F.col(html).alias("html"), F.col(phrases).alias("phrases"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(b.column("html").to_pylist(), b.column("phrases").to_pylist(), strict=True))
            out = [None if h is None else stripped(h, p or []) for h, p in rows]
            n = [0 if h is None else sum(hits(h, x) for x in p or []) for h, p in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64())], names=[b.schema.names[0], "html", "hits"])

    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, html string, hits bigint")
