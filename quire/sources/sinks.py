"""Feeds, chapter marks and atomic rewriting of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import xml_escaped


def feed(books: DataFrame, key: str, title: str, author: str, updated: str, most: int = 100) -> DataFrame:
    """The newest books as entries of an Atom feed: (rank, entry); the limit is what a feed page holds."""
    d = books.select(key, title, author, updated).orderBy(F.desc(updated), key).limit(most)
    tag = lambda name, v: F.concat(F.lit(f"<{name}>"), xml_escaped(F.coalesce(v, F.lit(""))), F.lit(f"</{name}>"))
    entry = F.concat(F.lit("<entry>"), tag("id", F.col(key)), tag("title", F.col(title)), F.lit("<author>"), tag("name", F.col(author)), F.lit("</author>"), tag("updated", F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("</entry>"))
    return d.select(F.row_number().over(Window.orderBy(F.desc(updated), key)).alias("rank"), entry.alias("entry"))


def chapter_marks(offsets: DataFrame, book: str, start: str, end: str, title: str) -> DataFrame:
    """Per book the text of its chapter marks in milliseconds, in order; books with an empty or negative chapter are left out."""
    mark = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col(start), F.lit("\nEND="), F.col(end), F.lit("\ntitle="), F.regexp_replace(F.coalesce(F.col(title), F.lit("")), "([=;#\\\\\\n])", "\\\\$1"))
    d = offsets.groupBy(book).agg(F.min(F.col(end) - F.col(start)).alias("_least"), F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), mark.alias("m")))).alias("_m"))
    return d.where("_least > 0").select(book, F.concat(F.lit(";FFMETADATA1\n"), F.array_join(F.transform("_m", lambda x: x["m"]), "\n")).alias("marks"))


def rewrite(df: DataFrame, path: str) -> None:
    """Writes a table beside its place and then moves it there; the old one goes only when the new one is in its place.

    If the new one can't be moved, the old one is put back and the error raised; nothing is ever deleted before.
    """
    spark: SparkSession = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    new, old, here = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{uuid.uuid4().hex}.tmp", f"{path}.{uuid.uuid4().hex}.old", path))
    df.write.parquet(new.toString())
    fs = here.getFileSystem(conf)

    def move(source, target) -> None:
        if not fs.rename(source, target):  # says so by its result, not by an error
            raise OSError(f"could not move {source} to {target}")

    aside = fs.exists(here)
    if aside:
        move(here, old)
    try:
        move(new, here)
    except Exception:
        if aside:
            move(old, here)
        raise
    if aside:
        fs.delete(old, True)
