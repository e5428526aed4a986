"""Zipped book packages, plain and HTML files, as DataFrames of books, entries and chapters."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

#: Largest package that is opened, and largest entry that is read, in bytes; others are reported, not read.
MOST_PACKAGE, MOST_ENTRY = 100_000_000, 50_000_000
#: The metadata fields that are read.
FIELDS = ("title", "creator", "language", "identifier", "publisher", "description", "date")

_CHAPTERS = "path string, idx int, href string, title string, html string"
_BOOKS = "path string, " + ", ".join(f"{f} string" for f in FIELDS) + ", chapters int, images int, styles int, toc int, errors array<string>, warnings array<string>, score int"


def _attributes(tag: str) -> dict[str, str]:
    return {k.lower(): v for k, _, v in re.findall(r"([\w:.-]+)\s*=\s*([\"'])(.*?)\2", tag, re.S)}


class Package:
    """One opened package."""

    def __init__(self, data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            self.entries = {i.filename: z.read(i) for i in z.infolist() if not i.is_dir() and i.file_size <= MOST_ENTRY}
            self.unread = sorted(i.filename for i in z.infolist() if i.file_size > MOST_ENTRY)
        root = re.search(r"<rootfile\b[^>]*>", self.text("META-INF/container.xml"), re.I)
        self.opf_path = _attributes(root[0]).get("full-path", "") if root else ""
        self.opf = self.text(self.opf_path)
        base = posixpath.dirname(self.opf_path)
        full = lambda href: posixpath.normpath(posixpath.join(base, href)) if href else ""
        items = {a["id"]: a for a in map(_attributes, re.findall(r"<item\b[^>]*>", self.opf, re.I)) if "id" in a}
        refs = [_attributes(t).get("idref", "") for t in re.findall(r"<itemref\b[^>]*>", self.opf, re.I)]
        self.spine = [p for p in (full(items[r].get("href", "")) for r in refs if r in items) if p in self.entries]
        kind = lambda *ends: [n for n in self.entries if n.lower().endswith(ends)]
        self.images, self.styles, self.ncx = kind(".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp"), kind(".css"), kind(".ncx")
        self.nav = next((n for n in self.entries if re.search(r"nav\.x?html$", n, re.I)), None)
        self.fields = {}
        for f in FIELDS:
            m = re.search(rf"<dc:{f}\b[^>]*>(.*?)</dc:{f}>", self.opf, re.I | re.S)
            self.fields[f] = " ".join(m[1].split()) if m and m[1].strip() else None
        self.toc = self._toc()

    def text(self, name: str) -> str:
        return self.entries.get(name, b"").decode("utf-8", "replace")

    def _toc(self) -> dict[str, str]:
        """Titles by path and by file name, from the navigation document, else from the older table."""
        if self.nav:
            found = [(_attributes(a).get("href", ""), re.sub(r"<[^>]+>", "", t)) for a, t in re.findall(r"(<a\b[^>]*>)(.*?)</a>", self.text(self.nav), re.I | re.S)]
            base = posixpath.dirname(self.nav)
        elif self.ncx:
            ncx = self.text(self.ncx[0])
            found = list(zip([_attributes(c).get("src", "") for c in re.findall(r"<content\b[^>]*>", ncx, re.I)], re.findall(r"<navLabel>\s*<text>(.*?)</text>", ncx, re.I | re.S), strict=False))
            base = posixpath.dirname(self.ncx[0])
        else:
            return {}
        out: dict[str, str] = {}
        for href, title in found:
            path = posixpath.normpath(posixpath.join(base, href.split("#")[0])) if href else ""
            for k in (path, posixpath.basename(path)):
                if k and title.strip():
                    out.setdefault(k, " ".join(title.split()))
        return out

    def chapters(self) -> list[tuple[int, str, str, str]]:
        return [(i, p, self.toc.get(p) or self.toc.get(posixpath.basename(p)) or f"Chapter {i + 1}", self.text(p)) for i, p in enumerate(self.spine)]

    def faults(self) -> tuple[list[str], list[str]]:
        """Errors and warnings by rule."""
        first = self.text(self.spine[0]) if self.spine else ""
        nav = self.text(self.nav) if self.nav else ""
        pages = [self.text(p) for p in self.spine[:20]]
        ids = [re.findall(r"\sid=[\"']([^\"']+)[\"']", p, re.I) for p in pages]
        css = "\n".join(self.text(s) for s in self.styles)
        images = {posixpath.basename(i) for i in self.images}
        broken = [s for p in pages[:10] for s in re.findall(r"src=\"([^\"]+\.(?:jpe?g|png|gif|svg|webp))\"", p, re.I) if posixpath.basename(s) not in images]
        has = lambda p, s: re.search(p, s, re.I) is not None
        errors = {
            "no package document": not self.opf_path, "no readable documents": not self.spine, "no title": not self.fields["title"], "no language": not self.fields["language"],
            "no identifier": not self.fields["identifier"], "no container": "META-INF/container.xml" not in self.entries,
            "no or wrong mimetype": self.text("mimetype").strip() != "application/epub+zip",
            "entry too large to read": bool(self.unread),
        }
        warnings = {
            "not version 3": bool(self.opf) and not has(r"<package\b[^>]*\bversion=[\"']3\.", self.opf), "no navigation": not self.nav and not has(r"properties=[\"'][^\"']*\bnav\b", self.opf),
            "no older table": not self.ncx, "no contents in navigation": bool(self.nav) and not has(r"<nav\b[^>]*epub:type=[\"'][^\"']*\btoc\b", nav),
            "no landmarks": bool(self.nav) and not has(r"epub:type=[\"'][^\"']*\blandmarks\b", nav), "empty list in navigation": has(r"<ol>\s*</ol>", nav),
            "older table without map": bool(self.ncx) and not has(r"<navMap\b", self.text(self.ncx[0]) if self.ncx else ""), "no date of change": bool(self.opf) and not has(r"property=[\"']dcterms:modified", self.opf),
            "no styles": not self.styles, "no charset": bool(first) and not has(r"charset\s*=\s*[\"']?utf-8", first), "no doctype": bool(first) and "<!DOCTYPE" not in first and "<?xml" not in first,
            "no namespace": bool(first) and not has(r"xmlns=[\"']http://www\.w3\.org/1999/xhtml", first), "no language on page": bool(first) and not has(r"\blang=[\"'][^\"']+[\"']", first),
            "no body semantics": bool(first) and not has(r"<body\b[^>]*epub:type=[\"'][^\"']*\bbodymatter\b", first),
            "no chapter semantics": bool(first) and not has(r"<section\b[^>]*(?:epub:type=[\"'][^\"']*\bchapter\b|role=[\"']doc-chapter)", first),
            "repeated ids": any(len(x) != len(set(x)) for x in ids), "headings without id": any(not has(r"\sid\s*=", a) for p in pages for a in re.findall(r"<h[1-6]\b([^>]*)>", p, re.I)),
            "broken images": bool(broken), "fixed position": "position:fixed" in css or "position: fixed" in css, "viewport units": "vh" in css or "vw" in css,
        }
        return [k for k, v in errors.items() if v], [k for k, v in warnings.items() if v]


def _files(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    # the content of a larger package is never read; its row stays, so that it is reported
    large = d.where(F.col("length") > MOST_PACKAGE).select("path", F.lit(None).cast("binary").alias("content"))
    return d.where(F.col("length") <= MOST_PACKAGE).select("path", "content").unionByName(large)


def _opened(data: bytes | None) -> Package | None:
    if data is None:
        return None
    try:
        return Package(data)
    except (zipfile.BadZipFile, EOFError, NotImplementedError):
        return None


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, href, title, html) of all chapters of all packages below ``path``, in reading order; broken ones give none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in part.itertuples(index=False):
                book = _opened(data)
                yield pd.DataFrame([(p, *c) for c in book.chapters()] if book else [], columns=["path", "idx", "href", "title", "html"])

    return _files(spark, path).mapInPandas(run, _CHAPTERS)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row per package: metadata, counts, faults and the score; a broken package has one error and the score 0."""
    names = [*FIELDS, "chapters", "images", "styles", "toc", "errors", "warnings", "score"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, data in part.itertuples(index=False):
                book = _opened(data)
                if book is None:
                    rows.append((p, *[None] * len(FIELDS), 0, 0, 0, 0, ["not a package" if data is not None else "package too large"], [], 0))
                    continue
                errors, warnings = book.faults()
                score = max(0, 100 - 20 * len(errors) - 5 * len(warnings))
                rows.append((p, *[book.fields[f] for f in FIELDS], len(book.spine), len(book.images), len(book.styles), len(set(book.toc.values())), errors, warnings, score))
            yield pd.DataFrame(rows, columns=["path", *names])

    return _files(spark, path).mapInPandas(run, _BOOKS)


def read_plain(spark: SparkSession, path: str, language: str = "vi") -> DataFrame:
    """Text and HTML files as books of one chapter each: (path, idx, title, language, html)."""
    d = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("path", F.input_file_name())
    ending = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    d = d.where(ending.isin("txt", "html", "htm"))
    html = F.when(ending == "txt", T.paragraphs_of_plain(F.col("value"))).otherwise(F.col("value"))
    return d.select("path", F.lit(0).alias("idx"), T.title_of_file(F.substring_index("path", "/", -1)).alias("title"), F.lit(language).alias("language"), html.alias("html"))


def accepted(path: Column, size: Column, most: int = MOST_PACKAGE) -> Column:
    """Whether a file may be taken in, by its ending and size."""
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1)).isin(*T.UPLOAD_ENDINGS) & (size <= most)


def broken_images(chapters: DataFrame, images: DataFrame) -> DataFrame:
    """(path, image): sources in chapters that no image file of the package matches by name."""
    refs = chapters.select("path", F.explode(T.image_sources(F.col("html"))).alias("src")).where(~F.col("src").startswith("data:"))
    refs = refs.select("path", F.substring_index("src", "/", -1).alias("image")).distinct()
    return refs.join(images.select("path", F.substring_index("image", "/", -1).alias("image")), ["path", "image"], "left_anti")


def with_sidecar(chapters: DataFrame, sidecar: DataFrame, most: int = 200_000) -> DataFrame:
    """``text`` of a chapter from its sidecar (book_id, idx, text) where there is one, else its own; cut at ``most`` signs."""
    s = sidecar.groupBy("book_id", "idx").agg(F.max("text").alias("_s"))
    return chapters.join(s, ["book_id", "idx"], "left").withColumn("text", F.left(F.coalesce("_s", "text"), F.lit(most))).drop("_s")
