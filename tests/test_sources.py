"""Packages made here, read as DataFrames."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import packages as P
from quire.sources import sinks

CONTAINER = '<container><rootfiles><rootfile media-type="x" full-path="OEBPS/c.opf"/></rootfiles></container>'
OPF = """<package version="3.0"><metadata><dc:title>A &amp; B</dc:title><dc:language>en</dc:language><dc:identifier>id</dc:identifier>
<meta property="dcterms:modified">x</meta></metadata><manifest><item href="a.xhtml" id="a"/><item id="b" href="t/b.xhtml"/><item id="nav" href="nav.xhtml" properties="nav"/></manifest>
<spine><itemref idref="b"/><itemref idref="a"/><itemref idref="gone"/></spine></package>"""
NAV = '<nav epub:type="toc"><ol><li><a href="t/b.xhtml#x">The <b>B</b></a></li></ol></nav><nav epub:type="landmarks"/>'


def package(path, **files):
    base = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "OEBPS/c.opf": OPF, "OEBPS/nav.xhtml": NAV, "OEBPS/a.xhtml": '<p id="x">a</p><p id="x"><img src="i/no.png"/></p>', "OEBPS/t/b.xhtml": "<h1>b</h1>"}
    with zipfile.ZipFile(path, "w") as z:
        for name, text in (base | files).items():
            if text is not None:
                z.writestr(name, text)


@pytest.fixture()
def books(tmp_path):
    package(tmp_path / "good.epub")
    package(tmp_path / "bare.epub", **{"META-INF/container.xml": None, "OEBPS/nav.xhtml": None, "mimetype": "x"})
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    return str(tmp_path)


def test_chapters(spark, books):
    got = [(r.path.rsplit("/", 1)[1], r.idx, r.title, r.html[:4]) for r in P.read_chapters(spark, books).orderBy("path", "idx").collect()]
    assert got == [("good.epub", 0, "The B", "<h1>"), ("good.epub", 1, "Chapter 2", '<p i')]


def test_books(spark, books):
    got = {r.path.rsplit("/", 1)[1]: r for r in P.read_books(spark, books).collect()}
    assert got["good.epub"].title == "A &amp; B" and got["good.epub"].errors == []
    assert {"repeated ids", "broken images", "no styles", "headings without id"} <= set(got["good.epub"].warnings)
    assert got["good.epub"].score == max(0, 100 - 5 * len(got["good.epub"].warnings))
    assert {"no container", "no or wrong mimetype", "no title"} <= set(got["bare.epub"].errors) and got["bare.epub"].score == 0
    assert got["broken.epub"].errors == ["not a package"]


def test_plain(spark, tmp_path):
    (tmp_path / "my_book.txt").write_text("a\nb\n\nc")
    (tmp_path / "x.html").write_text("<p>h</p>")
    (tmp_path / "x.pdf").write_text("no")
    got = {r.title: r.html for r in P.read_plain(spark, str(tmp_path)).collect()}
    assert got == {"My Book": "<p>a b</p>\n<p>c</p>", "X": "<p>h</p>"}
    d = spark.createDataFrame([("a.EPUB", 5), ("a.exe", 5), ("a.txt", 10**9)], "p string, n long")
    assert [r[0] for r in d.select(P.accepted(F.col("p"), F.col("n"))).collect()] == [True, False, False]


def test_images_and_sidecar(spark, rows):
    c = spark.createDataFrame([("p", '<img src="i/a.png"><img src="b.png"><img src="data:x">')], "path string, html string")
    assert rows(P.broken_images(c, spark.createDataFrame([("p", "img/a.png")], "path string, image string"))) == [("p", "b.png")]
    t = spark.createDataFrame([("b", 0, "own"), ("b", 1, "own")], "book_id string, idx int, text string")
    s = spark.createDataFrame([("b", 1, "better")], "book_id string, idx int, text string")
    assert rows(P.with_sidecar(t, s, 4), "idx", "text") == [(0, "own"), (1, "bett")]


def test_marks_and_rewrite(spark, rows, tmp_path):
    d = spark.createDataFrame([("b", 0, 10, "One=1"), ("b", 10, 30, None), ("x", 0, 0, "empty")], "book string, s long, e long, t string")
    (book, marks), = rows(sinks.chapter_marks(d, "book", "s", "e", "t"))
    assert book == "b" and marks.startswith(";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=10\ntitle=One\\=1\n[CHAPTER]")
    path = str(tmp_path / "t")
    sinks.rewrite(spark.range(3), path)
    sinks.rewrite(spark.read.parquet(path).where("id > 0"), path)
    assert rows(spark.read.parquet(path)) == [(1,), (2,)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_sidecar_texts_are_whole(spark, tmp_path):
    from quire.plans import registry

    spark.createDataFrame([("c", "x" * 2500), ("d", "own")], "chapter_id string, html string").write.parquet(str(tmp_path / "chapters.parquet"))
    spark.createDataFrame([("d", "y" * 2100), (None, "z")], "chapter_id string, text string").write.parquet(str(tmp_path / "synth_requests.parquet"))
    got = {r.chapter_id: r.text for r in registry.queries()["sidecar_texts_whole"](spark, str(tmp_path)).collect()}
    assert got == {"c": "x" * 2500, "d": "y" * 2100}


def test_a_failed_rewrite_keeps_the_table(spark, rows, tmp_path):
    path = tmp_path / "t"
    sinks.rewrite(spark.range(3), str(path))
    with pytest.raises(Exception):  # noqa: B017  the plan fails before anything is moved
        sinks.rewrite(spark.read.parquet(str(path)).select(F.raise_error(F.lit("no")).alias("x")), str(path))
    assert rows(spark.read.parquet(str(path))) == [(0,), (1,), (2,)]


def test_large_packages_are_reported(spark, books, monkeypatch):
    monkeypatch.setattr(P, "MOST_PACKAGE", 100)
    got = {r.path.rsplit("/", 1)[1]: r.errors for r in P.read_books(spark, books).collect()}
    assert got["good.epub"] == ["package too large"] and got["broken.epub"] == ["not a package"]
    assert P.read_chapters(spark, books).count() == 0


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from quire.session import checkpoint_dir

    class Fake:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Fake()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        checkpoint_dir(Session())
