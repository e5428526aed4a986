"""Text, name and score functions on literals."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions import scores as S
from quire.functions import text as T
from quire.operators import boilerplate as B


@pytest.fixture(scope="module")
def one(spark):
    def get(f, *values):
        d = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        r = d.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]
        return r

    return get


def test_html_to_text(one):
    assert one(T.html_to_text, "<style>p{}</style><p>a&nbsp;&amp; <b>b</b>\n c</p><script>x</script>") == "a & b c"
    assert one(T.html_to_text, "") == ""
    assert one(T.html_to_text, None) is None


def test_phrases(one):
    html = "<html><head><title>no</title></head><body><h2>Chương 5</h2><p>Hello there</p><div>Hello  there</div><p>abc</p><h4>About us</h4></body></html>"
    assert one(T.phrases, html) == ["Hello there", "About us"]
    assert one(T.line_phrases, "one line\r\nabc\n one  line \n" + "x" * 201) == ["one line"]


def test_paragraphs(one):
    got = one(T.paragraphs, "<p>One.</p><li>Two &amp; <b>three</b></li><p> </p>")
    assert [tuple(r) for r in got] == [(0, 0, 4, "One."), (1, 5, 16, "Two & three")]
    assert [r.text for r in one(T.paragraphs, "No blocks. Two!")] == ["No blocks.", "Two!"]
    assert one(T.paragraphs, "") == []


def test_sentences_and_quotes(one):
    assert one(T.sentences, "A b. “C?” D… e") == ["A b.", "“C?”", "D…", "e"]
    assert one(T.quotes, 'x “a” and "b" 「c」') == ["a", "b", "c"]
    assert one(T.quote_balance, "“a “b”") == 1


def test_speakable_of_long_runs(one):
    for run in (" ", "-", "* ", "\n", "* \n"):
        assert one(T.speakable, f"a{run * 100_000}b{run * 100_000}") == "a b"
        assert one(T.speakable, f"{run * 100_000}a") == "a"
    assert one(T.speakable, f"a -{' ' * 100_000}- b") == "a - - b"


def test_small_cleaners(one):
    assert one(T.decorative_only, " * * * ") is True
    assert one(T.decorative_only, "* 1") is False
    assert one(T.speakable, "*** Hello — — — world ~") == "Hello world"
    assert one(T.new_signs_removed, "a★", "a★b😀") == "a★b"
    assert one(T.title_of_file, "my_book-of  Xyz.final.epub") == "My Book Of Xyz.final"
    assert one(T.heading, "<h1 id='a'>The <i>End</i></h1>") == "The End"
    assert one(T.without_heading, " <h2>x</h2> <p>y</p>") == "<p>y</p>"
    assert one(lambda c: T.only_known_markers(c, ["laugh"]), "[laugh] a [sigh] b") == "[laugh] a  b"
    assert one(T.xml_escaped, '<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(T.image_sources, '<img alt="" src="a.png"/><img src="b.jpg">') == ["a.png", "b.jpg"]
    assert one(T.paragraphs_of_plain, "a\nb\n\nc & d") == "<p>a b</p>\n<p>c &amp; d</p>"
    assert one(T.cover_page, '<body class="x cover-page">') is True
    assert one(lambda c: T.chapter_file(c), "7") == "chapter007"


def test_faults_and_guards(one):
    assert one(T.fragment_fault, " ") == "empty"
    assert one(T.fragment_fault, "<p>a") == "unbalanced paragraph"
    assert one(T.fragment_fault, "plain") == "no block"
    assert one(T.fragment_fault, "<p>a</p>") is None
    assert one(T.keeps_content, "x" * 300, "y" * 100) is False
    assert one(T.keeps_content, "x", "y") is True
    assert one(lambda a, b: T.skip_reason(a, b, ["^Cover"]), "Cover", "z" * 300) == "title"
    assert one(lambda a, b: T.skip_reason(a, b, ["^Cover"]), "One", "z") == "too short"


def test_repair(one):
    got = one(T.repaired_html, "<head></head><p>a ,b\r\nÃ©<o:p></o:p>", "vi")
    assert '<meta charset="utf-8"/>' in got and "a,b\né" in got and got.endswith("</p>")


def test_replace_all(one, spark):
    d = spark.createDataFrame([("xABCabcAby(", ["ab", "abc", "y("])], "t string, p array<string>")
    assert d.select(T.replace_all(F.col("t"), T.longest_first(F.col("p")))).first()[0] == "x"


def test_names(one):
    assert one(N.fold, "Đặng Quỳnh Thoa") == "Dang Quynh Thoa"
    assert one(N.canonical, " Đặng-Quỳnh  (Thoa) ") == "dang quynh thoa"
    assert one(N.loose, "Lê-Lan") == "lelan"
    assert one(N.loose, "!") is None
    assert one(N.without_honorific, "Yến Vương điện hạ") == "yến vương"
    assert one(N.without_honorific, "điện hạ") is None
    assert one(N.relationship, " Mẹ nuôi ") == "mother"
    assert one(N.relationship, "neighbour ") == "neighbour"
    assert one(N.word_jaccard, "Linh Hồng", "linh") == 0.5
    assert one(N.fold_method, "Lộc", "Loc") == "normalized"
    assert one(N.fold_method, "Linh Hồng", "Linh") == "substring"
    assert one(N.proper_names, "Y Đằng Long came, then Anna Bell.") == ["Y Đằng Long", "Anna Bell"]
    assert one(N.valid_name, "Anna Bell") is True
    assert one(N.valid_name, "anna bell") is False


@pytest.mark.parametrize(("method", "n", "lines", "wanted"), [("exact", 1, 0, 0.95), ("llm", 1, 9, 0.8), ("substring", 5, 1, 0.65), ("other", 0, 0, 0.5)])
def test_alias_confidence(spark, method, n, lines, wanted):
    d = spark.createDataFrame([("Linh", "Lin", method, n, lines)], "a string, b string, m string, n int, l int")
    assert d.select(N.alias_confidence(*[F.col(c) for c in "abmnl"])).first()[0] == wanted


def test_emotion(spark):
    d = spark.createDataFrame([("Cô khóc rồi đánh",), ("Không có gì!!!",), ("phòng không",), ("hét lên rồi khóc",)], "t string")
    got = [r[0] for r in d.select(S.emotion(F.col("t"), F.lit(1.0), F.lit(0.5), F.lit(1.0))).collect()]
    assert [g.emotion for g in got] == ["excited", "angry", "neutral", "sad"]
    assert (round(got[0].speed, 2), round(got[0].noise_scale, 2)) == (1.22, 0.76)


def test_hashes(one):
    def plain(s, h, times):
        for c in s:
            h = (h * times + ord(c) + (1 << 31)) % (1 << 32) - (1 << 31)
        return h

    for s in ("", "Lan", "Nguyễn Ánh"):
        assert one(lambda c: S.slot(c, 6), s) == abs(plain(s, 0, 31)) % 6
        assert one(lambda c: S.variant(c, 5), s) == plain(s, 5381, 33) % (1 << 32) % 5
    assert one(lambda a, b: S.config_hash(["c1", "c0"]), "x", "y") == hashlib.sha256(b'{"c0":"x","c1":"y"}').hexdigest()


def test_scores(spark, one):
    assert one(S.least_score, " Kinh_Di ") == 0.36
    assert one(S.least_score, None) == 0.42
    d = spark.createDataFrame([(1, "the caravan of soldiers at the river side road"), (2, None)], "id int, t string")
    got = {r.id: r for r in S.genre_scores(d, "t", "id", {"a": {"strong": ["caravan"], "words": ["soldier"], "bonus": []}, "b": {"strong": [], "words": ["river"], "bonus": []}}).collect()}
    assert (got[1].genre, got[1].score) == ("a", 5.0)
    assert (got[2].genre, got[2].confidence) == ("unknown", 0.0)


def test_boilerplate(spark, rows):
    html = "<p>Visit our site</p><p>Chapter text {}</p>"
    d = spark.createDataFrame([("b", f"c{i}", html.format(i)) for i in range(5)] + [("b", "c0", html.format(0)), ("x", "y", html), (None, "z", html)], "book string, ch string, html string")
    counts = B.phrase_counts(d, "book", "ch", T.phrases(F.col("html")))
    assert rows(B.boilerplate(counts), "book", "phrase", "chapters", "total") == [("b", "Visit our site", 5, 5)]
    assert B.candidates(counts, "book").count() == 1
    memory = spark.createDataFrame([("Visit our site", 2, 1)], "phrase string, hits long, last_seen long")
    assert rows(B.remembered(memory, B.boilerplate(counts), F.lit(9))) == [("Visit our site", 3, 9)]
    assert B.new_phrases(B.boilerplate(counts), memory).count() == 0


def test_strip(spark):
    html = '<div class="h"><a href="x">Visit</a> our site</div>\n<p>keep</p> visit our site!<p>open'
    assert B.stripped(html, ["our", "visit our site", ""]) == "<p>keep</p> !<p>open"
    assert B.hits(html, "visit our site") == 2
    d = spark.createDataFrame([(1, html, ["visit our site"]), (2, None, ["x"]), (3, "<p>a</p>", None)], "id int, html string, p array<string>")
    got = {r.id: (r.html, r.hits) for r in B.strip_elements(d, "id", "html", "p").collect()}
    assert got == {1: ("<p>keep</p> !<p>open", 2), 2: (None, 0), 3: ("<p>a</p>", 0)}
