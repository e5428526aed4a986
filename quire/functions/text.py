"""Functions on text and HTML, as Column expressions that stay in the JVM. Lengths count code points.

Every function gives null for null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, the tags that end a block, entities that are decoded, and quotation marks.
SPACE = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
BLOCK_END = "(?i)</(?:p|h[1-6]|div|li|blockquote|pre|tr)>|<\\s*br\\s*/?\\s*>|\\r?\\n"
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
QUOTE_OPEN, QUOTE_CLOSE = "\"“”'‘「『", "\"“”'‘」』"
# Sentence marks, ornaments read as silence, file endings that are taken in.
SENTENCE = "[^.!?…]+[.!?…]*[”\"’»]?|[.!?…]+[”\"’»]?"
ORNAMENTS = "[*~•◆◇■□●○★☆※♦♥♠♣✦✧❖_=—–-]"
UPLOAD_ENDINGS = ("epub", "html", "htm", "txt")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def decode(text: Column) -> Column:
    """Six common entities, one after the other."""
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def without_code(html: Column) -> Column:
    """Style and script elements become a space."""
    return F.regexp_replace(html, "(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>", " ")


def html_to_text(html: Column) -> Column:
    """Plain text of a fragment: code and tags become spaces, entities are decoded, white space is collapsed."""
    return collapse(decode(F.regexp_replace(without_code(html), "<[^>]+>", " ")))


def body(html: Column) -> Column:
    """What stands in the body, or all of it where there is none."""
    inner = F.regexp_extract(html, "(?is)<body[^>]*>(.*?)</body>", 1)
    return F.when(html.rlike("(?is)<body[^>]*>.*?</body>"), inner).otherwise(html)


def phrases(html: Column, shortest: int = 4, longest: int = 200) -> Column:
    """Distinct texts of blocks, within length bounds, without headings that only name the chapter."""
    blocks = F.split(without_code(body(html)), BLOCK_END)
    heading = "(?is)^\\s*(?:</?\\s*(?:section|article|main|aside|nav|header|footer)\\b[^>]*>\\s*)*<\\s*h[1-6]\\b"
    texts = F.transform(blocks, lambda b: F.struct(b.rlike(heading).alias("h"), html_to_text(b).alias("t")))
    kept = F.filter(texts, lambda x: F.length(x["t"]).between(shortest, longest) & ~(x["h"] & x["t"].rlike("(?i)^Chương\\s+\\d+")))
    return F.array_distinct(F.transform(kept, lambda x: x["t"]))


def line_phrases(text: Column, shortest: int = 4, longest: int = 200) -> Column:
    """Distinct lines of a plain text within length bounds, white space collapsed."""
    lines = F.transform(F.split(text, "\\r?\\n"), collapse)
    return F.array_distinct(F.filter(lines, lambda x: F.length(x).between(shortest, longest)))


def paragraphs(html: Column) -> Column:
    """Block elements as array of (index, start, end, text); places count in the texts joined by one sign.

    Without block elements lines are taken, and of a single line its sentences.
    """
    clean = lambda t: collapse(F.regexp_replace(without_code(decode(t)), "<[^>]+>", " "))
    blocks = F.filter(F.transform(F.regexp_extract_all(html, F.lit("(?is)<(p|h[1-6]|li|blockquote)\\b[^>]*>(.*?)</\\1>"), F.lit(2)), clean), lambda t: t != "")
    plain = clean(html)
    sentences_of = F.filter(F.transform(F.regexp_extract_all(plain, F.lit("[^.!?…\"”]+[.!?…\"”]?"), F.lit(0)), lambda x: trimmed(x)), lambda t: t != "")
    texts = F.when(F.size(blocks) > 0, blocks).when(F.size(sentences_of) > 0, sentences_of).when(plain != "", F.array(plain)).otherwise(F.array().cast("array<string>"))
    return with_places(texts)


def with_places(texts: Column) -> Column:
    """Texts as (index, start, end, text), each start one after the end before."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<index:int,start:int,end:int,text:string>>").alias("out"))

    def step(acc, t):
        end = acc["at"] + F.length(t)
        row = F.struct(F.size(acc["out"]).alias("index"), acc["at"].alias("start"), end.alias("end"), t.alias("text"))
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(texts, zero, step, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    """Simple sentences of one paragraph: up to a run of end marks with its closing quote."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda x: trimmed(x)), lambda t: t != "")


def quotes(text: Column) -> Column:
    """Contents of quotations, from an opening mark to the next closing one of any style."""
    return F.regexp_extract_all(text, F.lit(f"[{QUOTE_OPEN}]([^{QUOTE_CLOSE}]*)[{QUOTE_CLOSE}]"), F.lit(1))


def quote_balance(text: Column) -> Column:
    """Opening minus closing curly quotes."""
    return F.regexp_count(text, F.lit("[“「『]")) - F.regexp_count(text, F.lit("[”」』]"))


def decorative_only(text: Column) -> Column:
    """Whether a text has no letter and no digit."""
    return ~text.rlike("[\\p{L}\\p{N}]")


def speakable(text: Column) -> Column:
    """Without clusters of three or more ornaments, without ornaments at the ends, white space collapsed."""
    either = f"[\\s{ORNAMENTS[1:-1]}]"  # one class, since a repeated group takes a stack frame for every sign of a run
    out = F.regexp_replace(text, f"{ORNAMENTS}\\s*+{ORNAMENTS}\\s*+{ORNAMENTS}(?:{either}*{ORNAMENTS})?", " ")
    return collapse(F.regexp_replace(out, f"^{either}++|(?<!{either}){either}++$", ""))


def new_signs_removed(source: Column, output: Column) -> Column:
    """``output`` without signs above U+2000 that are neither letters nor in ``source``."""
    return F.array_join(F.filter(F.split(output, ""), lambda c: ~c.rlike("^[\\x{2190}-\\x{2BFF}\\x{FE0F}\\x{1F000}-\\x{1FAFF}]$") | F.contains(source, c)), "")


def keeps_content(source: Column, output: Column, low: float = 0.55, high: float = 1.45) -> Column:
    """Whether a rewrite keeps its length within bounds; a source under 200 signs only needs some output."""
    a, b = F.length(F.regexp_replace(source, SPACE, "")), F.length(F.regexp_replace(output, SPACE, ""))
    return F.when(a < 200, b > 0).otherwise((b / a).between(low, high))


def fragment_fault(html: Column) -> Column:
    """The first fault of a rewritten fragment, or null."""
    opened, closed = F.regexp_count(html, F.lit("(?i)<p\\b[^>]*>")), F.regexp_count(html, F.lit("(?i)</p>"))
    return (
        F.when(F.trim(html) == "", "empty")
        .when(F.contains(html, F.lit("```")), "fence")
        .when(html.rlike("(?i)<(?:script|style|iframe|object|embed)\\b"), "unsafe tag")
        .when(html.rlike("(?i)<h1\\b"), "top heading")
        .when(~html.rlike("(?i)<(?:p|div|blockquote|ul|ol|h[2-6])\\b"), "no block")
        .when(opened != closed, "unbalanced paragraph")
    )


# Titles of chapters that are no story.
NO_STORY = (
    "cover|bìa|trang bìa", "mục lục|table of contents", "lời mở đầu|lời giới thiệu|lời tựa|lời nói đầu|lời dẫn|prologue|foreword|preface", "giới thiệu|introduction",
    "tác giả|author|about the author|về tác giả", "bản quyền|copyright|copy right", "lời cảm ơn|acknowledg(?:e|ment)s", "phụ lục|appendix", "chương\\s*0|chapter\\s*0",
)


def no_story(title: Column, html: Column, least: int = 200) -> Column:
    """Why a chapter is skipped before any model is asked: 'too short', 'title', or null."""
    size = F.length(collapse(F.regexp_replace(html, "<[^>]+>", " ")))
    return F.when(size < least, "too short").when(F.trim(title).rlike(f"(?iu)^(?:{'|'.join(NO_STORY)})$"), "title")


def block_text(html: Column) -> Column:
    """Text of a page with a line end at every block; entities decoded, blanks collapsed, at most one empty line."""
    t = F.regexp_replace(html, "(?is)<(?:script|style|head)\\b[^>]*>.*?</(?:script|style|head)>", " ")
    blocks = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
    t = decode(F.regexp_replace(F.regexp_replace(t, f"(?i)</?(?:{blocks})\\b[^>]*>", "\n"), "<[^>]+>", " "))
    t = F.regexp_replace(F.regexp_replace(t, "\\r\\n?", "\n"), SPACE.replace("\\n", "").replace("\\r", "") + "+", " ")
    return trimmed(F.regexp_replace(F.regexp_replace(t, " *\\n *", "\n"), "\\n\\s*\\n+", "\n\n"))


def sidecar_text(html: Column) -> Column:
    """Text of a page with a line end where a block closes; other tags leave nothing, six entities are decoded."""
    t = F.regexp_replace(html, "(?is)<script.*?</script>|<style.*?</style>|<head.*?</head>", " ")
    t = decode(F.regexp_replace(F.regexp_replace(t, "(?i)</(?:p|div|section|h[1-6]|li|br)>", "\n"), "<[^>]+>", ""))
    return trimmed(F.regexp_replace(F.regexp_replace(t, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n"))


def lines_with_places(text: Column) -> Column:
    """Lines as array of (start, end, text) without blanks at their ends; of a long single line (over 1,500 signs) its sentences of up to 400."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def placed(parts: Column, gap: int) -> Column:
        def step(acc, raw):
            kept = trimmed(raw)
            start = acc["at"] + F.length(raw) - F.length(F.regexp_replace(raw, f"^{SPACE}+", ""))
            row = F.struct(start.alias("start"), (start + F.length(kept)).alias("end"), kept.alias("text"))
            return F.struct((acc["at"] + F.length(raw) + gap).alias("at"), F.when(kept == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

        return F.aggregate(parts, zero, step, lambda acc: acc["out"])

    lines = placed(F.split(text, "\n"), 1)
    pieces = F.regexp_extract_all(text, F.lit("(?s)[^.!?\\n]{1,400}[.!?…\"]+\\s+|.[^.!?\\n]*"), F.lit(0))
    return F.when((F.size(lines) <= 1) & (F.length(text) > 1500), placed(pieces, 0)).otherwise(lines)


def skip_reason(title: Column, text: Column, patterns: Sequence[str], least: int = 200) -> Column:
    """Why a chapter is no story, or null: its title, or too little text."""
    out = F.when(F.length(F.trim(text)) < least, "too short")
    for p in patterns:
        out = out.when(title.rlike(p), "title")
    return out


def chapter_file(number: Column) -> Column:
    return F.concat(F.lit("chapter"), F.lpad(number.cast("string"), 3, "0"))


def title_of_file(name: Column) -> Column:
    """A title from a file name: no ending, separators as spaces, each word's first letter large, the rest as it is."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(name, "\\.[^.]+$", ""), "[_\\-\\s]+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")


def heading(html: Column) -> Column:
    """Text of the first heading, null without one."""
    return F.nullif(html_to_text(F.regexp_extract(html, "(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]>", 1)), F.lit(""))


def without_heading(html: Column) -> Column:
    """Without a heading at the very beginning."""
    return F.regexp_replace(html, "(?is)^\\s*<h[1-6]\\b[^>]*>.*?</h[1-6]>\\s*", "")


def repaired_html(html: Column, language: Column) -> Column:
    """Missing charset, broken encodings, unclosed paragraphs, office noise, spaces before marks, line ends."""
    out = F.when(F.contains(F.lower(html), F.lit("charset=utf-8")), html).otherwise(F.regexp_replace(html, "^(.*?<head[^>]*>)", '$1\n<meta charset="utf-8"/>'))
    for bad, good in {"Â·": "·", "Ã©": "é", "Ã ": "à"}.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    missing = F.greatest(F.regexp_count(out, F.lit("(?i)<p[^/]*>")) - F.regexp_count(out, F.lit("(?i)</p>")), F.lit(0))
    out = F.concat(out, F.repeat(F.lit("</p>"), missing))
    out = F.regexp_replace(F.regexp_replace(out, "(?i)<o:p></o:p>", ""), "(?i)mso-[^;\"]+(;|\")", "$1")
    out = F.when(language.isin("vi", "mixed"), F.regexp_replace(out, "\\s+([,.:!?;])", "$1")).otherwise(out)
    return F.regexp_replace(out, "\\r\\n?", "\n")


def cover_page(html: Column) -> Column:
    return html.rlike("(?i)<body\\b[^>]*class=[\"'][^\"']*\\bcover-page\\b|epub:type=[\"'][^\"']*\\b(?:cover|frontmatter)\\b")


def image_sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)<img\\b[^>]*?\\bsrc=\"([^\"]*)\""), F.lit(1))


def only_known_markers(text: Column, allowed: Sequence[str]) -> Column:
    """Without bracketed tokens of up to 16 signs, but for those allowed."""
    return F.regexp_replace(text, f"(?i)\\[(?!(?:{'|'.join(allowed)})\\])[^\\[\\]]{{1,16}}\\]", "")


def xml_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def accented_latin(text: Column) -> Column:
    return text.rlike("[\\u00C0-\\u024F\\u1E00-\\u1EFF]")


def paragraphs_of_plain(text: Column) -> Column:
    """A plain text as HTML: blank lines part paragraphs, single line ends become spaces."""
    parts = F.filter(F.transform(F.split(text, "\\r?\\n\\s*\\r?\\n"), lambda x: trimmed(x)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.regexp_replace(xml_escaped(p), "\\r?\\n", " "), F.lit("</p>"))), "\n")


def replace_all(text: Column, phrases_longest_first: Column) -> Column:
    """Every phrase removed, whatever its case, one after the other."""
    quoted = lambda p: F.concat(F.lit("(?i)\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.aggregate(phrases_longest_first, text, lambda acc, p: F.regexp_replace(acc, quoted(p), F.lit("")))


def longest_first(phrases_: Column) -> Column:
    """Distinct non-empty phrases, the longest first, ties by content."""
    d = F.array_distinct(F.filter(F.transform(phrases_, lambda x: trimmed(x)), lambda p: p != ""))
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(d, order)


def seconds_of_audio(size_bytes: Column, rate: int = 24_000, width: int = 2) -> Column:
    """Duration of plain audio samples from their size."""
    return F.round(size_bytes / (rate * width), 3)
