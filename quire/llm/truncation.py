"""Problem 9: texts cut off by field limits or in transfer.

Lengths are recomputed under the encodings in which a field may have been measured; where one length of one source is
far more frequent than those near it, that is a hidden limit. Endings are then inspected: which marks, closing lines,
abbreviations and line ends are usual is counted over all lines of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

#: A length is a limit if at least so many texts have it ...
LEAST_AT_LIMIT = 6
#: ... and so many times the mean of the lengths near it, on either side.
LIMIT_RATIO = 4.0
NEAR = 8
#: A closing line is seen so often as a last line, and with at least this share of its places.
LEAST_CLOSING, CLOSING_SHARE, CLOSING_CHARS = 4, 0.7, 60

# Marks that end a sentence, signs that may close after them, what a broken transfer leaves behind.
END_MARKS = ".!?。！？…؟।"
CLOSERS = "\"'”’»“«」』)）\\]"
_CLOSING_SIGNS = CLOSERS.replace("\\", "")
_ENDED = f"[{END_MARKS}][ \\u00a0\\u2009\\u202f]?[{CLOSERS}]*$"
_DOTS = "(\u2026|\\.\\.\\.|\\[\u2026\\]|\\[\\.\\.\\.\\])$"
_BROKEN = "(\ufffd+|&#?[A-Za-z0-9]{0,8}|</?[A-Za-z]{0,8})$"
_OPENING = "^(\\S+(?: \\p{Ll}\\S*){0,2}:?) ?\\p{Lu}[\\p{L} .]*$"
#: Abbreviations before a name, a number or a noun, which close no sentence.
_OPENING_ABBREVIATIONS = (
    "ThS|PGS|GS|TS|BS|TP|Cty|tr|sđd|Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|Sgt|St|No|no|Vol|vol|ch|cf|vs|Hr|Fr|Nr|ca|bzw|Sr|Sra|Dra|Mlle|Mme|art|env|aprox"
    "|Проф|проф|стр|г|д|डॉ|पं|أ|د"
)
_BLANKS = " \t\r\u00a0\u2002\u2003\u2007\u2009\u202f\u3000"


def _with_core(docs: DataFrame) -> DataFrame:
    """Texts, and those with remains of a broken transfer once more without them."""
    whole = F.rtrim("text", F.lit("\ufffd"))  # a run of any length; the other remains have twelve signs at most
    end = F.right(whole, F.lit(12))
    kept = F.when(F.length(whole) < F.length("text"), F.regexp_replace(end, "\\s$", "")).otherwise(F.regexp_replace(end, f"\\s?{_BROKEN}", ""))
    lost = F.length("text") - F.length(whole) + F.length(end) - F.length(kept)
    texts = F.when(F.col("_lost") > 0, F.array("text", F.expr("left(text, length(text) - _lost)"))).otherwise(F.array("text"))
    return docs.withColumn("_lost", lost).withColumn("text", F.explode(texts)).drop("_lost")


def lengths(docs: DataFrame) -> DataFrame:
    """``docs`` with ``sizes``: the length of the text as different stores would have measured it."""
    signs = {"_amp": "&", "_lt": "<", "_gt": ">", "_quote": '"', "_line": "\n", "_tab": "\t", "_back": "\\"}
    octets = {c: F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit(sign))) for c, sign in signs.items()}
    d = docs.withColumns(octets | {"_points": F.length("text"), "_octets": F.octet_length("text"), "_utf16": F.octet_length(F.encode("text", "UTF-16BE")) / 2})
    points, size = F.col("_points"), F.col("_octets")
    entities = 4 * F.col("_amp") + 3 * F.col("_lt") + 3 * F.col("_gt")
    quotes = entities + 5 * F.col("_quote")
    json = F.col("_quote") + F.col("_line") + F.col("_tab") + F.col("_back")
    measures = {
        "chars": points,
        "bytes": size,
        "utf16": F.col("_utf16"),
        "chars, entities": points + entities,
        "chars, entities and quotes": points + quotes,
        "bytes, entities": size + entities,
        "bytes, entities and quotes": size + quotes,
        "chars, json": points + json,
        "bytes, json": size + json,
        "chars, crlf": points + F.col("_line"),
        "bytes, crlf": size + F.col("_line"),
    }
    d = d.withColumn("sizes", F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("int").alias("size")) for k, v in measures.items()]))
    return d.drop(*signs, "_points", "_octets", "_utf16")


def measured(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, measure, size)."""
    d = lengths(_with_core(docs.select("doc_id", "source", "text")))
    return d.select("doc_id", "source", F.explode("sizes").alias("m")).select("doc_id", "source", "m.measure", "m.size")


def hidden_limits(docs: DataFrame) -> DataFrame:
    """Lengths that one source has far more often than the lengths near them: (source, measure, size, texts).

    Copies of a text within a source count once, so a text that was copied many times makes no limit.
    """
    d = lengths(_with_core(docs.select("source", "text"))).groupBy("source", F.xxhash64("text").alias("_h")).agg(F.first("sizes").alias("sizes"))
    d = d.select("source", F.explode("sizes").alias("m")).groupBy("source", "m.measure", "m.size").agg(F.count(F.lit(1)).alias("texts"))
    near = Window.partitionBy("source", "measure").orderBy("size").rangeBetween(-NEAR, NEAR)
    d = d.withColumn("others", (F.sum("texts").over(near) - F.col("texts")) / (2 * NEAR))
    return d.where((F.col("texts") >= LEAST_AT_LIMIT) & (F.col("texts") >= LIMIT_RATIO * F.greatest("others", F.lit(0.5)))).drop("others")


def _keys(line: Column) -> Column:
    """What a line is counted by: itself without its numbers, its opening words before a name, its last word."""
    short = F.length(line) < CLOSING_CHARS
    shape = F.when(short, F.regexp_replace(line, "\\p{Nd}+", "0"))
    opening = F.when(short, F.regexp_extract(line, _OPENING, 1))
    word = F.substring_index(line, " ", -1)
    word = F.when(F.right(word, F.lit(1)).rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff\\u0e00-\\u0e7f]"), F.right(word, F.lit(2))).otherwise(word)
    key = lambda kind, v: F.when(v.isNotNull(), F.xxhash64(F.lit(kind), v))
    return F.array(key("line", shape), key("opening", opening), key("word", word))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(_BLANKS))), lambda x: x != "")


def _last_line(text: Column) -> Column:
    return F.rtrim(F.substring_index(text, "\n", -1), F.lit(_BLANKS))


def _without(text: Column, end: Column) -> Column:
    return F.left(text, F.length(text) - F.length(end))


def _inspected(docs: DataFrame) -> DataFrame:
    """Per document whose ending isn't plainly whole: what the ending and its last two lines show, and its sizes.

    A text with remains of a broken transfer has two rows, which differ in their sizes only. Lines count whole, however
    long they are; where only a few signs decide, only these are looked at. The explodes keep the optimizer from
    computing an ending anew in every condition on it.
    """
    once = lambda c: F.explode(F.array(c))
    d = docs.withColumn("tail", once(F.rtrim("text", F.lit(_BLANKS + "\n")))).where("tail <> ''")
    d = d.withColumn("end", once(F.right("tail", F.lit(16)))).withColumn("bare", once(F.right(F.rtrim("tail", F.lit(_CLOSING_SIGNS)), F.lit(2))))
    d = d.withColumns(
        {
            "dots": F.col("end").rlike(_DOTS),
            "broken": F.col("end").rlike(_BROKEN),
            "ended": F.col("bare").rlike(f"[{END_MARKS}][ \\u00a0\\u2009\\u202f]?$"),
            "short": F.regexp_extract("end", f"(?:^|[\\s(«“\"])((?:(?:{_OPENING_ABBREVIATIONS})\\.|\\p{{Nd}}{{1,3}}[.,]))$", 1),
        }
    )
    d = d.where("broken or dots or not ended or short <> ''").withColumn("line", once(_last_line(F.col("tail"))))
    above = F.rtrim(_without(F.col("tail"), F.substring_index("tail", "\n", -1)), F.lit(_BLANKS + "\n"))
    d = d.withColumn("before", once(_last_line(above)))
    dotted = F.regexp_extract("end", "\\s?(…|\\[…\\])$", 0)
    undotted = F.right(F.rtrim(_without(F.col("tail"), dotted), F.lit(_CLOSING_SIGNS)), F.lit(1))
    before_bare = F.right(F.rtrim("before", F.lit(_CLOSING_SIGNS)), F.lit(2))
    listed = "^[^:：]*\\p{Nd}+[^:：]{0,3}[:：] ?\\S"
    d = d.withColumns(
        {
            "keys": _keys(F.col("line")),
            "short_line": F.length("line") < CLOSING_CHARS,
            "after_line": F.col("before") != "",
            "has_opening": (F.length("line") < CLOSING_CHARS) & (F.regexp_extract("line", _OPENING, 1) != ""),
            "signs": (F.length("line") < CLOSING_CHARS) & F.col("line").rlike("^[(（].*[)）]$|^[\\p{P}\\p{S}\\s]+$"),
            "listed": F.col("line").rlike(listed),
            "was_listed": F.col("before").rlike(listed),
            "unmarked_before": (F.col("before") != "") & ~before_bare.rlike(f"[{END_MARKS}][ \\u00a0\\u2009\\u202f]?$"),
            "thai": F.right("tail", F.lit(12)).rlike("[\\u0e00-\\u0e7f]"),
            "dots_after_end": (dotted != "") & undotted.rlike("[.!?。！？؟।]"),
        }
    )
    return lengths(_with_core(d.drop("tail", "end", "bare", "line", "before"))).drop("text")


def truncated(docs: DataFrame) -> DataFrame:
    """Documents that were cut: (doc_id, source, reason).

    A text is cut if it ends with the remains of a broken transfer; with dots at a hidden limit; with an abbreviation or
    number that never ends a line; or without an end mark, unless its last line is a usual closing line or signature, or
    the line before has no end mark either (verse, lists of contents) and its last word is known as the end of a line,
    or it is Thai. Verse and Thai at a hidden limit of their source are cut too. Null and blank texts are whole. Rows
    with one doc_id count as one. A null source is a source of its own.
    """
    docs = docs.select("doc_id", "source", "text").where(F.col("text").isNotNull())
    limits = hidden_limits(docs)
    # a text whose source is unknown may be of any of them
    limits = limits.select("source", "measure", "size").unionAll(limits.where("measure in ('chars', 'bytes')").select(F.lit(None).cast("string"), "measure", "size"))
    suspects = cut(_inspected(docs))
    same = [F.col("m.source").eqNullSafe(F.col("l.source")), F.col("m.measure") == F.col("l.measure"), F.col("m.size") == F.col("l.size")]
    hit = suspects.select("doc_id", "source", F.explode("sizes").alias("m")).select("doc_id", "source", "m.measure", "m.size")
    hit = hit.alias("m").join(limits.alias("l"), same[0] & same[1] & same[2], "left_semi")
    hit = hit.select("doc_id").distinct().withColumn("at_limit", F.lit(True))
    suspects = suspects.drop("sizes").dropDuplicates(["doc_id"])
    # every line of every distinct text, by its keys: how often last, how often not; a text's copies count once
    lines = docs.select(F.xxhash64("text").alias("_h"), F.transform(_lines(F.col("text")), _keys).alias("keys")).dropDuplicates(["_h"])
    lines = lines.select(F.size("keys").alias("n"), F.posexplode("keys").alias("i", "line"))
    lines = lines.select(F.explode("line").alias("key"), (F.col("i") == F.col("n") - 1).cast("int").alias("last")).where("key is not null")
    known = lines.groupBy("key").agg(F.sum("last").alias("lasts"), F.sum(1 - F.col("last")).alias("inner"))
    asked = suspects.select("doc_id", F.posexplode("keys").alias("k", "key")).where("key is not null")
    told = asked.join(known, "key").groupBy("doc_id").agg(
        *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{name}_{c}") for k, name in enumerate(("line", "opening", "word")) for c in ("lasts", "inner")]
    )
    d = suspects.join(told, "doc_id", "left").join(hit, "doc_id", "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    usual = lambda name: (F.col(f"{name}_lasts") >= LEAST_CLOSING) & (F.col(f"{name}_lasts") >= CLOSING_SHARE * (F.col(f"{name}_lasts") + F.col(f"{name}_inner")))
    closing = F.col("short_line") & ((F.col("after_line") & (usual("line") | (F.col("has_opening") & usual("opening")))) | F.col("signs"))
    verse = F.col("unmarked_before") & (F.col("listed") | ~F.col("was_listed")) & (F.col("word_inner") >= 1) & ~F.col("at_limit")
    thai = F.col("thai") & ~F.col("at_limit")
    never_ends = (F.col("short") != "") & (F.coalesce("word_inner", F.lit(0)) == 0)
    reason = (
        F.when(F.col("broken"), "broken transfer")
        .when(F.col("dots"), F.when(F.col("at_limit") & ~F.col("dots_after_end"), "dots at a limit"))
        .when(never_ends, "abbreviation that ends no line")
        .when(F.col("ended"), None)
        .when(closing | verse | thai, None)
        .when(F.col("at_limit"), "no end mark, at a limit")
        .otherwise("no end mark")
    )
    return d.select("doc_id", "source", reason.alias("reason")).where("reason is not null").dropDuplicates(["doc_id"])


def truncation_by_source(docs: DataFrame) -> DataFrame:
    """Share of cut texts in each source: (source, texts, cut, share); null sources are one row."""
    hits = truncated(docs).select("doc_id", F.lit(1).alias("cut"))
    d = docs.select("doc_id", "source").join(hits, "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum("cut"), F.lit(0)).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("texts"), 6))
