"""Queries of the attribution fold and what is computed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import attribution as A
from quire.operators import narration as R
from quire.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _roster(spark, sf):
    """Characters of each book, and the capitalised names before a speech verb in its texts, which the test texts use."""
    known = read_table(spark, sf, "characters").select("book_id", "name", "aliases", "gender")
    p = read_table(spark, sf, "paragraphs").select("book_id", "text")
    found = p.select("book_id", F.explode(F.regexp_extract_all("text", F.lit("[,!?]” (\\p{Lu}\\p{L}+(?: \\p{Lu}\\p{L}+)?) (?:said|asked|answered|called|shouted|whispered|nói|hỏi|đáp)"), F.lit(1))).alias("name"))
    return known.unionByName(found.distinct().withColumns({"aliases": F.lit(None).cast("array<string>"), "gender": F.lit(None).cast("string")}))


def _texts(spark, sf):
    return read_table(spark, sf, "paragraphs").select("chapter_id", "book_id", "para_index", "text", "lang")


def _attributed(spark, sf, dialect: str = "reader"):
    """Speakers of all paragraphs: chapters whose labels are mostly English by the English cues, all others by the Vietnamese ones."""
    p = _texts(spark, sf)
    english = F.count_if(F.lower("lang").startswith("en")) * 2 >= F.count(F.lit(1))
    lang = p.where("chapter_id is not null").groupBy("chapter_id").agg(english.alias("english")).withColumnRenamed("chapter_id", "c")
    p = p.join(lang, F.col("chapter_id") == F.col("c"))
    roster = _roster(spark, sf)
    parts = [A.attribute(p.where("english" if e else "not english"), roster, A.ENGLISH if e else A.Cues(), dialect=dialect) for e in (True, False)]
    return parts[0].unionByName(parts[1])


@query()
def attribution_fold(spark: SparkSession, sf: str) -> DataFrame:
    d = _attributed(spark, sf)
    return d.select("chapter_id", "para_index", "speaker", F.round("confidence", 4).alias("confidence"), "source", F.size("evidence").alias("evidence"), "scene")


@query()
def attribution_second(spark, sf):
    """The second dialect over the same paragraphs."""
    d = _attributed(spark, sf, "second")
    return d.select("chapter_id", "para_index", "speaker", F.round("confidence", 4).alias("confidence"), "source")


@query()
def attribution_stats(spark, sf):
    return A.attribution_stats(_texts(spark, sf), _attributed(spark, sf))


@query()
def attribution_evidence(spark, sf):
    """How much each kind of evidence contributes."""
    d = _attributed(spark, sf).select(F.explode("evidence").alias("e"))
    return d.groupBy("e.kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("e.weight"), 3).alias("weight"))


@query()
def segments(spark, sf):
    """Every chapter as it is read aloud, quotation by quotation."""
    c = read_table(spark, sf, "chapters").select("chapter_id", "book_id", T.block_text(F.col("html")).alias("text"))
    return R.segments(c, _roster(spark, sf))


@query("""with p as (select distinct para_id, chapter_id, para_index, text from paragraphs where chapter_id is not null and text is not null),
f as (select *, case when row_number() over w > 1 and not regexp_matches(text, '["“”‘「『]') and (length(trim(text, ' ')) > 950 or regexp_matches(lower(text), '(?:^|\\s)(?:a year later|that morning|at dusk)[\\s,.]')) then 1 else 0 end as b from p window w as (partition by chapter_id order by para_index, para_id))
select para_id, sum(b) over (partition by chapter_id order by para_index, para_id rows unbounded preceding) as scene from f""")
def scene_segments(spark, sf):
    """Scenes by break cues and a running sum, where no state is needed."""
    w = Window.partitionBy("chapter_id").orderBy("para_index", "para_id")
    p = read_table(spark, sf, "paragraphs").select("para_id", "chapter_id", "para_index", "text").distinct().where("chapter_id is not null and text is not null")
    cue = (F.length(F.trim("text")) > 950) | F.lower("text").rlike("(?:^|[\\t\\n\\f\\r ])(?:a year later|that morning|at dusk)[\\t\\n\\f\\r ,.]")
    p = p.withColumn("b", ((F.row_number().over(w) > 1) & ~F.col("text").rlike("[\"“”‘「『]") & cue).cast("int"))
    return p.select("para_id", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("scene"))


@query()
def alternation(spark, sf):
    """Whether the last two speakers before a turn differ."""
    w = Window.partitionBy("chapter_id").orderBy("para_index")
    d = _attributed(spark, sf).where("speaker is not null").select("chapter_id", "para_index", "speaker")
    return d.withColumn("alternating", F.coalesce(F.lag("speaker").over(w) != F.lag("speaker", 2).over(w), F.lit(False)))


@query()
def voice_plan(spark, sf):
    """A character or the narrator for every sentence."""
    return R.voice_plan(_texts(spark, sf), _attributed(spark, sf), _roster(spark, sf))


@query()
def speaker_summary(spark, sf):
    """Per speaker of the plan: paragraphs, sentences spoken, and the chapters they stand in."""
    p = voice_plan(spark, sf).withColumn("speaker", F.coalesce("speaker", F.lit("narrator")))
    d = p.groupBy("speaker", "chapter_id", "para").agg(F.count(F.lit(1)).alias("sentences"))
    return d.groupBy("speaker").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("sentences").alias("sentences"), F.count_distinct("chapter_id").alias("chapters"))


@query()
def quoted_characters(spark, sf):
    """Paragraphs and the characters of their book that they name, names of any length and script; one scan per paragraph."""
    p = read_table(spark, sf, "paragraphs").select("para_id", "book_id", "text").distinct().where("text is not null")
    return A.named_characters(p, _roster(spark, sf))


@query()
def sentence_plan(spark, sf):
    """Sentences of each paragraph with their place, as a plan of what is read."""
    p = read_table(spark, sf, "paragraphs").select("para_id", "text").distinct().where("text is not null")
    return p.select("para_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "text"))
