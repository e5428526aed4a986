"""Queries over text, HTML and boilerplate, with their SQL where its regular expressions suffice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.functions import scores as S
from quire.functions import text as T
from quire.operators import boilerplate as B
from quire.session import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_SP = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_COLLAPSE = lambda x: f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))"
_DECODE = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
_NOCODE = lambda x: f"regexp_replace({x}, '(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>', ' ', 'g')"
_PLAIN = lambda x: _COLLAPSE(_DECODE(f"regexp_replace({_NOCODE(x)}, '<[^>]+>', ' ', 'g')"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _chapters(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return read_table(spark, sf, "chapters").select("chapter_id", *columns).distinct()


_LINES = f"""l as (select distinct source, doc_id, {_COLLAPSE('x')} as phrase from (select source, doc_id, unnest(string_split_regex(text, '\\r?\\n')) as x from documents where source is not null)),
c as (select source, phrase, count(*) as chapters from l where length(phrase) between 4 and 200 group by 1, 2),
n as (select source, count(distinct doc_id) as total from documents where source is not null group by 1),
p as (select * from c join n using (source))"""


def _line_counts(spark, sf):
    docs = read_table(spark, sf, "documents")
    return B.phrase_counts(docs, "source", "doc_id", T.line_phrases(F.col("text")))


@query(f"with {_LINES} select source, phrase, chapters, total from p where total >= 2 and chapters >= greatest(2, (total * 1 + 99) // 100)")
def boilerplate_phrases(spark, sf):
    """Lines that many documents of one source share; the threshold is 1 percent here, 40 by default."""
    return B.boilerplate(_line_counts(spark, sf), percent=1)


@query(f"""with {_LINES}, r as (select *, row_number() over (partition by source order by chapters desc, length(phrase) desc, phrase) as rank from p where chapters >= greatest(2, total // 100))
select source, phrase, chapters, total, rank, round(100.0 * chapters / total) as pct from r where rank <= 50""")
def boilerplate_candidates_topk(spark, sf):
    return B.candidates(_line_counts(spark, sf), "source", percent=1, k=50)


@query(f"""with {_LINES}, f as (select source, phrase from p where total >= 2 and chapters >= greatest(2, (total + 99) // 100))
select f.source, f.phrase from f anti join (select source, phrase from p where chapters >= 4 and source = 'epub_import') k on k.phrase = f.phrase""")
def boilerplate_new_vs_memory(spark, sf):
    counts = _line_counts(spark, sf)
    known = counts.where("chapters >= 4 and source = 'epub_import'")
    return B.new_phrases(B.boilerplate(counts, percent=1).select("source", "phrase"), known).select("source", "phrase")


@query()
def chapter_boilerplate(spark, sf):
    """The same over the blocks of chapters of one book."""
    c = _chapters(spark, sf, "book_id", "html")
    return B.boilerplate(B.phrase_counts(c, "book_id", "chapter_id", T.phrases(F.col("html"))), percent=10)


@query()
def stripped_chapters(spark, sf):
    """Every chapter without the boilerplate of its book, the hits, and by how much it shrank."""
    c = _chapters(spark, sf, "book_id", "html")
    found = chapter_boilerplate(spark, sf).groupBy("book_id").agg(F.collect_set("phrase").alias("phrases"))  # a book's phrases: few, each in a tenth of its chapters
    d = c.join(found, "book_id", "left")
    out = B.strip_elements(d, "chapter_id", "html", "phrases")
    return out.select("chapter_id", "hits", F.length("html").alias("chars"), F.md5("html").alias("digest"))


@query("""with h as (select chapter_id, html, ['the', 'một'] as p from (select distinct chapter_id, html from chapters))
select chapter_id, length(regexp_replace(regexp_replace(html, '(?i)một', '', 'g'), '(?i)the', '', 'g')) as chars,
length(html) - length(regexp_replace(html, '(?i)the', '', 'g')) as the_chars from h""")
def inline_phrases_removed(spark, sf):
    """Ordered removal of phrases inside the JVM, whatever their case."""
    html = F.col("html")
    out = T.replace_all(html, T.longest_first(F.array(F.lit("the"), F.lit(" một "), F.lit("the"))))
    return _chapters(spark, sf, "html").select("chapter_id", F.length(out).alias("chars"), (F.length(html) - F.length(F.regexp_replace(html, "(?i)the", ""))).alias("the_chars"))


@query(f"select chapter_id, {_PLAIN('html')} as text from (select distinct chapter_id, html from chapters)")
def page_text(spark, sf):
    return _chapters(spark, sf, "html").select("chapter_id", T.html_to_text(F.col("html")).alias("text"))


@query()
def page_paragraphs(spark, sf):
    d = _chapters(spark, sf, "html").select("chapter_id", F.explode(T.paragraphs(F.col("html"))).alias("p"))
    return d.select("chapter_id", "p.index", "p.start", "p.end", "p.text")


@query("""select chapter_id, u.i - 1 as idx, u.t as text from (select chapter_id, unnest([struct_pack(i := i, t := l[i]) for i in range(1, len(l) + 1)]) as u from
(select chapter_id, list_filter([trim(x) for x in regexp_extract_all(html, '(?is)<div class="b"><p>(.*?)</p></div>', 1)], lambda x: x <> '') as l from (select distinct chapter_id, html from chapters)))""")
def block_texts(spark, sf):
    """Blocks of one style with their index."""
    got = F.filter(F.transform(F.regexp_extract_all("html", F.lit('(?is)<div class="b"><p>(.*?)</p></div>'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return _chapters(spark, sf, "html").select("chapter_id", F.posexplode(got).alias("idx", "text"))


@query(f"""with s as (select para_id, unnest(list_filter([regexp_replace(x, '^{_SP}+|{_SP}+$', '', 'g') for x in regexp_extract_all(text, '{T.SENTENCE}', 0)], lambda x: x <> '')) as t from (select distinct para_id, text from paragraphs where text is not null))
select para_id, count(*) as sentences, sum(length(t)) as chars from s group by 1""")
def page_sentences(spark, sf):
    """Simple sentences per paragraph, by end marks only."""
    p = read_table(spark, sf, "paragraphs").select("para_id", "text").distinct().where("text is not null")
    return p.select("para_id", F.explode(T.sentences(F.col("text"))).alias("t")).groupBy("para_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("t")).alias("chars"))


@query(f"""select para_id, quote from (select para_id, unnest(regexp_extract_all(text, '[{T.QUOTE_OPEN.replace("'", "''")}]([^{T.QUOTE_CLOSE.replace("'", "''")}]*)[{T.QUOTE_CLOSE.replace("'", "''")}]', 1)) as quote from (select distinct para_id, text from paragraphs))""")
def quote_spans(spark, sf):
    p = read_table(spark, sf, "paragraphs").select("para_id", "text").distinct()
    return p.select("para_id", F.explode(T.quotes(F.col("text"))).alias("quote"))


@query("""with p as (select distinct para_id, chapter_id, para_index, text from paragraphs where chapter_id is not null),
b as (select *, len(regexp_extract_all(text, '[“「『]')) - len(regexp_extract_all(text, '[”」』]')) as d from p)
select para_id, coalesce(sum(d) over (partition by chapter_id order by para_index, para_id rows unbounded preceding), 0)::bigint as open_quotes from b""")
def open_quotes(spark, sf):
    """The balance of quotation marks carried through a chapter."""
    from pyspark.sql import Window

    p = read_table(spark, sf, "paragraphs").select("para_id", "chapter_id", "para_index", "text").distinct().where("chapter_id is not null")
    w = Window.partitionBy("chapter_id").orderBy("para_index", "para_id").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("para_id", F.coalesce(F.sum(T.quote_balance(F.col("text"))).over(w), F.lit(0)).alias("open_quotes"))


@query(r"select para_id, not regexp_matches(text, '[\p{L}\p{N}]') as decorative from (select distinct para_id, text from paragraphs)")
def decorative_only(spark, sf):
    return read_table(spark, sf, "paragraphs").select("para_id", "text").distinct().select("para_id", T.decorative_only(F.col("text")).alias("decorative"))


@query(r"""select chapter_id, len(regexp_extract_all(html, '(?i)<h[1-6]\b[^>]*>')) as headings, len(regexp_extract_all(html, '(?i)<p\b[^>]*>')) as opened, len(regexp_extract_all(html, '(?i)</p>')) as closed,
len(list_distinct(regexp_extract_all(html, '(?i)<img\b[^>]*?\bsrc="([^"]*)"', 1))) as images,
greatest(0, 100 - 20 * (case when html is null or html = '' then 1 else 0 end) - 5 * (case when not regexp_matches(html, '(?i)charset\s*=\s*["'']?utf-8') then 1 else 0 end
+ case when not contains(html, '<!DOCTYPE') and not contains(html, '<?xml') then 1 else 0 end)) as score from (select distinct chapter_id, coalesce(html, '') as html from chapters)""")
def page_validation_score(spark, sf):
    """Rule counts of a page and its score."""
    h = F.col("h")
    n = lambda p: F.regexp_count(h, F.lit(p))
    warnings = (~h.rlike("(?i)charset\\s*=\\s*[\"']?utf-8")).cast("int") + (~F.contains(h, F.lit("<!DOCTYPE")) & ~F.contains(h, F.lit("<?xml"))).cast("int")
    return _chapters(spark, sf, "html").withColumn("h", F.coalesce("html", F.lit(""))).select(
        "chapter_id", n("(?i)<h[1-6]\\b[^>]*>").alias("headings"), n("(?i)<p\\b[^>]*>").alias("opened"), n("(?i)</p>").alias("closed"),
        F.size(F.array_distinct(T.image_sources(h))).alias("images"), S.validation_score((h == "").cast("int"), warnings).alias("score"),
    ).distinct()


@query(f"""with t as (select chapter_id, {_PLAIN('html')} as p, html from (select distinct chapter_id, html from chapters)),
n as (select chapter_id, length(regexp_replace(html, '{_SP}', '', 'g')) as a, length(regexp_replace(p, '{_SP}', '', 'g')) as b from t)
select chapter_id, case when a < 200 then b > 0 else b::double / a between 0.55 and 1.45 end as kept from n""")
def preservation_guard(spark, sf):
    """Whether the plain text keeps enough of the page."""
    return _chapters(spark, sf, "html").select("chapter_id", T.keeps_content(F.col("html"), T.html_to_text(F.col("html"))).alias("kept"))


@query(r"""select chapter_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h2[^>]*>(.*?)</h2>', 1), '\s+', ' ', 'g')), '') as heading,
'chapter' || lpad(chapter_no::varchar, 3, '0') as file from (select distinct chapter_id, chapter_no, html from chapters)""")
def chapter_headings(spark, sf):
    return _chapters(spark, sf, "chapter_no", "html").select("chapter_id", T.heading(F.col("html")).alias("heading"), T.chapter_file(F.col("chapter_no")).alias("file"))


@query(r"""select chapter_id, case when length(trim(t)) < 200 then 'too short' when regexp_matches(title, '(?i)^(?:cover|contents|copyright|mục lục|lời tựa)') then 'title' end as reason
from (select chapter_id, title, """ + _PLAIN("html") + """ as t from (select distinct chapter_id, title, html from chapters))""")
def chapter_skip_reason(spark, sf):
    t = T.html_to_text(F.col("html"))
    return _chapters(spark, sf, "title", "html").select("chapter_id", T.skip_reason(F.col("title"), t, ["(?i)^(?:cover|contents|copyright|mục lục|lời tựa)"]).alias("reason"))


@query()
def fragment_faults(spark, sf):
    return _chapters(spark, sf, "html").select("chapter_id", T.fragment_fault(F.col("html")).alias("fault"))


@query()
def repaired_pages(spark, sf):
    return _chapters(spark, sf, "html").select("chapter_id", F.md5(T.repaired_html(F.col("html"), F.lit("vi"))).alias("digest"))


@query()
def speakable_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.speakable(F.col("text")).alias("text"))


@query(r"""select distinct source, title, regexp_replace(title, '"', '&quot;', 'g') as shown from (select source, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as title from documents where title is not null)""")
def feed_entries(spark, sf):
    """Escaped titles as a feed shows them."""
    d = read_table(spark, sf, "documents").where("title is not null")
    esc = T.xml_escaped(F.col("title"))
    return d.select("source", F.replace(esc, F.lit("&quot;"), F.lit('"')).alias("title"), esc.alias("shown")).distinct()


@query("""with r as (select doc_id, source, captured_at, row_number() over (partition by source order by captured_at desc, doc_id) as rank from documents where source is not null)
select doc_id, source, rank from r where rank <= 6""")
def newest_per_source(spark, sf):
    from quire.operators import relational as R

    return R.top_per_group(read_table(spark, sf, "documents").where("source is not null"), ["source"], [F.desc("captured_at"), F.asc("doc_id")], 6).select("doc_id", "source", "rank")


@query("""with r as (select distinct character_id, name, aliases from characters), a as (select character_id, name, len(aliases) as n, unnest(list_distinct(aliases)) as alias from r),
s as (select *, case when coalesce(name, '') = '' or coalesce(alias, '') = '' then 0 when lower(trim(name)) = lower(trim(alias)) then 1.0
else round(greatest(0, least(1, (0.6 + least(0.2, length(alias) % 5 * 0.05)) * case when n > 3 then pow(0.85, n - 3) else 1 end)), 2) end as score from a)
select character_id, alias, round(score, 2) as score, case when score >= 0.8 then 'high' when score >= 0.6 then 'medium' else 'low' end as tier from s""")
def alias_confidence(spark, sf):
    r = read_table(spark, sf, "characters").select("character_id", "name", "aliases").distinct()
    a = r.select("character_id", "name", F.size("aliases").alias("n"), F.explode(F.array_distinct("aliases")).alias("alias"))
    score = N.alias_confidence(F.col("name"), F.col("alias"), F.lit("llm"), F.col("n"), F.length("alias") % 5)
    return a.select("character_id", "alias", score.alias("score"), N.alias_tier(score).alias("tier"))


@query("""with r as (select distinct character_id, book_id, name, aliases from characters), a as (select book_id, name, len(aliases) as n, unnest(list_distinct(aliases)) as alias from r),
s as (select book_id, case when coalesce(name, '') = '' or coalesce(alias, '') = '' then 0 when lower(trim(name)) = lower(trim(alias)) then 1.0
else round(greatest(0, least(1, (0.6 + least(0.2, length(alias) % 5 * 0.05)) * case when n > 3 then pow(0.85, n - 3) else 1 end)), 2) end as score from a)
select book_id, count(*) as aliases, count(*) filter (score < 0.6) as low from s group by 1""")
def low_confidence_aliases(spark, sf):
    """Aliases per book, and those whose confidence is under the middle tier."""
    r = read_table(spark, sf, "characters").select("character_id", "book_id", "name", "aliases").distinct()
    a = r.select("book_id", "name", F.size("aliases").alias("n"), F.explode(F.array_distinct("aliases")).alias("alias"))
    score = N.alias_confidence(F.col("name"), F.col("alias"), F.lit("llm"), F.col("n"), F.length("alias") % 5)
    return a.groupBy("book_id").agg(F.count(F.lit(1)).alias("aliases"), F.count_if(score < N.MEDIUM).alias("low"))


@query("""select character_id, case when role in ('main', 'supporting', 'minor', 'crowd') then role when len(coalesce(aliases, [])) >= 3 then 'main' when len(coalesce(aliases, [])) = 0 then 'minor' else 'supporting' end as role
from (select distinct character_id, role, aliases from characters)""")
def picked_roles(spark, sf):
    return read_table(spark, sf, "characters").select("character_id", "role", "aliases").distinct().select("character_id", N.role_by_aliases(F.col("role"), F.col("aliases")).alias("role"))


@query(f"select character_id, lower({N.fold_sql('name')}) as folded from (select distinct character_id, name from characters)")
def name_folded_all(spark, sf):
    d = read_table(spark, sf, "characters").select("character_id", "name").distinct()
    return d.select("character_id", F.lower(N.fold(F.col("name"))).alias("folded"))


@query(f"""with c as (select distinct character_id, book_id, {N.canonical_sql('name')} as canon from characters)
select book_id, canon, count(*) as records from c where canon <> '' group by 1, 2""")
def name_canonical_all(spark, sf):
    d = read_table(spark, sf, "characters").select("character_id", "book_id", N.canonical(F.col("name")).alias("canon")).distinct()
    return d.where("canon <> ''").groupBy("book_id", "canon").agg(F.count(F.lit(1)).alias("records"))


@query(f"""with w as (select doc_id, list_distinct(list_filter(string_split({N.canonical_sql('title')}, ' '), lambda x: x <> '')) as a, list_distinct(list_filter(string_split({N.canonical_sql('source')}, ' '), lambda x: x <> '')) as b from documents)
select doc_id, case when a is null or b is null or len(list_distinct(list_concat(a, b))) = 0 then 0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end as jaccard from w""")
def word_jaccard_all(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", N.word_jaccard(F.col("title"), F.col("source")).alias("jaccard"))


@query()
def novel_names(spark, sf):
    """Capitalised names in English texts that no record of the book has, by frequency."""
    p = read_table(spark, sf, "paragraphs").select("para_id", "book_id", "text").distinct()
    found = p.select("book_id", F.explode(N.proper_names(F.col("text"))).alias("name")).withColumn("canon", N.canonical(F.col("name")))
    known = read_table(spark, sf, "characters").select("book_id", N.canonical(F.col("name")).alias("canon")).distinct()
    return found.join(known, ["book_id", "canon"], "left_anti").groupBy("book_id", "canon").agg(F.count(F.lit(1)).alias("places"), F.min("name").alias("name"))


@query()
def emotion_last_match(spark, sf):
    d = read_table(spark, sf, "synth_requests").select("request_id", "text", "speed").distinct().where("text is not null")
    e = S.emotion(F.col("text"), F.coalesce("speed", F.lit(1.0)), F.lit(0.6), F.lit(1.0))
    return d.select("request_id", e.alias("e")).select("request_id", "e.emotion", F.round("e.speed", 4).alias("speed"), F.round("e.noise_scale", 4).alias("noise_scale"))


#: A small table of keywords in the languages of the test data; the operator takes any.
GENRES = {
    "adventure": {"strong": ["caravan", "đoàn người"], "words": ["soldier", "guards", "lính", "soldat"], "bonus": ["road", "river"]},
    "home": {"strong": ["kitchen", "gian bếp"], "words": ["tea", "porridge", "trà", "cháo"], "bonus": ["roof"]},
    "mystery": {"strong": ["unsent letter", "lá thư cũ"], "words": ["key", "chìa khóa", "stole"], "bonus": ["night"]},
}


@query(r"""with t as (select doc_id, lower(coalesce(text, '')) as t from documents), n as (select doc_id, case when length(t) < 30 then 0.6 else 1 end as f,
len(regexp_extract_all(t, 'caravan|đoàn người')) * 3.0 + len(regexp_extract_all(t, 'soldier|guards|lính|soldat')) * 2.0 + len(regexp_extract_all(t, 'road|river')) * 0.5 as adventure,
len(regexp_extract_all(t, 'kitchen|gian bếp')) * 3.0 + len(regexp_extract_all(t, 'tea|porridge|trà|cháo')) * 2.0 + len(regexp_extract_all(t, 'roof')) * 0.5 as home,
len(regexp_extract_all(t, 'unsent letter|lá thư cũ')) * 3.0 + len(regexp_extract_all(t, 'key|chìa khóa|stole')) * 2.0 + len(regexp_extract_all(t, 'night')) * 0.5 as mystery from t),
r as (select doc_id, f, list_reverse_sort([struct_pack(s := adventure * f, g := 'adventure'), struct_pack(s := home * f, g := 'home'), struct_pack(s := mystery * f, g := 'mystery')]) as r from n),
s as (select doc_id, r[1].s as score, r[1].g as g, r[2].s as second, r[1].s + r[2].s + r[3].s as total from r)
select doc_id, case when score >= 1 then g else 'unknown' end as genre, score::double as score,
case when score >= 1 then round(0.5 * score / total + 0.5 * (score - second) / score, 4) else 0 end::double as confidence from s""")
def genre_score(spark, sf):
    return S.genre_scores(read_table(spark, sf, "documents"), "text", "doc_id", GENRES)


@query()
def stable_hash_slot(spark, sf):
    d = read_table(spark, sf, "characters").select("character_id", "name").distinct().where("name is not null")
    return d.select("character_id", S.slot(F.col("name"), 6).alias("slot"), S.variant(F.col("name"), 4).alias("variant"))


@query("""with c as (select distinct character_id, gender, role from characters), v as (select * from (values ('v1', 'female', 'young'), ('v2', 'female', 'mature'), ('v3', 'male', 'young'), ('v4', 'male', 'old')) t(voice, g, a)),
s as (select c.character_id, v.voice, case when c.gender in ('male', 'female') then case when v.g = c.gender then 10 else -20 end else 0 end + case when c.role = 'main' and v.a = 'mature' then 3 else 0 end as score from c, v)
select character_id, min_by(voice, (-score, voice)) as voice, max(score) as score from s group by 1""")
def voice_assignment(spark, sf):
    """The best voice of a fixed catalog of four, ties by its name; the catalog is an array, so no join is needed."""
    catalog = [("v1", "female", "young"), ("v2", "female", "mature"), ("v3", "male", "young"), ("v4", "male", "old")]
    age = F.when(F.col("role") == "main", "mature").otherwise("none")
    rows = [F.struct((-S.voice_score(F.lit(g), F.lit(a), F.lit("x"), F.col("gender"), age, F.lit("unknown"))).alias("s"), F.lit(v).alias("v")) for v, g, a in catalog]
    d = read_table(spark, sf, "characters").select("character_id", "gender", "role").distinct().withColumn("best", F.array_min(F.array(*rows)))
    return d.groupBy("character_id").agg(F.min("best").alias("m")).select("character_id", F.col("m.v").alias("voice"), (-F.col("m.s")).alias("score"))


@query("""with p as (select distinct para_id, lower(text) as t from paragraphs where text is not null), h as (select * from (values ('tường', 'thường'), ('trước', 'chước'), ('số', 'xố'), ('giải', 'dải'), ('cách', 'kếch'), ('giữ', 'giữa')) x(a, b))
select para_id, a, b from p, h where contains(t, a) and contains(t, b)""")
def minimal_pairs(spark, sf):
    """Pairs of easily confused words that both occur; the pairs are a short fixed list."""
    pairs = [("tường", "thường"), ("trước", "chước"), ("số", "xố"), ("giải", "dải"), ("cách", "kếch"), ("giữ", "giữa")]
    t = F.lower("text")
    found = F.filter(F.array(*[F.when(F.contains(t, F.lit(a)) & F.contains(t, F.lit(b)), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in pairs]), lambda x: x.isNotNull())
    p = read_table(spark, sf, "paragraphs").select("para_id", "text").distinct().where("text is not null")
    return p.select("para_id", F.explode(found).alias("x")).select("para_id", "x.a", "x.b").distinct()
