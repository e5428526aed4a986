"""Catalog, status and summary queries over the library's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import entities as E
from quire.operators import relational as R
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


_LANG = "case when language is null or lower(language) = 'und' then 'unknown' else lower(language) end"


def _lang(column: str = "language"):
    return F.when(F.col(column).isNull() | (F.lower(column) == "und"), "unknown").otherwise(F.lower(column))


@query("""select book_id, title, author, added_at from (select distinct * from books) b
where language = 'vi' and (contains(lower(title), 'ch') or contains(lower(coalesce(author,'')), 'ch') or contains(lower(coalesce(series,'')), 'ch'))
order by added_at desc, book_id limit 200""")
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    """Conjunctive filters, one search over three columns, newest first, at most 200 as the API has it."""
    d = R.search(read_table(spark, sf, "books").distinct(), {"language": "vi", "series": None}, {"series": ""}, (["title", "author", "series"], "ch"))
    return d.select("book_id", "title", "author", "added_at").orderBy(F.desc("added_at"), "book_id").limit(200)


@query("select count(*) as books, count(last_read) as opened, count(distinct author) as authors, sum(file_size) as bytes from (select distinct * from books)")
def library_stats(spark, sf):
    return read_table(spark, sf, "books").distinct().agg(
        F.count(F.lit(1)).alias("books"), F.count("last_read").alias("opened"), F.countDistinct("author").alias("authors"), F.sum("file_size").alias("bytes")
    )


@query(f"select {_LANG} as lang, case when last_read is null then 'unread' else 'read' end as status, count(*) as books from (select distinct * from books) group by 1, 2")
def books_by_language_and_status(spark, sf):
    d = read_table(spark, sf, "books").distinct()
    return d.groupBy(_lang().alias("lang"), F.when(F.col("last_read").isNull(), "unread").otherwise("read").alias("status")).agg(F.count(F.lit(1)).alias("books"))


@query("select book_id, title, last_read from (select distinct * from books) where last_read is not null order by last_read desc, book_id limit 5")
def recently_read(spark, sf):
    return read_table(spark, sf, "books").distinct().where("last_read is not null").select("book_id", "title", "last_read").orderBy(F.desc("last_read"), "book_id").limit(5)


@query("""with b as (select distinct * from books where series is not null),
r as (select *, row_number() over (partition by series order by series_index nulls first, book_id) as rank, count(*) over (partition by series) as books from b)
select series, books, rank, book_id, title from r where rank <= 4""")
def shelf_preview(spark, sf):
    """A shelf's first four books and its size."""
    d = read_table(spark, sf, "books").distinct().where("series is not null")
    d = d.withColumn("books", F.count(F.lit(1)).over(Window.partitionBy("series")))
    return R.top_per_group(d, ["series"], [F.asc_nulls_first("series_index"), F.asc("book_id")], 4).select("series", "books", "rank", "book_id", "title")


@query("""select s.series, count(*) as books, count(b.last_read) as opened, round(avg(b.file_size / 1000.0), 3) as mean_kb, max(b.added_at) as newest
from (select distinct series from books where series is not null) s join (select distinct * from books) b on b.series = s.series group by 1""")
def shelf_detail(spark, sf):
    d = read_table(spark, sf, "books").distinct().where("series is not null")
    return d.groupBy("series").agg(
        F.count(F.lit(1)).alias("books"), F.count("last_read").alias("opened"), F.round(F.avg(F.col("file_size") / 1000.0), 3).alias("mean_kb"), F.max("added_at").alias("newest")
    )


@query("select b.book_id, b.title from (select distinct * from books) b where b.series is null or b.series not in (select series from books where series_index = 1)")
def library_minus_shelf(spark, sf):
    """Books that are on no shelf which has a first volume."""
    d = read_table(spark, sf, "books").distinct()
    return d.join(d.where("series_index = 1").select("series"), "series", "left_anti").select("book_id", "title")


@query("""select c.book_id, b.title, c.character_id, c.name, len(coalesce(c.aliases, [])) as n_aliases
from (select distinct * from characters) c left join (select distinct book_id, title from books) b using (book_id)""")
def characters_of_books(spark, sf):
    c = read_table(spark, sf, "characters").distinct()
    b = read_table(spark, sf, "books").select("book_id", "title").distinct()
    return c.join(b, "book_id", "left").select("book_id", "title", "character_id", "name", F.coalesce(F.size("aliases"), F.lit(0)).alias("n_aliases"))


@query("""with f as (select distinct character_id, alias from (select character_id, unnest(aliases) as alias from characters) where alias is not null and trim(alias) <> '')
select c.character_id, c.name, list_sort(list(f.alias) filter (f.alias is not null)) as aliases
from (select distinct character_id, name from characters) c left join f using (character_id) group by 1, 2""")
def character_with_aliases(spark, sf):
    """Left join and ordered collect."""
    c = read_table(spark, sf, "characters")
    f = c.select("character_id", F.explode("aliases").alias("alias")).where("alias is not null and trim(alias) <> ''").distinct()
    d = c.select("character_id", "name").distinct().join(f, "character_id", "left").groupBy("character_id", "name").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return d.withColumn("aliases", F.when(F.size("aliases") > 0, F.col("aliases")))


@query("""with e as (select distinct request_id, survivor_id, absorbed_id from merge_requests),
n as (select character_id, min(name) as name from characters group by 1)
select e.request_id, coalesce(a.name, '?') as survivor, coalesce(b.name, '?') as absorbed from e
left join n a on a.character_id = e.survivor_id left join n b on b.character_id = e.absorbed_id""")
def edges_with_names(spark, sf):
    """Two lookups on one dimension, '?' where there is none."""
    e = read_table(spark, sf, "merge_requests").select("request_id", "survivor_id", "absorbed_id").distinct()
    n = read_table(spark, sf, "characters").groupBy("character_id").agg(F.min("name").alias("name"))
    a = n.select(F.col("character_id").alias("survivor_id"), F.col("name").alias("a"))
    b = n.select(F.col("character_id").alias("absorbed_id"), F.col("name").alias("b"))
    d = e.join(a, "survivor_id", "left").join(b, "absorbed_id", "left")
    return d.select("request_id", F.coalesce("a", F.lit("?")).alias("survivor"), F.coalesce("b", F.lit("?")).alias("absorbed"))


@query("""with c as (select distinct chapter_id, book_id, chapter_no, title, filename from chapters),
t as (select book_id, chapter_no, min(title) as title from documents where title is not null group by 1, 2)
select c.chapter_id, coalesce(c.title, t.title, 'Chapter ' || c.chapter_no) as title from c left join t on t.book_id = c.book_id and t.chapter_no = c.chapter_no""")
def chapter_titles(spark, sf):
    """The title by one key, else by another, else made from the number."""
    c = read_table(spark, sf, "chapters").select("chapter_id", "book_id", "chapter_no", "title").distinct()
    t = read_table(spark, sf, "documents").where("title is not null").groupBy("book_id", "chapter_no").agg(F.min("title").alias("t"))
    d = c.join(t, ["book_id", "chapter_no"], "left")
    return d.select("chapter_id", F.coalesce("title", "t", F.concat(F.lit("Chapter "), F.col("chapter_no"))).alias("title"))


@query("""with c as (select distinct chapter_id, book_id from chapters), p as (select distinct chapter_id from paragraphs where chapter_id is not null)
select c.book_id, count(*) as chapters, count(p.chapter_id) as analysed from c left join p using (chapter_id) group by 1""")
def analysis_status(spark, sf):
    c = read_table(spark, sf, "chapters").select("chapter_id", "book_id").distinct()
    p = read_table(spark, sf, "paragraphs").select("chapter_id", F.lit(1).alias("done")).where("chapter_id is not null").distinct()
    return c.join(p, "chapter_id", "left").groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.count("done").alias("analysed"))


@query("""with h as (select distinct book_id, chapter_no from chapters where chapter_no is not null), m as (select book_id, max(chapter_no) as m from h group by 1),
p as (select book_id, unnest(range(1, m + 1))::int as chapter_no from m where m >= 1)
select p.book_id, p.chapter_no from p anti join h on h.book_id = p.book_id and h.chapter_no = p.chapter_no""")
def missing_chapters(spark, sf):
    return R.missing_numbers(read_table(spark, sf, "chapters"), ["book_id"], "chapter_no")


@query("""select chapter_id, book_id, chapter_no from (select distinct chapter_id, book_id, chapter_no, title from chapters)
where chapter_no between 3 and 7 and not coalesce(title = 'Chapter 5', false)""")
def chapter_range(spark, sf):
    d = read_table(spark, sf, "chapters").select("chapter_id", "book_id", "chapter_no", "title").distinct()
    return d.where(F.col("chapter_no").between(3, 7) & ~F.coalesce(F.col("title") == "Chapter 5", F.lit(False))).drop("title")


@query("""select event_id, event_type, ts from events where event_type in ('error', 'signup') and value is not null""")
def events_of_kinds(spark, sf):
    return read_table(spark, sf, "events").where(F.col("event_type").isin("error", "signup") & F.col("value").isNotNull()).select("event_id", "event_type", "ts")


@query("""with k as (select distinct book_id, name from characters where name is not null)
select i.input_id, i.name from (select distinct input_id, book_id, name from character_inputs) i semi join k on k.book_id = i.book_id and k.name = i.name""")
def inputs_of_known_names(spark, sf):
    i = read_table(spark, sf, "character_inputs").select("input_id", "book_id", "name").distinct()
    return i.join(read_table(spark, sf, "characters").select("book_id", "name"), ["book_id", "name"], "left_semi").select("input_id", "name")


@query("""with k as (select distinct book_id, name from characters where name is not null)
select i.input_id, i.name from (select distinct input_id, book_id, name from character_inputs) i anti join k on k.book_id = i.book_id and k.name = i.name""")
def inputs_of_new_names(spark, sf):
    """The other side of the semi join, kept as the skipped list."""
    i = read_table(spark, sf, "character_inputs").select("input_id", "book_id", "name").distinct()
    return i.join(read_table(spark, sf, "characters").select("book_id", "name"), ["book_id", "name"], "left_anti").select("input_id", "name")


@query("""select e.event_id, e.event_type, a.c_name as actor, t.c_name as target from events e
left join customer a on a.c_custkey = e.user_id left join customer t on t.c_custkey = e.event_id order by e.ts desc, e.event_id limit 50""")
def audit_log(spark, sf):
    """The newest 50 entries, each with two lookups on one dimension; the limit comes before the joins."""
    e = read_table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(50)
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    d = e.join(c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("actor")), "user_id", "left")
    d = d.join(c.select(F.col("c_custkey").alias("event_id"), F.col("c_name").alias("target")), "event_id", "left")
    return d.select("event_id", "event_type", "actor", "target")


@query("""select book_id, count(*) as total, count(*) filter (text is not null and trim(text) <> '') as ready, count(*) filter (text is null) as failed,
count(*) filter (text is not null and trim(text) = '') as pending, sum(coalesce(length(text), 0)) as chars,
round(100.0 * count(*) filter (text is not null and trim(text) <> '') / count(*)) as pct from (select distinct * from synth_requests) group by 1""")
def audiobook_summary(spark, sf):
    """Conditional counts, sums with null as 0, and a rounded percentage."""
    d = read_table(spark, sf, "synth_requests").distinct()
    ready, blank = F.col("text").isNotNull() & (F.trim("text") != ""), F.col("text").isNotNull() & (F.trim("text") == "")
    return d.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ready).alias("ready"), F.count_if(F.col("text").isNull()).alias("failed"), F.count_if(blank).alias("pending"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.round(100.0 * F.count_if(ready) / F.count(F.lit(1))).alias("pct"),
    )


@query("""select coalesce(voice, 'narrator') as voice, count(*) as segments, count(distinct book_id) as books from (select distinct * from synth_requests) group by 1""")
def segments_per_voice(spark, sf):
    d = read_table(spark, sf, "synth_requests").distinct()
    return d.groupBy(F.coalesce("voice", F.lit("narrator")).alias("voice")).agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("book_id").alias("books"))


@query("""select event_type, count(*) as events, round(sum(value), 4) as total, arg_max(event_id, (ts, event_id)) as last_event from events group by 1""")
def job_counters(spark, sf):
    """Counters with the last value by time."""
    d = read_table(spark, sf, "events").groupBy("event_type")
    return d.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("""with l as (select * from events order by ts desc, event_id limit 500)
select count(*) as jobs, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'purchase') as purchases, max(ts) as last_seen from l""")
def worker_status(spark, sf):
    """Counts over the newest 500 jobs only."""
    d = read_table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(500)
    counts = {"errors": F.count_if(F.col("event_type") == "error"), "purchases": F.count_if(F.col("event_type") == "purchase")}
    return d.agg(F.count(F.lit(1)).alias("jobs"), *[c.alias(k) for k, c in counts.items()], F.max("ts").alias("last_seen"))


@query("""with b as (select distinct * from books), m as (select date_trunc('day', max(last_read)) as day from b)
select count(*) as books, count(*) filter (last_read >= (select day from m)) as opened_today, count(*) filter (author is null) as no_author from b""")
def dashboard(spark, sf):
    """Counts since the midnight of the newest reading; the day is a parameter that is read from the data."""
    b = read_table(spark, sf, "books").distinct()
    day = b.agg(F.date_trunc("day", F.max("last_read"))).scalar()
    return b.agg(F.count(F.lit(1)).alias("books"), F.count_if(F.col("last_read") >= day).alias("opened_today"), F.count_if(F.col("author").isNull()).alias("no_author"))


@query("""with e as (select * from events where event_type = 'nosuch'), r as (select event_id, ts from e order by ts desc, event_id limit 5),
f as (select event_id, ts from events where event_type = 'error' order by ts desc, event_id limit 5)
select event_id, ts from r union all select event_id, ts from f where not exists (select 1 from r)""")
def recent_or_fallback(spark, sf):
    """The newest of one kind, or of another where there are none."""
    d = read_table(spark, sf, "events")
    newest = lambda kind: d.where(F.col("event_type") == kind).select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(5)
    first, second = newest("nosuch"), newest("error")
    return first.unionByName(second.where(first.agg(F.count(F.lit(1))).scalar() == 0))


@query("""with m as (select max(ts) as now from events) select event_id, event_type, ts from events where not (event_type = 'purchase' and ts < (select now from m) - interval 30 minute)""")
def job_retention(spark, sf):
    """Drops finished jobs older than 30 minutes before the newest entry."""
    d = read_table(spark, sf, "events")
    now = d.agg(F.max("ts")).scalar()
    old = (F.col("event_type") == "purchase") & (F.col("ts") < now - F.expr("interval 30 minutes"))
    return d.where(~old).select("event_id", "event_type", "ts")


@query("""with m as (select max(ts) as now from events), l as (select user_id, max(ts) as last_ts, arg_max(event_type, (ts, event_id)) as last_type from events group by 1)
select user_id, last_ts, case when last_ts < (select now from m) - interval 15 minute then 'failed' else last_type end as status from l""")
def stale_sweep(spark, sf):
    """A job without news for 15 minutes has failed."""
    d = read_table(spark, sf, "events")
    last = d.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    now = d.agg(F.max("ts")).scalar()
    stale = F.col("last_ts") < now - F.expr("interval 15 minutes")
    return last.select("user_id", "last_ts", F.when(stale, "failed").otherwise(F.col("last_type")).alias("status"))


@query("""select user_id, event_type, min(ts) as first_ts, count(*) as copies from events group by 1, 2""")
def job_dedupe(spark, sf):
    """One job per stable id, its first time and how often it was sent."""
    return read_table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("copies"))


@query("""with r as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) select * from r where rank <= 30""")
def ring_buffer_30(spark, sf):
    d = read_table(spark, sf, "events").select("user_id", "event_id", "ts")
    return R.top_per_group(d, ["user_id"], [F.desc("ts"), F.desc("event_id")], 30)


@query("""with c as (select distinct chapter_id, book_id, chapter_no, length(html) * 15 as ms from chapters where length(html) > 0)
select book_id, chapter_id, e - ms as start_ms, e as end_ms from (select *, sum(ms) over (partition by book_id order by chapter_no, chapter_id) as e from c)""")
def cumulative_offsets(spark, sf):
    """Places of chapters in a book read aloud; the duration is estimated from the length."""
    c = read_table(spark, sf, "chapters").select("chapter_id", "book_id", "chapter_no", (F.length("html") * 15).cast("long").alias("ms")).distinct()
    return R.running_offsets(c, ["book_id"], ["chapter_no", "chapter_id"], "ms").select("book_id", "chapter_id", "start_ms", "end_ms")


@query("""with c as (select distinct chapter_id, book_id, chapter_no, html from chapters)
select chapter_id, row_number() over (partition by book_id order by chapter_no, chapter_id) as idx from c where length(regexp_replace(coalesce(html, ''), '\\s', '', 'g')) >= 80""")
def eligible_chapter_index(spark, sf):
    """A running index over chapters with enough text only."""
    c = read_table(spark, sf, "chapters").select("chapter_id", "book_id", "chapter_no", "html").distinct()
    c = c.where(F.length(F.regexp_replace(F.coalesce("html", F.lit("")), "[\\t\\n\\x0B\\f\\r ]", "")) >= 80)
    return c.select("chapter_id", F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_no", "chapter_id")).alias("idx"))


@query("""with p as (select distinct para_id, chapter_id, para_index, lang, text from paragraphs where chapter_id is not null)
select para_id, lag(lang) over w as prev_lang, left(lead(text) over w, 80) as next_text from p window w as (partition by chapter_id order by para_index, para_id)""")
def turn_context(spark, sf):
    w = Window.partitionBy("chapter_id").orderBy("para_index", "para_id")
    p = read_table(spark, sf, "paragraphs").select("para_id", "chapter_id", "para_index", "lang", "text").distinct().where("chapter_id is not null")
    return p.select("para_id", F.lag("lang").over(w).alias("prev_lang"), F.left(F.lead("text").over(w), F.lit(80)).alias("next_text"))


@query("""with p as (select distinct para_id, chapter_id, para_index, lang from paragraphs where chapter_id is not null),
f as (select *, case when row_number() over w = 1 or lang is distinct from lag(lang) over w then 1 else 0 end as c from p window w as (partition by chapter_id order by para_index, para_id)),
g as (select *, sum(c) over (partition by chapter_id order by para_index, para_id rows unbounded preceding) as run from f)
select chapter_id, run, any_value(lang) as lang, count(*) as rows from g group by chapter_id, run""")
def language_runs(spark, sf):
    """Gaps and islands: consecutive paragraphs of one language."""
    p = read_table(spark, sf, "paragraphs").select("para_id", "chapter_id", "para_index", "lang").distinct().where("chapter_id is not null")
    return R.islands(p, ["chapter_id"], ["para_index", "para_id"], "lang")


@query("""with c as (select distinct chapter_id, book_id, chapter_no, left(html, 100) as sample from chapters),
n as (select *, row_number() over (partition by book_id order by chapter_no, chapter_id) - 1 as i, count(*) over (partition by book_id) as n from c)
select book_id, chapter_id, sample from n where n <= 5 or i in (floor(0 * (n-1) / 4.0), floor(1 * (n-1) / 4.0), floor(2 * (n-1) / 4.0), floor(3 * (n-1) / 4.0), floor(4 * (n-1) / 4.0))""")
def even_sample(spark, sf):
    c = read_table(spark, sf, "chapters").select("chapter_id", "book_id", "chapter_no", F.left("html", F.lit(100)).alias("sample")).distinct()
    return R.evenly_spaced(c, ["book_id"], ["chapter_no", "chapter_id"], 5).select("book_id", "chapter_id", "sample")


@query("""select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as int), -1) as k from events""")
def json_hydrate(spark, sf):
    """A field of a JSON text column, with a default where it is missing or broken."""
    return read_table(spark, sf, "events").select("event_id", F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as int)"), F.lit(-1)).alias("k"))


@query("""with u as (select input_id, book_id, voice_id, notes from (select distinct input_id, book_id, voice_id, notes from character_inputs)),
b as (select distinct book_id, language, series from books)
select u.input_id, coalesce(u.voice_id, b.series, b.language, 'default') as setting from u left join b using (book_id)""")
def layered_settings(spark, sf):
    u = read_table(spark, sf, "character_inputs").select("input_id", "book_id", "voice_id", "notes").distinct()
    b = read_table(spark, sf, "books").select("book_id", "language", "series").distinct()
    return u.join(b, "book_id", "left").withColumn("fallback", F.lit("default")).select("input_id", R.first_not_null("voice_id", "series", "language", "fallback").alias("setting"))


@query("""with old as (select text as phrase, count(*) as hits, max(imported_at) as seen from paragraphs where length(text) between 4 and 200 and para_index % 2 = 0 group by 1),
new as (select text as phrase, count(*) as hits, max(imported_at) as seen from paragraphs where length(text) between 4 and 200 and para_index % 2 = 1 group by 1)
select phrase, sum(hits) as hits, max(seen) as seen from (select * from old union all select * from new) group by 1""")
def upsert_counter(spark, sf):
    """Insert or increment: two batches of counted phrases become one table."""
    p = read_table(spark, sf, "paragraphs").where(F.length("text").between(4, 200))
    batch = lambda odd: p.where(F.col("para_index") % 2 == odd).groupBy(F.col("text").alias("phrase")).agg(F.count(F.lit(1)).alias("hits"), F.max("imported_at").alias("seen"))
    return R.merge_counters(batch(0), batch(1), "phrase", "hits", "seen")


@query("""with old as (select character_id, count(*) as hits from bible_snapshots where version = 1 and character_id is not null group by 1),
h as (select character_id, count(*) as n from bible_snapshots where version > 1 and character_id is not null group by 1)
select old.character_id, old.hits + coalesce(h.n, 0) as hits from old left join h using (character_id)""")
def touch_existing(spark, sf):
    s = read_table(spark, sf, "bible_snapshots").where("character_id is not null")
    old = s.where("version = 1").groupBy("character_id").agg(F.count(F.lit(1)).alias("hits"))
    return R.touch_counters(old, s.where("version > 1").select("character_id", F.lit(1).alias("hits")), "character_id", "hits")


@query("""with old as (select distinct book_id, name from characters where name is not null), new as (select distinct book_id, name from character_inputs where name is not null)
select * from old union all select * from new anti join old using (book_id, name)""")
def insert_new_names(spark, sf):
    old = read_table(spark, sf, "characters").where("name is not null").select("book_id", "name").distinct()
    return R.insert_or_ignore(old, read_table(spark, sf, "character_inputs").where("name is not null").select("book_id", "name"), ["book_id", "name"])


@query("""select distinct name from (select name from characters union select name from character_inputs) where name is not null except select title from books""")
def name_set_operations(spark, sf):
    """Union distinct, then difference."""
    names = read_table(spark, sf, "characters").select("name").union(read_table(spark, sf, "character_inputs").select("name")).distinct().where("name is not null")
    return names.join(read_table(spark, sf, "books").select(F.col("title").alias("name")), "name", "left_anti")


@query("""with gone as (select book_id from books where language is null) select distinct chapter_id, book_id from chapters anti join gone using (book_id)""")
def cascade_delete(spark, sf):
    """Children of removed parents go too."""
    gone = read_table(spark, sf, "books").where("language is null").select("book_id")
    return read_table(spark, sf, "chapters").select("chapter_id", "book_id").distinct().join(gone, "book_id", "left_anti")


@query("""with d as (select character_id, arg_max(struct_pack(v := version, s := source, d := description), (loaded_at, snapshot_id)) as r
from bible_snapshots where character_id is not null group by 1) select character_id, r.v as version, r.s as source, r.d as description from d""")
def newest_profile(spark, sf):
    s = read_table(spark, sf, "bible_snapshots").where("character_id is not null").select("character_id", "loaded_at", "snapshot_id", "version", "source", "description")
    return R.latest_per_key(s, ["character_id"], ["loaded_at", "snapshot_id"]).drop("loaded_at", "snapshot_id")


@query("""with e as (select distinct survivor_id a, absorbed_id b from merge_requests where survivor_id is not null and absorbed_id is not null),
n as (select id, count(*) as degree from (select a as id from e union all select b from e) group by 1), r as (select character_id as id, min(role) as role from characters group by 1)
select n.id, degree, case when degree >= 3 and coalesce(role, 'supporting') = 'supporting' then 'main' else coalesce(role, 'supporting') end as role from n left join r using (id)""")
def role_promotion(spark, sf):
    """Edges at either end count; three make a supporting figure a main one, and none is ever demoted."""
    e = read_table(spark, sf, "merge_requests").select("survivor_id", "absorbed_id").distinct()
    roles = read_table(spark, sf, "characters").groupBy(F.col("character_id").alias("id")).agg(F.min("role").alias("role"))
    return E.promoted(e, "survivor_id", "absorbed_id", roles)


@query("""with e as (select least(survivor_id, absorbed_id) as low, greatest(survivor_id, absorbed_id) as high, coalesce(book_id, '') as label from merge_requests where survivor_id is not null and absorbed_id is not null),
c as (select low, high, label, count(*) as n from e group by all), r as (select low, high, sum(n)::bigint as edges, list(label order by n desc, label) as l, max(n) as dominant_edges from c group by 1, 2)
select low, high, l[1] as dominant, edges, dominant_edges, array_to_string(l[2:], '|') as others from r""")
def edge_merge(spark, sf):
    """Parallel edges become one per unordered pair, with the dominant label and the others."""
    e = read_table(spark, sf, "merge_requests").withColumn("label", F.coalesce("book_id", F.lit("")))
    return E.merged_edges(e, "survivor_id", "absorbed_id", "label").withColumn("others", F.array_join("others", "|"))
