"""Queries of job tables: the batch side of queues, caches and ledgers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import relational as R
from quire.session import read_table
from quire.sources import sinks
from quire.streaming import jobs as J

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""with s as (select book_id, max(chapter_no) // 2 as at, case when max(chapter_no) % 2 = 0 then 'v2' else 'v1' end as v, case when max(chapter_no) % 3 = 0 then '{' when max(chapter_no) % 3 = 1 then '{}' else '{"scene": 1}' end as p
from chapters where chapter_no is not null group by 1), c as (select distinct book_id, chapter_no as chapter_index from chapters where chapter_no is not null)
select c.book_id, c.chapter_index, case when s.at is null then 'no-row' when s.v <> 'v2' then 'version-mismatch' when s.at >= c.chapter_index then 'stale-chapter' when s.p = '{}' then 'empty-payload' when s.p = '{' then 'corrupt-payload' else 'applied' end as reason
from c left join s using (book_id)""")
def carry_over_reasons(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "chapters").where("chapter_no is not null")
    m = c.groupBy("book_id").agg(F.max("chapter_no").alias("m"))
    states = m.select(
        "book_id", F.expr("m div 2").alias("chapter_index"), F.when(F.col("m") % 2 == 0, "v2").otherwise("v1").alias("parser_version"),
        F.when(F.col("m") % 3 == 0, "{").when(F.col("m") % 3 == 1, "{}").otherwise('{"scene": 1}').alias("payload"),
    )
    return J.carry_over(states, c.select("book_id", F.col("chapter_no").alias("chapter_index")).distinct(), "v2").drop("state")


@query("""with w as (select distinct chapter_id, imported_at from chapters), p as (select chapter_id, max(imported_at) as imported_at from paragraphs where chapter_id is not null group by 1)
select w.chapter_id, w.imported_at from w anti join p on p.chapter_id = w.chapter_id and p.imported_at = w.imported_at""")
def cache_misses(spark, sf):
    """Chapters whose cached result is of another time."""
    cache = read_table(spark, sf, "paragraphs").where("chapter_id is not null").groupBy("chapter_id").agg(F.max("imported_at").alias("imported_at"))
    return J.to_compute(read_table(spark, sf, "chapters").select("chapter_id", "imported_at").distinct(), cache, ["chapter_id", "imported_at"])


@query("""with l as (select distinct chapter_id from synth_requests where chapter_id is not null and text is not null)
select distinct c.chapter_id, c.book_id from chapters c anti join l using (chapter_id)""")
def ledger_open(spark, sf):
    ledger = read_table(spark, sf, "synth_requests").where("chapter_id is not null").select("chapter_id", F.when(F.col("text").isNotNull(), "done").otherwise("failed").alias("status"))
    return J.unprocessed(read_table(spark, sf, "chapters").select("chapter_id", "book_id").distinct(), ledger, ["chapter_id"])


@query("""select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as entries from events group by 1, 2""")
def windowed_entries(spark, sf):
    """Tumbling windows of event time, in a batch; the stream operator is the same expression."""
    d = J.windowed_counts(read_table(spark, sf, "events"), "event_type", "ts", "1 hour")
    return d.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "entries")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as s from events window w as (partition by user_id order by ts)),
r as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as run from g) select user_id, min(ts) as started, count(*) as entries from r group by user_id, run""")
def heartbeat_sessions(spark, sf):
    """Runs of a user's entries less than 30 minutes apart."""
    d = J.session_gaps(read_table(spark, sf, "events"), "user_id", "ts", "30 minutes")
    return d.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "entries")


@query("""with b as (select distinct book_id, title, author, added_at from books), t as (select *, row_number() over (order by added_at desc, book_id) as rank from b)
select rank, '<entry><id>' || book_id || '</id><title>' || replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</title><author><name>' ||
replace(replace(replace(replace(coalesce(author, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</name></author><updated>' || strftime(added_at, '%Y-%m-%dT%H:%M:%SZ') || '</updated></entry>' as entry from t where rank <= 100""")
def feed(spark, sf):
    return sinks.feed(read_table(spark, sf, "books").select("book_id", "title", "author", "added_at").distinct(), "book_id", "title", "author", "added_at")


@query("""with c as (select distinct chapter_id, book_id, chapter_no, title, length(html) * 15 as ms from chapters where length(html) > 0), o as (select *, sum(ms) over (partition by book_id order by chapter_no, chapter_id) as e from c)
select book_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (e - ms) || chr(10) || 'END=' || e || chr(10) || 'title=' || coalesce(title, ''), chr(10) order by e) as marks from o group by 1""")
def chapter_marks(spark, sf):
    c = read_table(spark, sf, "chapters").select("chapter_id", "book_id", "chapter_no", "title", (F.length("html") * 15).cast("long").alias("ms")).distinct()
    return sinks.chapter_marks(R.running_offsets(c, ["book_id"], ["chapter_no", "chapter_id"], "ms"), "book_id", "start_ms", "end_ms", "title")


@query("""with p as (select distinct book_id, chapter_id, text from paragraphs where chapter_id is not null), s as (select chapter_id, max(text) as t from synth_requests where chapter_id is not null group by 1),
c as (select distinct chapter_id, html from chapters) select c.chapter_id, left(coalesce(s.t, c.html), 200000) as text from c left join s using (chapter_id)""")
def sidecar_texts_whole(spark, sf):
    """The prepared text of a chapter where there is one, else its own, under the cap of 200,000."""
    from quire.sources.packages import with_sidecar

    c = read_table(spark, sf, "chapters").select(F.col("chapter_id").alias("book_id"), F.lit(0).alias("idx"), F.col("html").alias("text")).distinct()
    s = read_table(spark, sf, "synth_requests").where("chapter_id is not null").select(F.col("chapter_id").alias("book_id"), F.lit(0).alias("idx"), "text")
    return with_sidecar(c, s).select(F.col("book_id").alias("chapter_id"), "text")
