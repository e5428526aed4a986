"""Queries over entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import names as N
from quire.operators import entities as E
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


_CANON = N.canonical_sql
_SP = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_KEY = lambda x: f"lower(trim(regexp_replace({x}, '{_SP}+', ' ', 'g')))"
_MOVES = "(select absorbed_id, min(survivor_id) as t from merge_requests where absorbed_id is not null and survivor_id is not null and absorbed_id <> survivor_id group by 1)"


def _moves(spark, sf):
    return read_table(spark, sf, "merge_requests").select("absorbed_id", "survivor_id")


@query(f"""with r as (select distinct book_id, character_id, name from characters), k as (select book_id, {_KEY('name')} as k, min(character_id) as n from r where name is not null group by 1, 2),
a as (select {_KEY('alias')} as k, min(character_id) as a from (select character_id, unnest(aliases) as alias from characters) where alias is not null group by 1),
g as (select k, min(n) as n from k group by 1), i as (select distinct input_id, name from character_inputs)
select i.input_id, coalesce(g.n, a.a) as character_id from i left join g on g.k = {_KEY('i.name')} left join a on a.k = {_KEY('i.name')}""")
def resolved_inputs(spark, sf):
    """Typed names by exact key, else by an alias, else without honorific; names with odd spaces are left to problem 4."""
    c = read_table(spark, sf, "characters")
    roster = c.select("character_id", "name").where("name is not null").distinct()
    aliases = c.select("character_id", F.explode("aliases").alias("alias")).where("alias is not null").distinct()
    i = read_table(spark, sf, "character_inputs").select("input_id", "name").distinct()
    return E.resolve(i, roster, aliases).select("input_id", "character_id")


@query(f"""with a as (select distinct character_id, alias, length(alias) % 7 / 10.0 as confidence from (select character_id, unnest(aliases) as alias from characters) where alias is not null and alias <> ''),
d as (select coalesce(m.t, a.character_id) as character_id, alias, confidence, case when m.t is null then 1 else 0 end as own from a left join {_MOVES} m on m.absorbed_id = a.character_id)
select character_id, count(*) as aliases, round(sum(confidence), 4) as confidence from (select character_id, {_KEY('alias')} as k, max(confidence) as confidence from d group by 1, 2) group by 1""")
def merged_aliases(spark, sf):
    """Aliases after the requested merges, per survivor."""
    a = read_table(spark, sf, "characters").select("character_id", F.explode("aliases").alias("alias")).where("alias is not null and alias <> ''").distinct()
    a = a.withColumns({"confidence": F.length("alias") % 7 / 10.0, "source": F.lit("llm")})
    return E.merge_aliases(a, _moves(spark, sf)).groupBy("character_id").agg(F.count(F.lit(1)).alias("aliases"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query(f"""with a as (select character_id, version as chapter, count(*) as mentions from bible_snapshots where character_id is not null and version is not null group by 1, 2)
select coalesce(m.t, a.character_id) as character_id, chapter, sum(mentions) as mentions from a left join {_MOVES} m on m.absorbed_id = a.character_id group by 1, 2""")
def merged_appearances(spark, sf):
    a = read_table(spark, sf, "bible_snapshots").where("character_id is not null and version is not null").groupBy("character_id", F.col("version").alias("chapter")).agg(F.count(F.lit(1)).alias("mentions"))
    return E.merge_appearances(a, _moves(spark, sf))


@query(f"""with e as (select distinct survivor_id as f, absorbed_id as t, coalesce(book_id, '') as r from merge_requests where survivor_id is not null and absorbed_id is not null),
d as (select coalesce(x.t, e.f) as from_id, coalesce(y.t, e.t) as to_id, r from e left join {_MOVES} x on x.absorbed_id = e.f left join {_MOVES} y on y.absorbed_id = e.t)
select distinct from_id, to_id, r as relationship from d where from_id <> to_id""")
def merge_remap(spark, sf):
    """Edges with both ends moved to the survivors."""
    e = read_table(spark, sf, "merge_requests").where("survivor_id is not null and absorbed_id is not null")
    e = e.select(F.col("survivor_id").alias("from_id"), F.col("absorbed_id").alias("to_id"), F.coalesce("book_id", F.lit("")).alias("relationship")).distinct()
    return E.rewire_edges(e, _moves(spark, sf))


@query("""with o as (select character_id, arg_max(struct_pack(d := description, s := source), (loaded_at, snapshot_id)) as r from bible_snapshots where character_id is not null and source = 'user' group by 1),
p as (select character_id, arg_max(struct_pack(d := description), (loaded_at, snapshot_id)).d as n from bible_snapshots where character_id is not null and source <> 'user' group by 1)
select p.character_id, case when p.n is null then 'skipped' when o.r.s = 'user' and o.r.d is not null and p.n = o.r.d then 'skipped' when o.r.s = 'user' and o.r.d is not null then 'conflict' else 'applied' end as outcome from p left join o using (character_id)""")
def profile_patch_routing(spark, sf):
    """What a generated description does to one that a user wrote."""
    s = read_table(spark, sf, "bible_snapshots").where("character_id is not null").select("character_id", "loaded_at", "snapshot_id", "source", "description")
    newest = lambda d: d.groupBy("character_id").agg(F.max_by("description", F.struct("loaded_at", "snapshot_id")).alias("description"))
    old = newest(s.where("source = 'user'")).withColumn("sources", F.create_map(F.lit("description"), F.lit("user")))
    patch = newest(s.where("source <> 'user'")).select("character_id", F.create_map(F.lit("description"), F.col("description")).alias("fields"))
    return E.merge_profile(old, patch, "character_id", ["description"]).select("character_id", "outcome")


@query(f"""with k as (select distinct {_KEY('name')} as k from characters where name is not null), i as (select distinct input_id, name, notes from character_inputs)
select i.input_id, case when coalesce(trim(i.notes), '') = '' then 'no evidence' when coalesce(trim(i.name), '') = '' then 'no target' when k.k is not null then 'known name' end as reason,
case when coalesce(trim(i.notes), '') = '' or coalesce(trim(i.name), '') = '' or k.k is not null then 'queue' else 'apply' end as route from i left join k on k.k = nullif({_KEY('i.name')}, '')""")
def patch_routes(spark, sf):
    i = read_table(spark, sf, "character_inputs").select("input_id", "name", "notes").distinct()
    p = i.select("input_id", F.lit("new").alias("kind"), F.col("notes").alias("evidence_quote"), F.col("name").alias("target_name"))
    return E.route_patches(p, read_table(spark, sf, "characters").select("name")).select("input_id", "reason", "route")


@query("""with o as (select character_id, max(gender) as gender, max(role) as role from characters group by 1), n as (select character_id, max(case when source <> 'unknown' then source end) as role from bible_snapshots where character_id is not null group by 1)
select coalesce(o.character_id, n.character_id) as character_id, coalesce(n.role, o.role) as role from o full join n using (character_id)""")
def upsert_roles(spark, sf):
    """New values replace old ones unless they are null or unknown."""
    old = read_table(spark, sf, "characters").groupBy("character_id").agg(F.max("role").alias("role"))
    new = read_table(spark, sf, "bible_snapshots").select("character_id", F.col("source").alias("role"))
    return E.upsert_characters(old, new, "character_id", ["role"])


@query("""with q as (select snapshot_id, book_id, character_id, source, description as v, taken_at from (select distinct * from bible_snapshots) where character_id is not null and source is not null),
r as (select *, case when v is not null then sum((v is not null)::int) over (partition by book_id, character_id, source order by taken_at desc, snapshot_id desc rows unbounded preceding) end as r from q)
select snapshot_id, case when v is null then 'skipped' when r = 1 then 'applied' else 'superseded' end as outcome from r""")
def accept_all(spark, sf):
    q = read_table(spark, sf, "bible_snapshots").distinct().where("character_id is not null and source is not null").withColumnRenamed("description", "value")
    return E.accept_all(q, "book_id", "character_id", "source", ["taken_at", "snapshot_id"]).select("snapshot_id", "outcome")


@query("""with q as (select distinct snapshot_id, version, case when source = 'llm' then 'pending' else 'done' end as status from bible_snapshots)
select snapshot_id, case when status = 'pending' and version >= 2 then 'stale' else status end as status from q""")
def stale_queue(spark, sf):
    q = read_table(spark, sf, "bible_snapshots").select("snapshot_id", F.col("version").alias("chapter"), F.when(F.col("source") == "llm", "pending").otherwise("done").alias("status")).distinct()
    return E.stale_after(q, 2).select("snapshot_id", "status")


@query("""with l as (select distinct para_id, chapter_id, lang from paragraphs where chapter_id is not null), d as (select chapter_id, min(language) as was from (select distinct c.chapter_id, b.language from chapters c join books b using (book_id)) group by 1)
select coalesce(d.was, 'none') as was, coalesce(lower(l.lang), 'none') as said, count(*) as n, case when lower(l.lang) = d.was then 'fixed' when l.lang is null then 'partial' else 'wrong' end as verdict from l join d using (chapter_id) group by 1, 2, 4""")
def verdict_scoring(spark, sf):
    """Three verdicts against labels: the language of a paragraph against its book's."""
    c = read_table(spark, sf, "chapters").select("chapter_id", "book_id").distinct().join(read_table(spark, sf, "books").select("book_id", "language").distinct(), "book_id")
    d = c.groupBy("chapter_id").agg(F.min("language").alias("was"))
    p = read_table(spark, sf, "paragraphs").select("para_id", "chapter_id", "lang").distinct().where("chapter_id is not null").join(d, "chapter_id")
    verdict = F.when(F.lower("lang") == F.col("was"), "fixed").when(F.col("lang").isNull(), "partial").otherwise("wrong")
    p = p.select(F.coalesce("was", F.lit("none")).alias("was"), F.coalesce(F.lower("lang"), F.lit("none")).alias("said"), verdict.alias("verdict"))
    return p.groupBy("was", "said", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""with o as (select o_orderkey, o_custkey, o_orderdate, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders)
select c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice from customer c left join o on o.o_custkey = c.c_custkey and o.r = 1""")
def customers_with_last_order(spark, sf):
    """One joined row per dimension row, the latest fact or none."""
    o = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("m"))
    o = o.select(F.col("o_custkey").alias("c_custkey"), F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.o_totalprice").alias("o_totalprice"))
    return read_table(spark, sf, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left")


@query("""with p as (select distinct para_id, chapter_id, start_pos, end_pos from paragraphs where chapter_id is not null), a as (select chapter_id, off from (select distinct chapter_id from chapters), (select unnest([0, 100, 500, 1000]) as off))
select a.chapter_id, a.off as place, min(p.para_id) as para_id from a join p on p.chapter_id = a.chapter_id and p.start_pos <= a.off and a.off < p.end_pos group by 1, 2""")
def offset_paragraph(spark, sf):
    """Interval lookup within a chapter: which paragraph holds a place; the places of a chapter are an array, so the join is on its id."""
    p = read_table(spark, sf, "paragraphs").select("para_id", "chapter_id", "start_pos", "end_pos").distinct().where("chapter_id is not null")
    c = read_table(spark, sf, "chapters").select("chapter_id").distinct()
    places = F.filter(F.array(*[F.lit(x) for x in (0, 100, 500, 1000)]), lambda x: (F.col("start_pos") <= x) & (x < F.col("end_pos")))
    d = p.join(c, "chapter_id", "left_semi").withColumn("place", F.explode(places))
    return d.groupBy("chapter_id", "place").agg(F.min("para_id").alias("para_id"))


@query("""with o as (select lower(trim(text)) as k, arg_max(voice, (requested_at, request_id)) as voice, true as hit from synth_requests where text is not null group by 1), p as (select distinct para_id, text from paragraphs)
select p.para_id, coalesce(o.hit, false) as planned, case when o.hit then coalesce(o.voice, 'narrator') end as voice from p left join o on o.k = lower(trim(p.text))""")
def plan_override(spark, sf):
    """A dictionary join on normalised text: the last entry wins, and a null voice differs from no entry."""
    o = read_table(spark, sf, "synth_requests").where("text is not null").groupBy(F.lower(N.trimmed(F.col("text"))).alias("k"))
    o = o.agg(F.max(F.struct("requested_at", "request_id", "voice")).alias("m")).select("k", F.col("m.voice").alias("v"), F.lit(True).alias("hit"))
    p = read_table(spark, sf, "paragraphs").select("para_id", "text").distinct().withColumn("k", F.lower(N.trimmed(F.col("text"))))
    return p.join(o, "k", "left").select("para_id", F.coalesce("hit", F.lit(False)).alias("planned"), F.when(F.col("hit"), F.coalesce("v", F.lit("narrator"))).alias("voice"))


@query("""with p as (select distinct para_id, chapter_id, para_index, lang from paragraphs where chapter_id is not null)
select para_id, coalesce(lang, last_value(lang ignore nulls) over (w rows between 3 preceding and 1 preceding), first_value(lang ignore nulls) over (w rows between 1 following and 3 following)) as lang from p window w as (partition by chapter_id order by para_index, para_id)""")
def nearest_known(spark, sf):
    """The nearest known value within three rows, backwards first."""
    w = Window.partitionBy("chapter_id").orderBy("para_index", "para_id")
    p = read_table(spark, sf, "paragraphs").select("para_id", "chapter_id", "para_index", "lang").distinct().where("chapter_id is not null")
    return p.select("para_id", F.coalesce("lang", F.last("lang", True).over(w.rowsBetween(-3, -1)), F.first("lang", True).over(w.rowsBetween(1, 3))).alias("lang"))


@query(f"""with r as (select distinct character_id, book_id, {_CANON("name")} as c from characters), k as (select *, nullif(regexp_replace(c, '[\\s-]+', '', 'g'), '') as k0 from r),
q as (select *, case when length(k0) >= 2 then k0 end as k from k), m as (select book_id, k, min(character_id) as cluster from q where k is not null group by 1, 2)
select q.book_id, q.character_id, coalesce(m.cluster, q.character_id) as cluster from q left join m on m.book_id = q.book_id and m.k = q.k""")
def name_clusters_all(spark, sf):
    return E.clusters(read_table(spark, sf, "characters").select("character_id", "book_id", "name").distinct(), "book_id", "character_id", "name")


@query(f"""with r as (select distinct character_id, book_id, {_CANON("name")} as c from characters), e as (select distinct book_id, character_id, unnest(list_filter(string_split(c, ' '), lambda x: x <> '')) as w from r),
n as (select book_id, character_id, count(*) as n from e group by all), s as (select a.book_id, a.character_id as small, b.character_id as large, count(*) as s from e a join e b on a.book_id = b.book_id and a.w = b.w group by all)
select s.book_id, s.small, s.large from s join n x on x.book_id = s.book_id and x.character_id = s.small join n y on y.book_id = s.book_id and y.character_id = s.large where x.n >= 2 and x.n < y.n and s.s = x.n""")
def word_subset_names_all(spark, sf):
    d = read_table(spark, sf, "characters").groupBy("character_id", "book_id").agg(F.min("name").alias("name"))
    return E.word_subsets(d, "book_id", "character_id", "name")


@query(f"""with r as (select distinct book_id, character_id, name, aliases, role from characters), c as (select *, {_CANON('name')} as c from r),
k as (select *, case when length(regexp_replace(c, '[\\s-]+', '', 'g')) >= 2 then regexp_replace(c, '[\\s-]+', '', 'g') end as k from c),
g as (select *, case when k is null then character_id end as record from k)
select book_id, k, record, arg_max(name, ((case when lower({N.fold_sql('name')}) <> lower(name) then 1 else 0 end), coalesce(len(aliases), 0), length(name), name)) as name, max(len(aliases)) as lines, count(*) as members from g group by 1, 2, 3""")
def cluster_representatives_all(spark, sf):
    """``cluster_representatives`` of all names; one without key is a cluster of its own (k null, found by its record)."""
    d = read_table(spark, sf, "characters").select("book_id", "character_id", "name", "aliases", "role").distinct()
    d = d.withColumns({"k": N.loose(F.col("name")), "lines": F.when(F.col("aliases").isNotNull(), F.size("aliases"))})
    d = d.withColumn("record", F.when(F.col("k").isNull(), F.col("character_id"))).withColumn("cluster", F.coalesce(F.concat(F.lit("k"), "k"), F.concat(F.lit("r"), "record")))
    best = E.representatives(d, ["book_id", "cluster"], "name", "aliases", "lines").drop("aliases")
    members = d.groupBy("book_id", "cluster").agg(F.first("k").alias("k"), F.first("record").alias("record"), F.count(F.lit(1)).alias("members"))
    return best.join(members, ["book_id", "cluster"]).select("book_id", "k", "record", "name", "lines", "members")
