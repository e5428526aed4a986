"""Entities: clusters of names, alias and profile merges with provenance, splits, patches and their review queue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import names as N

# Who wrote a field.
USER, MIXED, LLM = "user", "mixed", "llm"


def resolve(names: DataFrame, roster: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``character_id``: by the key of a name, else of an alias, else of the name without honorific.

    ``roster`` has character_id and name, ``aliases`` character_id and alias. Of several entities with one key the
    least id counts. Three equi joins on keys, so no pair of names is compared twice. Null names resolve to null.
    """
    by_name = roster.groupBy(N.key(F.col("name")).alias("_k")).agg(F.min("character_id").alias("_n"))
    by_alias = aliases.groupBy(N.key(F.col("alias")).alias("_k")).agg(F.min("character_id").alias("_a"))
    base = by_name.select(F.col("_k").alias("_b"), F.col("_n").alias("_h"))
    d = names.withColumns({"_k": N.key(F.col(name)), "_b": N.without_honorific(F.col(name))})
    d = d.join(by_name, "_k", "left").join(by_alias, "_k", "left").join(base, "_b", "left")
    return d.withColumn("character_id", F.coalesce("_n", "_a", "_h")).drop("_k", "_b", "_n", "_a", "_h")


def clusters(records: DataFrame, group: str, record: str, name: str) -> DataFrame:
    """(group, record, cluster): records of one group whose names are equal without accents, case, marks and spaces.

    Equality without spaces includes equality with them, so one key decides and no pairs are compared. A name without
    such a key is a cluster of its own.
    """
    d = records.select(group, record, N.loose(F.col(name)).alias("_k"))
    least = d.where("_k is not null").groupBy(group, "_k").agg(F.min(record).alias("cluster"))
    return d.join(least, [group, "_k"], "left").select(group, record, F.coalesce("cluster", record).alias("cluster"))


def representatives(members: DataFrame, cluster: Sequence[str], name: str, aliases: str, lines: str) -> DataFrame:
    """Per cluster the best name (accents, then lines, then length), up to 8 other names in order, the most lines."""
    accented = N.fold(F.col(name)) != F.col(name)
    rank = F.struct(accented.cast("int"), F.coalesce(F.col(lines), F.lit(0)), F.length(name), F.col(name))
    others = F.array_union(F.array(name), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    d = members.groupBy(*cluster).agg(F.max_by(name, rank).alias("best"), F.array_sort(F.flatten(F.collect_list(others))).alias("_all"), F.max(lines).alias("lines"))
    kept = F.filter(F.array_distinct("_all"), lambda x: x.isNotNull() & (x != "") & (x != F.col("best")))
    return d.select(*cluster, F.col("best").alias("name"), F.slice(kept, 1, 8).alias("aliases"), "lines")


def word_subsets(names: DataFrame, group: str, record: str, name: str) -> DataFrame:
    """Pairs (group, small, large): all words of the one name, two at least, are among those of the longer other."""
    words = F.array_distinct(F.filter(F.split(N.canonical(F.col(name)), " "), lambda w: w != ""))
    d = names.select(group, record, words.alias("w")).withColumn("n", F.size("w"))
    e = d.withColumn("word", F.explode("w")).drop("w")
    a = e.where("n >= 2").select(group, "word", F.col(record).alias("small"), F.col("n").alias("m"))
    b = e.select(group, "word", F.col(record).alias("large"), F.col("n").alias("k"))
    shared = a.join(b, [group, "word"]).where("m < k").groupBy(group, "small", "large", "m").agg(F.count(F.lit(1)).alias("s"))
    return shared.where("s = m").select(group, "small", "large")


def profile_source(sources: Column) -> Column:
    """The source of a profile from those of its fields: user wins, several kinds are mixed."""
    v = F.map_values(sources)
    return F.when(F.exists(v, lambda x: x == USER), USER).when(F.exists(v, lambda x: x == MIXED), MIXED).otherwise(LLM)


def merge_profile(old: DataFrame, patch: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, outcome, value) of a patch on profiles with provenance.

    ``old`` has key, the fields and ``sources`` (map field to source); ``patch`` has key and ``fields`` (map field to
    new value). A field that the patch doesn't name is no row; null as a new value is skipped. What a user wrote stays:
    an equal value is 'skipped', another one a 'conflict'. Anything else is 'applied'. A profile that isn't there yet
    takes everything.
    """
    p = patch.select(key, F.explode("fields").alias("field", "new")).where(F.col("field").isin(list(fields)))
    o = old.select(key, F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]).alias("values"), "sources")
    d = p.join(o, key, "left").withColumns({"was": F.try_element_at("values", F.col("field")), "by": F.try_element_at("sources", F.col("field"))})
    locked = (F.col("by") == USER) & F.col("was").isNotNull()
    outcome = (
        F.when(F.col("new").isNull(), "skipped").when(locked & F.col("new").eqNullSafe(F.col("was")), "skipped")
        .when(locked, "conflict").otherwise("applied")
    )
    return d.select(key, "field", outcome.alias("outcome"), F.when(outcome == "applied", F.col("new")).otherwise(F.col("was")).alias("value"))


def route_patches(patches: DataFrame, known: DataFrame) -> DataFrame:
    """``patches`` with route ('apply' or 'queue') and reason, by the first rule that holds.

    Patches have kind, evidence_quote, target_name; ``known`` has name. No evidence, no target, an unknown target of an
    update, or a new entity under a known name goes to review.
    """
    k = known.select(N.key(F.col("name")).alias("_k")).where("_k <> ''").distinct().withColumn("_known", F.lit(True))
    d = patches.withColumn("_k", N.key(F.col("target_name"))).join(k, "_k", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    reason = (
        F.when(F.coalesce(F.trim("evidence_quote"), F.lit("")) == "", "no evidence").when(F.coalesce(F.col("_k"), F.lit("")) == "", "no target")
        .when((F.col("kind") == "update") & ~F.col("_known"), "unknown target").when((F.col("kind") == "new") & F.col("_known"), "known name")
    )
    return d.withColumn("reason", reason).withColumn("route", F.when(reason.isNull(), "apply").otherwise("queue")).drop("_k", "_known")


def remap(ids: Column, survivor: str, absorbed: str) -> Column:
    return F.when(ids == absorbed, survivor).otherwise(ids)


def merge_aliases(aliases: DataFrame, moves: DataFrame) -> DataFrame:
    """Aliases after absorbed entities went over to their survivors.

    ``aliases`` has character_id, alias, confidence, source; ``moves`` absorbed_id and survivor_id. Of equal aliases
    (without case) the most confident stays, the survivor's own on a tie; null moves move nothing.
    """
    m = moves.where("absorbed_id is not null and survivor_id is not null and absorbed_id <> survivor_id").groupBy(F.col("absorbed_id").alias("character_id")).agg(F.min("survivor_id").alias("_to"))
    d = aliases.join(m, "character_id", "left").withColumns({"_own": F.col("_to").isNull().cast("int"), "character_id": F.coalesce("_to", "character_id"), "_k": N.key(F.col("alias"))})
    best = d.groupBy("character_id", "_k").agg(F.max(F.struct("confidence", "_own", "alias", "source")).alias("m"))
    return best.select("character_id", F.col("m.alias").alias("alias"), F.col("m.confidence").alias("confidence"), F.col("m.source").alias("source"))


def merge_appearances(appearances: DataFrame, moves: DataFrame) -> DataFrame:
    """Mentions per character and chapter after the move, added up."""
    m = moves.where("absorbed_id is not null and survivor_id is not null and absorbed_id <> survivor_id").groupBy(F.col("absorbed_id").alias("character_id")).agg(F.min("survivor_id").alias("_to"))
    d = appearances.join(m, "character_id", "left").withColumn("character_id", F.coalesce("_to", "character_id"))
    return d.groupBy("character_id", "chapter").agg(F.sum("mentions").alias("mentions"))


def rewire_edges(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with both ends moved; edges that become loops or repeats go."""
    m = moves.where("absorbed_id is not null and survivor_id is not null and absorbed_id <> survivor_id").groupBy("absorbed_id").agg(F.min("survivor_id").alias("_to"))
    side = lambda c: m.select(F.col("absorbed_id").alias(c), F.col("_to").alias(f"_{c}"))
    d = edges.join(side("from_id"), "from_id", "left").join(side("to_id"), "to_id", "left")
    d = d.withColumns({"from_id": F.coalesce("_from_id", "from_id"), "to_id": F.coalesce("_to_id", "to_id")}).select(*edges.columns)
    return d.where("from_id <> to_id").dropDuplicates(["from_id", "to_id", "relationship"])


def upsert_relationships(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Relationships after new ones: (book_id, from_id, to_id, relationship, chapter, notes, source, updated, reason).

    One that the user wrote is locked: a new one of another source leaves it as it is, unless ``force``. Of repeated new
    ones the user's own counts, then the greatest chapter and notes; null keys are equal to null.
    """
    keys = ["book_id", "from_id", "to_id", "relationship"]
    fields = ["chapter", "notes", "source"]
    source = F.coalesce("source", F.lit("llm"))
    n = new.withColumn("source", source).groupBy(*keys).agg(F.max(F.struct((F.col("source") == USER).alias("mine"), *fields)).alias("n"))
    a, b = old.select(*keys, F.struct(*fields).alias("o")).alias("a"), n.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    d = a.join(b, same, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "o", "n")
    locked = (F.col("o.source") == USER) & (F.col("n.source") != USER) & F.lit(not force)
    locked = F.coalesce(locked, F.lit(False))
    taken = F.col("n").isNotNull() & ~locked
    return d.select(*keys, *[F.when(taken, F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields], taken.alias("updated"), F.when(locked, "locked by the user").alias("reason"))


def merge_profiles(profiles: DataFrame, moves: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Profiles (character_id, fields, source) after merges: the survivor's empty fields are filled from the absorbed.

    A merge in which the user wrote both profiles and they differ in a field is refused: its absorbed profile stays,
    with ``refused`` true. Of several absorbed profiles the one with the least id fills first.
    """
    m = moves.where("absorbed_id is not null and survivor_id is not null and absorbed_id <> survivor_id").groupBy("absorbed_id").agg(F.min("survivor_id").alias("_to"))
    own = profiles.select(F.col("character_id").alias("_to"), F.struct(*fields, "source").alias("own"))
    gone = profiles.join(m, profiles["character_id"] == m["absorbed_id"]).drop("absorbed_id").join(own, "_to")
    differ = reduce(lambda x, y: x | y, [F.coalesce(F.col(f) != F.col(f"own.{f}"), F.lit(False)) for f in fields])
    gone = gone.withColumn("refused", (F.col("source") == USER) & (F.col("own.source") == USER) & differ)
    filled = gone.where("not refused").groupBy(F.col("_to").alias("character_id")).agg(*[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("character_id"))).alias(f"_{f}") for f in fields])
    left = gone.where("not refused").select("character_id")
    refused = gone.where("refused").select("character_id", "refused")
    d = profiles.join(left, "character_id", "left_anti").join(filled, "character_id", "left").join(refused, "character_id", "left")
    return d.select("character_id", *[F.coalesce(f, f"_{f}").alias(f) for f in fields], "source", F.coalesce("refused", F.lit(False)).alias("refused"))


def promoted(edges: DataFrame, a: str, b: str, roles: DataFrame, least: int = 3) -> DataFrame:
    """(id, degree, role): ends of edges with their number of edges; a supporting one with ``least`` becomes main, none is demoted.

    ``roles`` has id and role; ends without one are supporting. An edge with a null end counts for neither.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = e.select(F.col(a).alias("id")).unionAll(e.select(F.col(b).alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    role = F.coalesce("role", F.lit("supporting"))
    return n.join(roles.select("id", "role"), "id", "left").select("id", "degree", F.when((F.col("degree") >= least) & (role == "supporting"), "main").otherwise(role).alias("role"))


def merged_edges(edges: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """(low, high, dominant, edges, dominant_edges, others): one edge per unordered pair; its commonest label, ties by the label, and the others in that order."""
    d = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    d = d.groupBy("low", "high").agg(F.sum("n").alias("edges"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))).alias("l"))  # as many as labels
    return d.select("low", "high", F.col("l")[0]["label"].alias("dominant"), "edges", (-F.col("l")[0]["n"]).alias("dominant_edges"), F.transform(F.slice("l", 2, 1 << 30), lambda x: x["label"]).alias("others"))


def split_aliases(aliases: DataFrame, source_id: str, new_id: str, moved: Sequence[str]) -> DataFrame:
    """Aliases after some of one entity went to a new one; they count as written by the user from then on."""
    keys = [m.strip().lower() for m in moved]
    hit = (F.col("character_id") == source_id) & N.key(F.col("alias")).isin(keys)
    return aliases.withColumns({"source": F.when(hit, USER).otherwise(F.col("source")), "character_id": F.when(hit, new_id).otherwise(F.col("character_id"))})


def patched_confidence(value: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 2)


def upsert_characters(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Outer merge in which a null or 'unknown' new value never replaces an old one; of repeated new keys the greatest values count."""
    n = new.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(F.when(F.col(f) != "unknown", F.col(f))).alias(f"_{f}") for f in fields])
    d = old.join(n, key, "full")
    return d.select(key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


def stale_after(queue: DataFrame, chapter: int) -> DataFrame:
    """Waiting entries that refer to this chapter or a later one become stale."""
    return queue.withColumn("status", F.when((F.col("status") == "pending") & (F.col("chapter") >= chapter), "stale").otherwise(F.col("status")))


def accept_all(queue: DataFrame, group: str, target: str, field: str, order: Sequence[str]) -> DataFrame:
    """The queue in order: the last entry of each target and field holds, earlier ones are 'superseded', unreadable ones 'skipped'."""
    ok = F.col("value").isNotNull()
    w = Window.partitionBy(group, target, field).orderBy(*[F.desc(c) for c in order])
    return queue.withColumn("_r", F.when(ok, F.sum(ok.cast("int")).over(w))).withColumn("outcome", F.when(~ok, "skipped").when(F.col("_r") == 1, "applied").otherwise("superseded")).drop("_r")


def ensure(names: DataFrame, roster: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """(name, character_id, created): every name with its entity, new ones made for names that no rule resolves.

    New ids are digests of the key, so names that differ in case or spaces only share one and a repeated run makes the
    same ids; within one batch the outcome doesn't depend on the order of the names. Null and blank names give no row.
    """
    d = resolve(names.select(name).where(F.trim(name) != "").distinct(), roster, aliases, name)
    made = F.concat(F.lit("new-"), F.md5(N.key(F.col(name))))
    return d.select(name, F.coalesce("character_id", made).alias("character_id"), F.col("character_id").isNull().alias("created"))


def assign_voices(characters: DataFrame, book: str, key: str, voices: int) -> DataFrame:
    """A pool voice from 0 for every character: the most important first, each voice used once before any is used again."""
    w = Window.partitionBy(book).orderBy(F.desc("importance"), key)
    return characters.withColumn("voice", (F.row_number().over(w) - 1) % voices)
