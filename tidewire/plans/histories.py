"""Histories, seen index, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, read
from ..operators import history

REF = "'log#raw_record_id=' || raw_record_id"


def _ref():
    return F.concat(F.lit("log#raw_record_id="), "raw_record_id")


@query("select entry_key, min(observed_at) as first_seen_at, max(observed_at) as last_seen_at from sightings group by entry_key")
def first_last_seen(spark, d):
    return history.sighting_times(read(spark, d, "sightings"))


@query(
    """select entry_key, raw_record_id, content_hash, observed_at from (select *, row_number() over (partition by entry_key order by observed_at, raw_record_id) as k from payloads) where k = 1"""
)
def earliest_payload(spark, d):
    return history.earliest_payloads(read(spark, d, "payloads")).select("entry_key", "raw_record_id", "content_hash", "observed_at")


@query(
    f"""with p as (select entry_key, content_hash, min(observed_at) as first_seen_at, arg_min({REF}, (observed_at, raw_record_id)) as payload_ref from payloads group by 1, 2),
        s as (select entry_key, content_hash, max(observed_at) as l from sightings group by 1, 2)
        select p.entry_key, p.content_hash, first_seen_at, greatest(first_seen_at, l) as last_seen_at, payload_ref from p left join s using (entry_key, content_hash)"""
)
def seen_index_rebuild(spark, d):
    return history.rebuild_seen(read(spark, d, "payloads"), read(spark, d, "sightings"), _ref())


@query(
    """with b as (select item_no, entry_key, content_hash, row_number() over (partition by entry_key, content_hash order by item_no) as k from incoming_records)
       select item_no, k = 1 and not exists (select 1 from seen s where s.entry_key = b.entry_key and s.content_hash = b.content_hash) as is_new from b"""
)
def seen_new_flag(spark, d):
    return history.flag_new(read(spark, d, "incoming_records"), read(spark, d, "seen"), [F.col("item_no")]).select("item_no", "is_new")


@query(
    """with b as (select *, row_number() over (partition by entry_key, content_hash order by item_no) as k from incoming_records)
       select run_id, count(*) as records, count(*) filter (k = 1 and not exists (select 1 from seen s where s.entry_key = b.entry_key and s.content_hash = b.content_hash)) as new_records from b group by run_id"""
)
def new_per_batch(spark, d):
    flagged = history.flag_new(read(spark, d, "incoming_records"), read(spark, d, "seen"), [F.col("item_no")])
    return flagged.groupBy("run_id").agg(F.count("*").alias("records"), F.count_if("is_new").alias("new_records"))


@query(
    """with u as (select entry_key, content_hash, first_seen_at, last_seen_at, payload_ref from seen union all select entry_key, content_hash, observed_at, observed_at, 'in#' || item_no from incoming_records)
       select entry_key, content_hash, min(first_seen_at) as first_seen_at, max(last_seen_at) as last_seen_at, arg_min(payload_ref, (first_seen_at, payload_ref)) as payload_ref from u group by 1, 2"""
)
def seen_upsert(spark, d):
    batch = read(spark, d, "incoming_records").withColumn("payload_ref", F.concat(F.lit("in#"), "item_no"))
    return history.upsert_seen(read(spark, d, "seen"), batch)


def _candidate_rows(df):
    return df.select("url", "publisher_id", "first_seen_at", F.col("first_seen_at").alias("last_seen_at"), "collection_mode", "raw_payload_ref")


@query(
    """with u as (select url, publisher_id, first_seen_at, first_seen_at as last_seen_at, collection_mode, raw_payload_ref, case when trim(coalesce(url, '')) <> '' then url else raw_payload_ref end as k from articles_master
                  union all select url, publisher_id, first_seen_at, first_seen_at, collection_mode, raw_payload_ref, case when trim(coalesce(url, '')) <> '' then url else raw_payload_ref end from articles_clustered),
       r as (select *, row_number() over (partition by k order by first_seen_at nulls last, raw_payload_ref nulls last) as n, max(last_seen_at) over (partition by k) as latest from u)
       select url, publisher_id, first_seen_at, latest as last_seen_at, collection_mode, raw_payload_ref from r where n = 1"""
)
def history_merge(spark, d):
    rows = history.merge_history(_candidate_rows(read(spark, d, "articles_clustered")), _candidate_rows(read(spark, d, "articles_master")))
    return rows.select("url", "publisher_id", "first_seen_at", "last_seen_at", "collection_mode", "raw_payload_ref")


@query(
    """select url, arg_min(article_id, (first_seen_at, article_id)) as article_id, arg_max(title, (first_seen_at, title)) filter (title is not null) as title,
              arg_max(publisher_domain, (first_seen_at, publisher_domain)) filter (publisher_domain is not null) as publisher_domain,
              arg_max(source_system, (first_seen_at, source_system)) filter (source_system is not null) as source_system, min(first_seen_at) as first_seen_at, max(first_seen_at) as last_seen_at
       from articles_master where trim(coalesce(url, '')) <> '' group by url"""
)
def history_merge_by_url(spark, d):
    return history.merge_by_url(read(spark, d, "articles_master").withColumn("last_seen_at", F.col("first_seen_at")))


@query(
    """select article_id, canonical_url, first_seen_at from (select *, row_number() over (partition by canonical_url order by first_seen_at, raw_payload_ref) as k from articles_master) where k = 1"""
)
def keep_first_by_key(spark, d):
    rows = history.keep_first(read(spark, d, "articles_master"), ["canonical_url"], [F.col("first_seen_at"), F.col("raw_payload_ref")])
    return rows.select("article_id", "canonical_url", "first_seen_at")


@query(
    """select item_no, entry_key from (select *, row_number() over (partition by case when trim(coalesce(payload.link, '')) <> '' then payload.link else content_hash end order by item_no) as k from incoming_records) where k = 1"""
)
def in_batch_dedup(spark, d):
    from ..functions.hashing import candidate_key

    rows = read(spark, d, "incoming_records").withColumn("_key", candidate_key(F.col("payload.link"), F.col("content_hash")))
    return history.keep_first(rows, ["_key"], [F.col("item_no")]).select("item_no", "entry_key")


@query(
    f"""with e as (select *, row_number() over (partition by entry_key order by observed_at, raw_record_id) as k, {REF} as ref from payloads),
        s as (select entry_key, min(observed_at) as f, max(observed_at) as l from sightings group by 1)
        select coalesce(nullif(payload.link, ''), '') as url, publisher_id_hint, source_locator as feed_url, source_system, coalesce(f, observed_at) as first_seen_at, coalesce(l, observed_at) as last_seen_at,
               'prospective' as collection_mode, ref as raw_payload_ref from e left join s using (entry_key) where k = 1"""
)
def candidate_table(spark, d):
    return history.candidates(read(spark, d, "payloads"), read(spark, d, "sightings"), _ref(), "domestic").drop("entry_json")


@query(
    f"""with e as (select *, row_number() over (partition by entry_key order by observed_at, raw_record_id) as k, {REF} as ref from payloads),
        s as (select entry_key, min(observed_at) as f, max(observed_at) as l from sightings group by 1)
        select coalesce(nullif(payload.link, ''), '') as url, publisher_id_hint as publisher_id, source_system, coalesce(f, observed_at) as first_seen_at, coalesce(l, observed_at) as last_seen_at,
               'prospective' as collection_mode, ref as raw_payload_ref, nullif(payload.title, '') as title, coalesce(nullif(payload.summary, ''), nullif(payload.description, '')) as description,
               nullif(payload.category, '') as category, coalesce(nullif(payload.published, ''), nullif(payload.pubdate, ''), nullif(payload.updated, '')) as published_raw from e left join s using (entry_key) where k = 1"""
)
def candidate_table_international(spark, d):
    return history.candidates(read(spark, d, "payloads"), read(spark, d, "sightings"), _ref(), "international")


@query("select s.entry_key, s.content_hash from seen s where not exists (select 1 from sightings g where g.entry_key = s.entry_key and g.content_hash = s.content_hash and g.observed_at = s.last_seen_at)")
def seen_behind_log(spark, d):
    """Pairs of the seen index whose last sighting is not in the log (anti join)."""
    log = read(spark, d, "sightings").select("entry_key", "content_hash", F.col("observed_at").alias("last_seen_at")).distinct()
    return read(spark, d, "seen").join(log, ["entry_key", "content_hash", "last_seen_at"], "left_anti").select("entry_key", "content_hash")


@query("select distinct entry_key from incoming_records i where exists (select 1 from seen s where s.entry_key = i.entry_key)")
def seen_known_entries(spark, d):
    """Incoming entries already known by address (semi join)."""
    return read(spark, d, "incoming_records").select("entry_key").distinct().join(read(spark, d, "seen").select("entry_key").distinct(), "entry_key", "left_semi")
