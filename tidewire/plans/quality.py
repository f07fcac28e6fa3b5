"""Contract checks, unions, cleaning, profiles and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, read
from ..functions import times
from ..operators import cleaning, cluster, contract, history, profile, run, snapshot
from ..operators.stage import spread
from ..schemas import ARTICLE_COLUMNS
from ..streaming.ingest import late_flags
from .scalars import CANONICAL, _rule_sql

OFFSET = "coalesce(regexp_matches({c}, '([Zz]|[+-]00:?00)$') and try_cast({c} as timestamptz) is not null, false)"
EXACT_REF = "coalesce(contains(raw_payload_ref, '#raw_record_id=') and regexp_extract(raw_payload_ref, '([^=]*)$', 1) <> '', false)"
RULES_SQL = {
    "branch": "not coalesce(branch in ('domestic', 'international'), false)",
    "collection_mode": "not coalesce(collection_mode in ('prospective', 'historical_backfill'), false)",
    "timestamp_confidence": "not coalesce(timestamp_confidence in ('publisher_reported', 'publisher_reported_timezone_inferred', 'unavailable'), false)",
    "first_seen_at": f"not {OFFSET.format(c='first_seen_at')}",
    "published_at": f"published_at is not null and not {OFFSET.format(c='published_at')}",
    "article_id": "trim(coalesce(article_id, '')) = ''",
    "title": "trim(coalesce(title, '')) = ''",
    "canonical_url": "trim(coalesce(canonical_url, '')) = ''",
    "raw_payload_ref": f"not {EXACT_REF}",
    "vietnam_relevance": "vietnam_relevance is null",
    "duplicate_family_id": "duplicate_family_id is not null",
}


def _master(spark, d):
    return read(spark, d, "articles_master")


def _clustered(spark, d):
    return read(spark, d, "articles_clustered")


@query(" union all ".join(f"select '{name}' as rule, count(*) filter ({breaks}) as rows from articles_clustered" for name, breaks in RULES_SQL.items()))
def contract_violations(spark, d):
    return contract.violations(_clustered(spark, d), contract.row_rules())


@query("select distinct timestamp_confidence as value from articles_master where not coalesce(timestamp_confidence in ('publisher_reported'), false) order by 1 limit 5")
def violation_examples(spark, d):
    """Up to five values of a rule that allows publisher-reported times only."""
    breaks = ~F.coalesce(F.col("timestamp_confidence").isin("publisher_reported"), F.lit(False))
    return contract.examples(_master(spark, d), "timestamp_confidence", breaks)


@query(
    """with n as (select article_id, count(*) as n from articles_master group by 1) select cast(sum(n) as bigint) as rows, cast(coalesce(sum(n) filter (article_id is null), 0) as bigint) as null_keys,
       count(*) filter (article_id is not null and n > 1) as repeated_keys, cast(coalesce(sum(n - 1) filter (article_id is not null and n > 1), 0) as bigint) as rows_beyond_first from n"""
)
def dup_value_profile(spark, d):
    return contract.uniqueness(_master(spark, d), "article_id")


@query(f"select {', '.join(ARTICLE_COLUMNS)} from articles_master where branch in ('domestic', 'international') and vietnam_relevance")
def master_build(spark, d):
    """The relevant rows of both branches validated, united and validated again."""
    rows = _master(spark, d).filter("vietnam_relevance")
    return contract.build_master(rows.filter("branch = 'domestic'"), rows.filter("branch = 'international'"))[0]


@query("select unnest(['rows_lost', 'rows_added', 'no_event', 'family_split']) as rule, cast(0 as bigint) as rows")
def output_problems(spark, d):
    """The checks on the events that the clustering gives: none may fail."""
    rows = _clustered(spark, d).drop("event_cluster_id")
    units = cluster.units(rows, read(spark, d, "article_vectors"))
    return contract.output_problems(rows, cluster.propagate(rows, cluster.cluster(units)))


@query("""select 'rows_lost' as rule, count(*) filter (event_cluster_id is null) as rows from articles_clustered union all select 'rows_added', cast(0 as bigint) union all select 'no_event', cast(0 as bigint)
       union all select 'family_split', (select count(*) from (select duplicate_family_id from articles_clustered where duplicate_family_id is not null and event_cluster_id is not null group by 1 having count(distinct event_cluster_id) > 1))""")
def output_problems_of_stored(spark, d):
    """The same checks on an output that is wrong: the stored events without the rows that have none."""
    rows = _clustered(spark, d)
    return contract.output_problems(rows.drop("event_cluster_id"), rows.filter("event_cluster_id is not null"))


MARK = "cast(sum(cast('0x' || substr(md5(concat_ws(chr(31), " + ", ".join(f"coalesce(cast({c} as varchar), '\\N')" for c in ARTICLE_COLUMNS) + ")), 1, 15) as hugeint)) as varchar)"


@query(f"select count(*) as rows, {MARK} as fingerprint from articles_clustered")
def content_fingerprint(spark, d):
    return contract.content_fingerprint(_clustered(spark, d).drop("event_cluster_id"))


@query(f"select count(*) as rows, {MARK} as fingerprint, count(*) as total_articles from (select * replace (cast(null as varchar) as duplicate_family_id) from articles_clustered)")
def clustering_run(spark, d):
    """A whole run from the contract's gates to the manifest; its events are compared with ``event_clusters`` in the tests."""
    rows = _clustered(spark, d).drop("event_cluster_id").withColumn("duplicate_family_id", F.lit(None).cast("string")).select(*ARTICLE_COLUMNS)
    return run.clustering_run(rows, read(spark, d, "article_vectors")).manifest.select("rows", "fingerprint", "total_articles")


@query("select branch, category, count(*) as rows from articles_master group by 1, 2")
def counts_by_group(spark, d):
    return profile.counts_by(_master(spark, d), "branch", "category")


@query("select coalesce(cast(vietnam_relevance as varchar), 'unknown') as value, count(*) as rows from articles_master group by 1")
def tri_state_counts(spark, d):
    return profile.tri_state(_master(spark, d), "vietnam_relevance")


@query(
    " union all ".join(
        f"select '{c}' as \"column\", '{'boolean' if c == 'vietnam_relevance' else 'string'}' as type, count(*) filter ({c} is null) as nulls, count(distinct {c}) as \"distinct\" from articles_master"
        for c in ARTICLE_COLUMNS
    )
)
def dataset_profile(spark, d):
    return profile.column_profile(_master(spark, d))


@query("select publisher_domain as value, count(*) as n from articles_master group by 1 order by n desc, value nulls last limit 10")
def top_publishers(spark, d):
    return profile.top_values(_master(spark, d), "publisher_domain")


@query(
    """select count(*) as rows, count(*) filter (branch = 'domestic') as domestic, count(*) filter (branch = 'international') as international, count(distinct publisher_id) as publishers,
              min(first_seen_at) as first_seen_min, max(first_seen_at) as first_seen_max from articles_master"""
)
def manifest_counts(spark, d):
    return profile.manifest(_master(spark, d))


@query("select article_id, first_seen_at from articles_clustered where try_cast(first_seen_at as timestamptz) >= '2026-03-10T00:00:00Z' and try_cast(first_seen_at as timestamptz) < '2026-04-10T00:00:00Z'")
def window_filter(spark, d):
    return _clustered(spark, d).filter(times.in_window(F.col("first_seen_at"), "2026-03-10T00:00:00Z", "2026-04-10T00:00:00Z")).select("article_id", "first_seen_at")


@query("select article_id from articles_clustered where collection_mode = 'prospective' and try_cast(first_seen_at as timestamptz) >= '2026-03-10T00:00:00Z' and try_cast(first_seen_at as timestamptz) < '2026-03-12T00:00:00Z'")
def pilot_window(spark, d):
    return _clustered(spark, d).filter(times.in_pilot(F.col("collection_mode"), F.col("first_seen_at"), "2026-03-10T00:00:00Z")).select("article_id")


STARTS = "starts as (select publisher_id_hint, min(observed_at) as started from payloads where publisher_id_hint is not null group by 1)"


@query(f"with {STARTS} select article_id, try_cast(published_at as timestamptz) < try_cast(started as timestamptz) as is_pre_start from articles_clustered a left join starts s on s.publisher_id_hint = a.publisher_id")
def is_pre_start(spark, d):
    starts = read(spark, d, "payloads").filter("publisher_id_hint is not null").groupBy(F.col("publisher_id_hint").alias("publisher_id")).agg(F.min("observed_at").alias("started"))
    rows = _clustered(spark, d).select("article_id", "publisher_id", "published_at").join(starts, "publisher_id", "left")
    return rows.select("article_id", times.is_pre_start(F.col("published_at"), F.col("started")).alias("is_pre_start"))


@query("select 'domestic' as branch, 'collector' as collector_host, source_locator as feed_url, min(observed_at) as feed_started_at, min(publisher_id_hint) as publisher_id_hint from payloads group by source_locator")
def feed_state_flatten(spark, d):
    """A nested state map built from the payloads, flattened again."""
    feeds = read(spark, d, "payloads").groupBy("source_locator").agg(F.struct(F.min("observed_at").alias("feed_started_at"), F.min("publisher_id_hint").alias("publisher_id_hint")).alias("f"))
    entry = F.map_from_entries(F.collect_list(F.struct("source_locator", "f")))
    state = feeds.agg(F.create_map(F.lit("domestic"), F.create_map(F.lit("collector"), entry)).alias("state"))
    return profile.flatten_feed_state(state)


def _ref():
    return F.concat(F.lit("log#raw_record_id="), "raw_record_id")


def _candidates(spark, d):
    return spread(history.candidates(read(spark, d, "payloads"), read(spark, d, "sightings"), _ref(), "domestic"), "raw_payload_ref")


BODY = "coalesce(nullif(payload.summary, ''), nullif(payload.description, ''), '')"
FIRST = "first as (select *, row_number() over (partition by entry_key order by observed_at, raw_record_id) as k from payloads)"
CLEAN = rf"""{FIRST}, seen_at as (select entry_key, min(observed_at) as f from sightings group by 1),
base as (select trim(coalesce(payload.link, '')) as url, trim(coalesce(payload.title, '')) as title, trim(regexp_replace({BODY}, '<[^>]+>', ' ', 'g')) as description, 'log#raw_record_id=' || raw_record_id as raw_payload_ref,
         coalesce(f, observed_at) as first_seen_at, publisher_id_hint from first left join seen_at using (entry_key) where k = 1),
canon as (select *, {CANONICAL} as canonical_url from base),
ruled as (select *, title || ' ' || description as text from canon)"""


@query(
    f"""with {CLEAN} select raw_payload_ref, case when canonical_url <> '' then substr(sha256(canonical_url), 1, 16) end as article_id, nullif(title, '') as title, nullif(canonical_url, '') as canonical_url, nullif(description, '') as description,
        strftime(timezone('UTC', try_cast(first_seen_at as timestamptz)), '%Y-%m-%dT%H:%M:%SZ') as first_seen_at, nullif(trim(publisher_id_hint), '') as publisher_id,
        nullif(concat_ws(';', case when title = '' then 'missing_title' end, case when canonical_url = '' then 'invalid_url' end), '') as rejection_reason,
        {_rule_sql().replace('url,', 'canonical_url,')} not in (0, 9, 13, 14, 15, 16, 17) as vietnam_relevance from ruled"""
)
def clean_domestic(spark, d):
    """Candidates of the domestic branch cleaned to audit rows."""
    rows = _candidates(spark, d)
    audit = cleaning.clean_domestic(rows)
    return audit.select("raw_payload_ref", "article_id", "title", "canonical_url", "description", "first_seen_at", "publisher_id", "rejection_reason", "vietnam_relevance")


@query(f"with {CLEAN} select coalesce(nullif(concat_ws(';', case when title = '' then 'missing_title' end, case when canonical_url = '' then 'invalid_url' end), ''), 'accepted') as reason, count(*) as rows from ruled group by 1")
def rejection_reasons(spark, d):
    rows = _candidates(spark, d)
    return cleaning.clean_domestic(rows).groupBy(F.coalesce("rejection_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("rows"))




@query(
    f"""with s as (select distinct title, url, first_seen_at, published_at, timestamp_confidence, raw_payload_ref, description, source_system, collection_mode, {CANONICAL.replace("'gidzl', ", "")} as canonical from articles_master where branch = 'international')
        select raw_payload_ref, case when canonical <> '' then substr(sha256(canonical), 1, 16) end as article_id, nullif(canonical, '') as canonical_url, nullif(trim(coalesce(title, '')), '') as title,
               case when source_system = 'gdelt_doc' or try_cast(published_at as timestamptz) is null then 'unavailable' when timestamp_confidence in ('publisher_reported', 'publisher_reported_timezone_inferred') then timestamp_confidence else 'publisher_reported' end as timestamp_confidence,
               case when source_system <> 'gdelt_doc' then strftime(timezone('UTC', try_cast(published_at as timestamptz)), '%Y-%m-%dT%H:%M:%SZ') end as published_at from s"""
)
def clean_international(spark, d):
    """International rows cleaned to audit rows."""
    columns = ["title", "url", "first_seen_at", "published_at", "timestamp_confidence", "raw_payload_ref", "description", "source_system", "collection_mode"]
    rows = _master(spark, d).filter("branch = 'international'").select(*columns).distinct()
    none = F.lit(None).cast("string")
    rows = rows.withColumns({c: none for c in ("publisher_domain", "publisher_id", "publisher_group_id", "publisher_country", "language", "category", "source_seen_at")})
    return cleaning.clean_international(rows).select("raw_payload_ref", "article_id", "canonical_url", "title", "timestamp_confidence", "published_at")


@query(
    f"""with {CLEAN}, good as (select *, {_rule_sql().replace('url,', 'canonical_url,')} not in (0, 9, 13, 14, 15, 16, 17) as ok, strftime(timezone('UTC', try_cast(first_seen_at as timestamptz)), '%Y-%m-%dT%H:%M:%SZ') as t from ruled where title <> '' and canonical_url <> ''
                   and try_cast(first_seen_at as timestamptz) >= '2026-03-01T00:00:00Z' and try_cast(first_seen_at as timestamptz) < '2026-06-01T00:00:00Z'),
        k as (select *, row_number() over (partition by canonical_url order by t, raw_payload_ref) as n from good where ok) select canonical_url, raw_payload_ref, t as first_seen_at from k where n = 1"""
)
def snapshot_relevant(spark, d):
    """Relevant articles of one branch first seen within three months, one row per canonical address."""
    rows = _candidates(spark, d)
    found, _ = cleaning.snapshot(rows, "domestic", "2026-03-01T00:00:00Z", "2026-06-01T00:00:00Z")
    return found.select("canonical_url", "raw_payload_ref", "first_seen_at")


SOURCES = """seen_first as (select payload_ref, branch, collector_host, split_part(payload_ref, '=', -1) as raw_record_id,
  row_number() over (partition by payload_ref order by observed_at, branch, collector_host) as k from sightings where payload_ref is not null),
sources as (select payload_ref as raw_payload_ref, branch, collector_host, source_locator from seen_first left join (select raw_record_id, min(source_locator) as source_locator from payloads group by 1) using (raw_record_id) where k = 1),
started as (select s.branch, s.collector_host, r.source_locator, min(s.observed_at) as feed_started_at from sightings s join sources r on r.raw_payload_ref = s.payload_ref where r.source_locator is not null group by all)"""


def _sources(spark, d):
    payloads, sightings = read(spark, d, "payloads"), read(spark, d, "sightings")
    parts = [snapshot.reference_sources(payloads, sightings.filter(F.col("branch") == b)) for b in ("domestic", "international")]
    return sightings, snapshot.merged(*parts)


@query(
    f"""with {SOURCES.replace('from sightings where payload_ref is not null', "from sightings where payload_ref is not null and branch = 'domestic'")}, second as (select payload_ref, arg_min(struct_pack(b := branch, h := collector_host), (observed_at, branch, collector_host)) as s from sightings where branch = 'international' and payload_ref is not null group by 1)
        select a.article_id, coalesce(s.b, r.branch) as branch, coalesce(s.h, r.collector_host) as collector_host, p.source_locator from articles_clustered a
        left join sources r using (raw_payload_ref) left join second on second.payload_ref = a.raw_payload_ref left join (select raw_record_id, min(source_locator) as source_locator from payloads group by 1) p on p.raw_record_id = split_part(a.raw_payload_ref, '=', -1)"""
)
def reference_sources(spark, d):
    """The feed of each article, the maps of both branches merged; the international one wins."""
    _, sources = _sources(spark, d)
    return _clustered(spark, d).select("article_id", "raw_payload_ref").join(sources, "raw_payload_ref", "left").select("article_id", "branch", "collector_host", "source_locator")


@query(f"with {SOURCES} select article_id, try_cast(published_at as timestamptz) < try_cast(feed_started_at as timestamptz) as is_pre_start from articles_clustered a left join sources r using (raw_payload_ref) left join started t on (t.branch, t.collector_host, t.source_locator) = (r.branch, r.collector_host, r.source_locator)")
def snapshot_pre_start(spark, d):
    """Articles published before their feed was watched, by reference, collector and feed."""
    sightings = read(spark, d, "sightings")
    sources = snapshot.reference_sources(read(spark, d, "payloads"), sightings)
    return snapshot.with_pre_start(_clustered(spark, d), sources, snapshot.feed_starts(sightings, sources)).select("article_id", "is_pre_start")


@query(
    f"""with {SOURCES} select s.branch, s.collector_host, try_cast(a.published_at as timestamptz) < try_cast(t.feed_started_at as timestamptz) as is_pre_start, count(*) as sightings
        from sightings s left join sources r on r.raw_payload_ref = s.payload_ref left join (select raw_payload_ref, min(published_at) as published_at from articles_clustered group by 1) a on a.raw_payload_ref = s.payload_ref
        left join started t on (t.branch, t.collector_host, t.source_locator) = (s.branch, s.collector_host, r.source_locator) group by all"""
)
def late_sightings(spark, d):
    """Sightings of articles that were published before the collector watched their feed."""
    sightings = read(spark, d, "sightings")
    sources = snapshot.reference_sources(read(spark, d, "payloads"), sightings)
    published = _clustered(spark, d).groupBy(F.col("raw_payload_ref").alias("payload_ref")).agg(F.min("published_at").alias("published_at"))
    located = sightings.join(sources.select(F.col("raw_payload_ref").alias("payload_ref"), "source_locator"), "payload_ref", "left").join(published, "payload_ref", "left")
    return late_flags(located, snapshot.feed_starts(sightings, sources)).groupBy("branch", "collector_host", "is_pre_start").agg(F.count("*").alias("sightings"))


@query()
def snapshot_branches(spark, d):
    """The snapshot of each branch over all collectors, with the flag of late articles."""
    parts = [snapshot.snapshot_of_branch(read(spark, d, "payloads"), read(spark, d, "sightings"), b)[0] for b in ("domestic", "international")]
    return parts[0].unionByName(parts[1]).select("branch", "article_id", "raw_payload_ref", "is_pre_start")


@query("select 'customer' as source, c_nationkey as nation, count(*) as rows from customer group by 2 union all select 'supplier', s_nationkey, count(*) from supplier group by 2")
def union_contract(spark, d):
    """Two tables of different columns united by name with a discriminator."""
    a = read(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"))
    b = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("source"))
    return a.unionByName(b).groupBy("source", "nation").agg(F.count("*").alias("rows"))
