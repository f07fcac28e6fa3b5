"""Collector health from the sighting log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, read
from ..operators import health as H

NOW = "2026-08-18T00:00:00Z"
RESULTS = """results as (select s.run_id, s.collector_host, s.branch, p.source_locator as feed_url, min(cast(s.observed_at as timestamptz)) as run_at, count(*) as n_entries, count(*) filter (is_new) as n_new
  from sightings s join payloads p using (entry_key, content_hash) group by 1, 2, 3, 4)"""


def _results(spark, d):
    feeds = read(spark, d, "payloads").select("entry_key", "content_hash", F.col("source_locator").alias("feed_url"))
    return H.results_of_sightings(read(spark, d, "sightings"), feeds)


def _now():
    return F.to_timestamp(F.lit(NOW))


def _latest(results):
    """Rows of each feed's last run."""
    from ..operators.history import keep_first

    return keep_first(results, ["feed_url"], [F.desc("run_at"), F.desc("run_id"), F.asc("collector_host"), F.asc("branch")])


ISO = "strftime(timezone('UTC', run_at), '%Y-%m-%dT%H:%M:%SZ')"


@query(f"with {RESULTS} select run_id, collector_host, branch, feed_url, {ISO} as run_at, n_entries, n_new from results")
def feed_results(spark, d):
    return _results(spark, d).select("run_id", "collector_host", "branch", "feed_url", F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("run_at"), "n_entries", "n_new")


@query(
    f"""with {RESULTS}, inside as (select * from results where run_at >= cast('{NOW}' as timestamptz) - interval 2400 hour and run_at <= cast('{NOW}' as timestamptz)), o as (select min(run_at) as oldest from inside),
        l as (select feed_url, max(run_at) filter (n_new > 0) as last_new from inside group by 1)
        select feed_url, round((epoch_us(cast('{NOW}' as timestamptz)) - epoch_us(coalesce(last_new, oldest))) / 3600000000.0, 4) as hours from l, o"""
)
def staleness_hours(spark, d):
    return H.hours_since_new(_results(spark, d), _now(), 2400).select("feed_url", F.round("hours", 4).alias("hours"))


STALE = f"""{RESULTS}, latest as (select * from (select *, row_number() over (partition by feed_url order by run_at desc, run_id desc, collector_host, branch) as k from results) where k = 1),
quiet as (select feed_url, max(run_at) over () as now from latest where n_new = 0), clock as (select max(run_at) as now from results),
inside as (select r.* from results r, clock where run_at >= now - interval 72 hour and run_at <= now), o as (select min(run_at) as oldest from inside), l as (select feed_url, max(run_at) filter (n_new > 0) as last_new from inside group by 1),
aged as (select q.feed_url, (epoch_us(clock.now) - epoch_us(coalesce(last_new, oldest))) / 3600000000.0 as hours from quiet q join l using (feed_url), o, clock)"""


@query(f"with {STALE} select feed_url, round(hours, 4) as hours, 6.0::double as threshold from aged where hours >= 6")
def stale_flags(spark, d):
    results = _results(spark, d)
    now = results.agg(F.max("run_at").alias("now")).head()["now"]  # one row
    at = F.lit(now) if now is not None else F.lit(None).cast("timestamp")
    return H.stale_feeds(results, _latest(results), at).select("feed_url", "hours", "threshold")


@query(f"with {RESULTS} select branch, collector_host, feed_url, strftime(timezone('UTC', min(run_at)), '%Y-%m-%dT%H:%M:%SZ') as feed_started_at from results where n_entries > 0 group by 1, 2, 3")
def feed_first_seen(spark, d):
    return H.feed_starts(_results(spark, d)).withColumn("feed_started_at", F.date_format("feed_started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


EMPTY = "probe as (select run_id, collector_host, branch, feed_url, run_at, case when n_new = 0 then 0 else n_entries end as n_entries, n_new from results)"
ISSUES = f"""{RESULTS}, {EMPTY}, starts as (select branch, collector_host, feed_url, min(run_at) as s from probe where n_entries > 0 group by 1, 2, 3),
issues as (select p.branch, p.collector_host, p.feed_url, p.run_id, '0 entries this run (established feed)' as issue from probe p join starts using (branch, collector_host, feed_url) where n_entries = 0 and s < run_at)"""


def _probe(spark, d):
    """Results in which a run without new payloads counts as empty."""
    return _results(spark, d).withColumn("n_entries", F.when(F.col("n_new") == 0, 0).otherwise(F.col("n_entries")))


@query(f"with {ISSUES} select * from issues")
def feed_issue_flags(spark, d):
    probe = _probe(spark, d)
    return H.feed_issues(probe, H.feed_starts(probe))


@query(f"with {ISSUES}, per as (select run_id, cast(sum(n_entries) as bigint) as n_entries, cast(sum(n_new) as bigint) as n_new from probe group by 1), bad as (select run_id, count(*) as c from issues group by 1) select per.*, coalesce(c, 0) as issues, coalesce(c, 0) = 0 as ping_ok from per left join bad using (run_id)")
def run_verdicts(spark, d):
    probe = _probe(spark, d)
    return H.run_verdicts(probe, H.feed_issues(probe, H.feed_starts(probe)))


@query(f"with {RESULTS}, runs as (select run_id, min(run_at) as run_at, cast(sum(n_new) as bigint) as n_new from results group by 1) select run_id, {ISO} as run_at, n_new from (select * from runs order by run_at desc, run_id desc limit 10)")
def last_runs(spark, d):
    runs = _results(spark, d).groupBy("run_id").agg(F.min("run_at").alias("run_at"), F.sum("n_new").alias("n_new"))
    return H.last_runs(runs, 10).withColumn("run_at", F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@query(f"with {RESULTS} select run_id, branch, feed_url, n_entries, n_new from results")
def heartbeat_explode(spark, d):
    """Results nested into heartbeat records (map of branches, array of feeds) and taken apart again."""
    results = _results(spark, d)
    one = F.struct(
        F.col("feed_url").alias("feed_id"), "feed_url", F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("content_encoding"), F.col("n_entries").cast("int").alias("n_entries"),
        F.col("n_new").cast("int").alias("n_new"), F.lit(None).cast("string").alias("error"),
    )
    per_branch = results.groupBy("run_id", "collector_host", "branch").agg(F.min("run_at").alias("run_at"), F.struct(F.lit(True).alias("ok"), F.collect_list(one).alias("per_feed")).alias("child"))
    beats = per_branch.groupBy("run_id", "collector_host").agg(F.min("run_at").alias("run_at"), F.map_from_entries(F.collect_list(F.struct("branch", "child"))).alias("children"))
    return H.feed_results(beats).select("run_id", "branch", "feed_url", F.col("n_entries").cast("long").alias("n_entries"), F.col("n_new").cast("long").alias("n_new"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k <= 3")
def last_n_per_key(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("user_id", "event_id")
