"""Collector health: per-feed results of runs, issues, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours after which a feed without new payloads is stale.
DEFAULT_STALE_HOURS = 6.0
STALE_HOURS = {
    "bbc.com": 18.0,
    "channelnewsasia.com": 18.0,
    "scmp.com": 18.0,
    "asia.nikkei.com": 18.0,
    "straitstimes.com": 18.0,
    "vnexpress": 10.0,
    "vietnamnet": 10.0,
    "vietnamplus": 10.0,
    "baotintuc": 10.0,
    "tienphong": 10.0,
    "sggp": 10.0,
    "nhandan": 10.0,
}


def stale_hours(feed: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in STALE_HOURS.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, feed), F.lit(DEFAULT_STALE_HOURS))


def feed_results(heartbeats: DataFrame) -> DataFrame:
    """One row per run, branch and feed from the nested heartbeat log."""
    children = heartbeats.select("run_id", F.to_timestamp("run_at").alias("run_at"), "collector_host", F.explode("children").alias("branch", "child"))
    return children.select("run_id", "run_at", "collector_host", "branch", F.explode("child.per_feed").alias("f")).select("run_id", "run_at", "collector_host", "branch", "f.*")


def results_of_sightings(sightings: DataFrame, feeds: DataFrame) -> DataFrame:
    """The same rows from the sighting log: entries and new payloads per run and feed.

    ``feeds``: (entry_key, content_hash, feed_url).
    """
    joined = sightings.join(feeds, ["entry_key", "content_hash"])
    grouped = joined.groupBy("run_id", "collector_host", "branch", "feed_url")
    return grouped.agg(F.min(F.to_timestamp("observed_at")).alias("run_at"), F.count("*").alias("n_entries"), F.count_if("is_new").alias("n_new"))


def hours_since_new(results: DataFrame, now: Column, look_back_hours: float, feed: str = "feed_url") -> DataFrame:
    """Per feed: hours since it last had a new payload within the look-back, else since the oldest run in it.

    A feed without any run in the look-back has no row.
    """
    since = now - F.make_dt_interval(hours=F.lit(int(look_back_hours)))
    inside = results.filter((F.col("run_at") >= since) & (F.col("run_at") <= now))
    oldest = inside.agg(F.min("run_at").alias("oldest"))
    last = inside.groupBy(feed).agg(F.max(F.when(F.col("n_new") > 0, F.col("run_at"))).alias("last_new"))
    at = F.coalesce("last_new", "oldest")
    return last.crossJoin(oldest).select(feed, ((F.unix_micros(now) - F.unix_micros(at)) / 3_600_000_000.0).alias("hours"))


def stale_feeds(results: DataFrame, current: DataFrame, now: Column, feed: str = "feed_url") -> DataFrame:
    """Feeds with nothing new in the ``current`` run whose last new payload is as old as their threshold."""
    longest = max(4 * max(STALE_HOURS.values()), 24.0)
    quiet = current.groupBy(feed).agg(F.sum("n_new").alias("n")).filter("n = 0").select(feed)
    hours = hours_since_new(results, now, longest, feed)
    limit = stale_hours(F.col(feed))
    aged = quiet.join(hours, feed).withColumn("threshold", limit).filter(F.col("hours") >= F.col("threshold"))
    text = F.format_string("%s: no new payload in %.1fh (threshold %.1fh)", F.col(feed), F.col("hours"), F.col("threshold"))
    return aged.select(feed, F.round("hours", 4).alias("hours"), "threshold", text.alias("issue"))


def feed_starts(results: DataFrame) -> DataFrame:
    """First run in which a feed gave an entry: set once, never moved."""
    return results.filter("n_entries > 0").groupBy("branch", "collector_host", "feed_url").agg(F.min("run_at").alias("feed_started_at"))


def feed_issues(current: DataFrame, starts: DataFrame) -> DataFrame:
    """Problems visible in one run: a stated error, or no entries from a feed that had some before."""
    joined = current.join(starts, ["branch", "collector_host", "feed_url"], "left")
    error = F.coalesce(F.col("error"), F.lit("")) if "error" in current.columns else F.lit("")
    started = F.col("feed_started_at").isNotNull() & (F.col("feed_started_at") < F.col("run_at"))
    issue = F.when(error != "", error).when((F.col("n_entries") == 0) & started, "0 entries this run (established feed)")
    return joined.withColumn("issue", issue).filter("issue is not null").select("branch", "collector_host", "feed_url", "run_id", "issue")


def run_verdicts(results: DataFrame, issues: DataFrame) -> DataFrame:
    """Per run: entries, new payloads, number of issues, and whether all is well."""
    per = results.groupBy("run_id").agg(F.sum("n_entries").alias("n_entries"), F.sum("n_new").alias("n_new"))
    bad = issues.groupBy("run_id").agg(F.count("*").alias("issues"))
    return per.join(bad, "run_id", "left").fillna(0, ["issues"]).withColumn("ping_ok", F.col("issues") == 0)


def last_runs(runs: DataFrame, most: int, by: str = "run_at", tie: str = "run_id") -> DataFrame:
    """The last runs, oldest first."""
    return runs.orderBy(F.desc(by), F.desc(tie)).limit(most).orderBy(by, tie)


def feed_result(feed_id: Column, feed_url: Column, status: Column, encoding: Column, entries: Column, new: Column, error: Column) -> Column:
    """The result of one poll of one feed."""
    named = {"feed_id": feed_id, "feed_url": feed_url, "http_status": status.cast("int"), "content_encoding": encoding, "n_entries": entries.cast("int"), "n_new": new.cast("int"), "error": error}
    return F.struct(*(v.alias(k) for k, v in named.items()))


FEED_RESULT = "feed_id string, feed_url string, http_status int, content_encoding string, n_entries int, n_new int, error string"
RESULT_LINE = "FEED_RESULTS "  # begins the line that carries the results of a run


def result_line(results: Column) -> Column:
    """One line of JSON that carries the results of a run's feeds."""
    return F.concat(F.lit(RESULT_LINE), F.to_json(results, {"ignoreNullFields": "false"}))


def results_of(stdout: Column) -> Column:
    """The feed results in a collector's printed lines: the last line that begins with the prefix; null without one or if it is broken."""
    lines = F.filter(F.split(stdout, "\n"), lambda x: F.startswith(x, F.lit(RESULT_LINE)))
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1))
    return F.from_json(F.substring(last, len(RESULT_LINE) + 1, 1 << 30), f"array<struct<{FEED_RESULT.replace(' ', ': ').replace(',:', ',')}>>")


def reported_counts(stdout: Column) -> tuple[Column, Column]:
    """(new payloads, entries seen) from a collector's printed lines; null where a line is missing."""
    number = lambda label: F.nullif(F.regexp_replace(F.regexp_extract(stdout, rf"(?m)^{label}\s*:\s*([\d,]+)", 1), ",", ""), F.lit("")).cast("long")
    return number("New payloads archived"), number("Entries seen this run")
