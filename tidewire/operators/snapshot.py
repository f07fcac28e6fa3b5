"""Snapshots over all collectors: where a reference comes from, when its feed was first watched, late articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import is_pre_start
from .cleaning import snapshot
from .history import candidates
from .stage import Stage

FEED = ["branch", "collector_host", "source_locator"]


def reference_sources(payloads: DataFrame, sightings: DataFrame) -> DataFrame:
    """(raw_payload_ref, branch, collector_host, source_locator): the feed that first brought each reference.

    Branch and host are those of its earliest sighting; the locator is that of the archived record, null if that
    is not at hand.
    """
    first = sightings.filter("payload_ref is not null").groupBy(F.col("payload_ref").alias("raw_payload_ref"))
    first = first.agg(F.min(F.struct("observed_at", "branch", "collector_host")).alias("s")).select("raw_payload_ref", "s.branch", "s.collector_host", F.substring_index("raw_payload_ref", "=", -1).alias("raw_record_id"))
    locators = payloads.groupBy("raw_record_id").agg(F.min("source_locator").alias("source_locator"))
    return first.join(locators, "raw_record_id", "left").select("raw_payload_ref", *FEED)


def merged(*maps: DataFrame, key: str = "raw_payload_ref") -> DataFrame:
    """Tables of one value each per key under each other; where a key stands in several, the last table wins."""
    columns = [c for c in maps[0].columns if c != key]
    every = None
    for k, m in enumerate(maps):
        one = m.select(key, F.struct(F.lit(k).alias("k"), *columns).alias("v"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.max("v").alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in columns))


def feed_starts(sightings: DataFrame, sources: DataFrame) -> DataFrame:
    """(branch, collector_host, source_locator, feed_started_at): the first sighting that each collector has of a feed."""
    located = sightings.join(sources.select(F.col("raw_payload_ref").alias("payload_ref"), "source_locator"), "payload_ref")
    return located.filter("source_locator is not null").groupBy(*FEED).agg(F.min("observed_at").alias("feed_started_at"))


def with_pre_start(articles: DataFrame, sources: DataFrame, starts: DataFrame) -> DataFrame:
    """``articles`` with ``is_pre_start``: published before its feed was watched; null where reference, feed or a time is unknown."""
    known = sources.join(starts, FEED, "left").select("raw_payload_ref", "feed_started_at")
    joined = articles.join(known, "raw_payload_ref", "left")
    return joined.select(*articles.columns, is_pre_start(F.col("published_at"), F.col("feed_started_at")).alias("is_pre_start"))


def snapshot_of_branch(payloads: DataFrame, sightings: DataFrame, branch: str, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(relevant articles with ``is_pre_start``, audit rows) of one branch over all its collectors: candidates, window,
    cleaning, relevance, and the chain reference -> feed -> start."""
    own = sightings.filter(F.col("branch") == branch)
    sources = Stage(payloads.sparkSession, "sources").write(reference_sources(payloads, own))
    referred = payloads.join(sources.select("raw_payload_ref", F.substring_index("raw_payload_ref", "=", -1).alias("raw_record_id")), "raw_record_id")
    rows = candidates(referred, own, F.col("raw_payload_ref"), branch)
    if branch == "international":
        none = F.lit(None).cast("string")
        rows = rows.withColumns({c: none for c in ("publisher_domain", "publisher_group_id", "publisher_country", "language", "source_seen_at")})
        rows = rows.withColumn("published_at", F.col("published_raw")).withColumn("timestamp_confidence", none)
    found, audit = snapshot(rows, branch, since, until)
    return with_pre_start(found, sources, feed_starts(own, sources)), audit
