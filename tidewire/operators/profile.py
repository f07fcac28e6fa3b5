"""Profiles and manifests of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls, distinct) for every column, from one pass."""
    sums = [a for c in df.columns for a in (F.count_if(F.col(c).isNull()).alias(f"{c}|n"), F.count_distinct(F.col(c)).alias(f"{c}|d"))]
    wide, kinds = df.agg(*sums), dict(df.dtypes)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"`{c}|n`").alias("nulls"), F.col(f"`{c}|d`").alias("distinct")) for c in df.columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def top_values(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The most frequent values, ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(most)


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per group; null is a group."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))


def tri_state(df: DataFrame, column: str) -> DataFrame:
    """Rows by true, false and unknown."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("rows"))


def manifest(df: DataFrame) -> DataFrame:
    """One row: rows, rows per branch, publishers, first and last sighting."""
    return df.agg(
        F.count("*").alias("rows"), F.count_if(F.col("branch") == "domestic").alias("domestic"), F.count_if(F.col("branch") == "international").alias("international"),
        F.count_distinct("publisher_id").alias("publishers"), F.min("first_seen_at").alias("first_seen_min"), F.max("first_seen_at").alias("first_seen_max"),
    )


def flatten_feed_state(state: DataFrame, column: str = "state") -> DataFrame:
    """Rows (branch, collector_host, feed_url, feed_started_at, publisher_id_hint) of the nested state map."""
    hosts = state.select(F.explode(column).alias("branch", "hosts"))
    feeds = hosts.select("branch", F.explode("hosts").alias("collector_host", "feeds"))
    return feeds.select("branch", "collector_host", F.explode("feeds").alias("feed_url", "f")).select("branch", "collector_host", "feed_url", "f.feed_started_at", "f.publisher_id_hint")
