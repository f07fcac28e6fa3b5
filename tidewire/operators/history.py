"""Histories: first and last sightings, keep-first by key, the seen index, candidate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import candidate_key
from ..functions.text import filled, first_filled


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two candidate tables with one row per candidate: the first seen, with the latest sighting.

    The candidate is its address, else its payload reference; ties of time go to the smaller reference.
    """
    both = old.unionByName(new).withColumn("_key", candidate_key(F.col("url"), F.col("raw_payload_ref")))
    latest = both.withColumn("last_seen_at", F.max("last_seen_at").over(Window.partitionBy("_key")))
    return keep_first(latest, ["_key"], [F.asc_nulls_last("first_seen_at"), F.asc_nulls_last("raw_payload_ref")]).drop("_key")


def merge_by_url(rows: DataFrame) -> DataFrame:
    """One row per address: earliest id, latest title, domain and source, earliest and latest sighting.

    Nulls never win over values; rows without an address go.
    """
    early = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("first_seen_at", c)))
    late = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("first_seen_at", c)))
    return (
        rows.filter(filled(F.col("url")))
        .groupBy("url")
        .agg(
            early("article_id").alias("article_id"),
            *(late(c).alias(c) for c in ("title", "publisher_domain", "source_system")),
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
        )
    )


def sighting_times(sightings: DataFrame) -> DataFrame:
    """First and last time each entry was seen."""
    return sightings.groupBy("entry_key").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"))


def earliest_payloads(payloads: DataFrame) -> DataFrame:
    """The earliest archived payload of each entry; ties go to the smaller record name."""
    rest = [c for c in payloads.columns if c != "entry_key"]
    first = F.min_by(F.struct(*rest), F.struct("observed_at", "raw_record_id"))
    return payloads.groupBy("entry_key").agg(first.alias("_p")).select("entry_key", "_p.*")


def rebuild_seen(payloads: DataFrame, sightings: DataFrame, reference: Column) -> DataFrame:
    """The seen index from the logs: per (entry, content) its first payload and latest sighting.

    ``reference`` builds the payload reference from a payload row.
    """
    first = payloads.groupBy("entry_key", "content_hash").agg(
        F.min("observed_at").alias("first_seen_at"), F.min_by(reference, F.struct("observed_at", "raw_record_id")).alias("payload_ref")
    )
    last = sightings.groupBy("entry_key", "content_hash").agg(F.max("observed_at").alias("_last"))
    joined = first.join(last, ["entry_key", "content_hash"], "left")
    return joined.select("entry_key", "content_hash", "first_seen_at", F.greatest("first_seen_at", "_last").alias("last_seen_at"), "payload_ref")


def flag_new(batch: DataFrame, seen: DataFrame, order: list[Column]) -> DataFrame:
    """``batch`` with ``is_new``: the first row of its (entry, content) in the batch, not in ``seen``."""
    keys = ["entry_key", "content_hash"]
    known = seen.select(*keys).distinct().withColumn("_known", F.lit(True))
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = batch.withColumn("_at", F.row_number().over(w)).join(known, keys, "left")
    return flagged.withColumn("is_new", (F.col("_at") == 1) & F.col("_known").isNull()).drop("_at", "_known")


def upsert_seen(seen: DataFrame, batch: DataFrame) -> DataFrame:
    """``seen`` after a batch of sightings: new pairs enter, known ones move their last sighting on."""
    same = batch.select("entry_key", "content_hash", F.col("observed_at").alias("first_seen_at"), F.col("observed_at").alias("last_seen_at"), "payload_ref")
    return (
        seen.unionByName(same)
        .groupBy("entry_key", "content_hash")
        .agg(
            F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.min_by("payload_ref", F.struct("first_seen_at", "payload_ref")).alias("payload_ref")
        )
    )


def entry_picks(entry: str = "payload") -> dict[str, Column]:
    """The fields of an entry as collectors read them: an empty text counts as missing."""
    c = lambda name: F.col(f"{entry}.{name}")
    return {
        "link": first_filled(c("link")),
        "title": first_filled(c("title")),
        "description": first_filled(c("summary"), c("description")),
        "published": first_filled(c("published"), c("pubdate"), c("updated")),
        "category": first_filled(c("category")),
    }


def candidates(payloads: DataFrame, sightings: DataFrame, reference: Column, branch: str, mode: str = "prospective") -> DataFrame:
    """One candidate row per entry: its earliest payload with the first and last sighting of the entry.

    An entry without sightings takes the payload's time.  Domestic rows keep the entry as JSON,
    international rows carry its fields.
    """
    if branch not in ("domestic", "international"):
        raise ValueError(f"unknown branch {branch!r}")
    first = earliest_payloads(payloads.withColumn("raw_payload_ref", reference))
    timed = first.join(sighting_times(sightings), "entry_key", "left")
    when = {c: F.coalesce(c, "observed_at").alias(c) for c in ("first_seen_at", "last_seen_at")}
    common = [F.col("source_system"), *when.values(), F.lit(mode).alias("collection_mode"), F.col("raw_payload_ref")]
    picks = entry_picks()
    if branch == "domestic":
        return timed.select(F.coalesce(picks["link"], F.lit("")).alias("url"), "publisher_id_hint", F.col("source_locator").alias("feed_url"), *common, F.to_json("payload").alias("entry_json"))
    return timed.select(
        F.coalesce(picks["link"], F.lit("")).alias("url"), F.col("publisher_id_hint").alias("publisher_id"), *common, *(picks[c].alias(c) for c in ("title", "description", "category")),
        picks["published"].alias("published_raw"),
    )
