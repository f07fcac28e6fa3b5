"""Problem 9: mixing sources to target weights by weighted fair queueing.

Every document copy gets a virtual finish time: the size its source has served up to and with
it, divided by the source's weight.  All copies are range-sorted by that time (ranges from sampled quantiles)
and cut where the running size reaches the budget.  A source whose last copy finishes before the virtual
time that equals the total has run out: it cannot reach its share.  Running sums go over hash buckets
first, so a source with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cooccur import plain_host
from .scratch import Scratch


def token_size(text: Column | str) -> Column:
    """Tokens of a byte-level tokenizer with one token per byte; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def wanted_sources(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats): sources as plain hosts; several target rows of one source are
    added up, with the largest ``max_repeats``; null shares and repeats count as 0."""
    rows = targets.select(plain_host("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("r"))
    return rows.filter("source is not null").groupBy("source").agg(F.sum("s").alias("target_share"), F.max("r").alias("max_repeats"))


def served_copies(documents: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """Every copy that may be used: doc_id, source, size, target_share, copy_no, ``at`` (its shuffled place) and
    ``served``, what its source has served up to and with it.  Copy k of every document of a source comes before
    copy k + 1 of any."""
    copies = (
        documents.select("doc_id", plain_host("source").alias("source"), token_size("text").alias("size"))
        .join(wanted.filter("target_share > 0 and max_repeats > 0"), "source")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), "max_repeats")))
        .withColumn("at", F.md5(F.concat_ws("|", "doc_id", F.lit(str(seed)), "copy_no")))
        .withColumn("bucket", F.substring("at", 1, 2))
    )
    sums = copies.groupBy("source", "copy_no", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("copy_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "copy_no", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "copy_no", "bucket").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return copies.join(offsets, ["source", "copy_no", "bucket"]).select(
        "doc_id", "source", "size", "target_share", "copy_no", "at", (F.col("base") + F.sum("size").over(inside)).alias("served")
    )


def last_time(sources: DataFrame, budget: Column) -> DataFrame:
    """One row ``until``: a virtual time after which the budget is surely used up; null if it never is.

    Up to the time v a source serves at least ``min(last, share v)`` less its longest text; that sum over sources is the least of
    the straight lines in which the first k sources to run out are used up, so it reaches the budget where all of them do.
    """
    order = Window.orderBy(F.col("last") / F.col("target_share"), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    gone = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    lines = sources.filter("target_share > 0 and last > 0").select(  # a row per target
        budget.alias("budget"), (budget + F.sum("longest").over(every) - gone("last")).alias("need"), (F.sum("target_share").over(every) - gone("target_share")).alias("rate"), F.sum("last").over(every).alias("all"), F.sum("longest").over(every).alias("slack")
    )
    return lines.agg(F.when(F.max("all") >= F.max("budget") + F.max("slack"), F.max(F.col("need") / F.col("rate"))).alias("until"))


def mix_to_targets(documents: DataFrame, targets: DataFrame, seed: int = 0, budget: int | None = None, hold_shares: bool = False) -> tuple[DataFrame, DataFrame, Scratch]:
    """(the mix: ``doc_id``, ``source``, ``copy_no``, ``size``, ``finish``, in no row order; a row per listed source
    with ``target_share``, ``max_repeats``, ``documents``, ``available``, ``total``, ``used``, ``copies``, ``actual_share`` and
    ``reachable``; scratch).

    ``budget`` defaults to the size of all documents of listed sources; with ``hold_shares`` it is at most the
    virtual time at which the first source runs out, so that every source has its share.  A document is used at most
    ``max_repeats`` times.  Documents of unlisted or null sources, and sources without weight, are not used.  A source that
    runs out leaves its room to the others.  The copy that would cross the budget is left out with all after it.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    wanted = scratch.table(wanted_sources(targets))
    served = scratch.table(served_copies(documents, wanted, seed).withColumn("finish", F.col("served") / F.col("target_share")))
    sizes = documents.select(plain_host("source").alias("source"), token_size("text").alias("size")).groupBy("source").agg(F.sum("size").alias("available"), F.count("*").alias("documents"))
    ends = served.groupBy("source").agg(F.max("served").alias("last"), F.max("size").alias("longest"))
    sources = wanted.join(sizes, "source", "left").join(ends, "source", "left").fillna(0, ["available", "documents", "last", "longest"])
    sources = scratch.table(sources.withColumn("total", F.sum("available").over(Window.partitionBy())))  # a row per target
    full = F.max("total") if budget is None else F.lit(int(budget))
    held = F.min(F.when(F.col("target_share") > 0, F.col("last") / F.col("target_share")))
    cut = scratch.table(sources.agg((F.least(full, F.floor(held)) if hold_shares else full).cast("long").alias("limit")))
    until = last_time(sources.crossJoin(F.broadcast(cut)), F.col("limit"))  # one row
    needed = served.crossJoin(F.broadcast(until)).filter(F.col("until").isNull() | (F.col("finish") <= F.col("until"))).drop("until")

    order = ["finish", "source", "at", "copy_no", "doc_id"]
    slices = scratch.table(needed.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    bases = slices.groupBy("slice").agg(F.sum("size").alias("s"))
    bases = bases.select("slice", F.coalesce(F.sum("s").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    along = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mix = (
        slices.join(bases, "slice")
        .withColumn("running", F.col("base") + F.sum("size").over(along))
        .crossJoin(F.broadcast(cut))  # one row
        .filter(F.col("running") <= F.col("limit"))
        .select("doc_id", "source", "copy_no", "size", "finish")
    )
    mix = scratch.table(mix)
    scratch.drop(served, slices)
    used = mix.groupBy("source").agg(F.sum("size").alias("used"), F.count("*").alias("copies"))
    shares = (
        sources.join(used, "source", "left")
        .fillna(0, ["used", "copies"])
        .withColumn("actual_share", F.col("used") / F.nullif(F.sum("used").over(Window.partitionBy()), F.lit(0)))
        .withColumn("reachable", F.col("last") >= F.col("target_share") * F.col("total"))
        .drop("last", "longest")
    )
    return mix, shares, scratch
