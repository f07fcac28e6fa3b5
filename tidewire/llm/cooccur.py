"""Problem 6: how often items meet in one basket, against chance.

Items are made distinct per basket.  Baskets with the same set of items are counted together before
any pair is made, so a pair is emitted once per distinct set with the number of its baskets.  A set is known by its
size and 128 bits over its items, so no basket is ever gathered into one row; the items of a large one
meet in block pairs, so no task makes all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, meeting
from .scratch import Scratch


def plain_host(column: Column | str) -> Column:
    """A host in lower case, without outer blanks and leading ``www.``; blank gives null."""
    host = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"^[\s\h]+|[\s\h]+$", ""))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def items_together(rows: DataFrame, item: Column, basket: Column) -> tuple[DataFrame, Scratch]:
    """Per pair of items (smaller first): ``k`` baskets with both, ``a`` and ``b`` baskets of each, ``n``
    baskets in all, ``lift`` = k n / (a b) and ``pmi`` = log2(lift); and the scratch tables behind them.

    Null baskets are no baskets; null items are in none; an item twice in a basket counts once.
    """
    scratch = Scratch(rows.sparkSession, "together")
    pairs = scratch.table(rows.select(item.alias("item"), basket.alias("basket")).filter("basket is not null").distinct())
    total = pairs.agg(F.count_distinct("basket").alias("n"))
    held = pairs.filter("item is not null")
    alone = held.groupBy("item").agg(F.count("*").alias("c"))
    # exclusive-or does not depend on the order of items and is combined before the shuffle
    sets = held.groupBy("basket").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(item))").alias("h1"), F.expr("bit_xor(xxhash64(item, 7))").alias("h2"))
    sets = sets.filter("size > 1").groupBy("size", "h1", "h2").agg(F.min("basket").alias("basket"), F.count("*").alias("w"))
    listed = scratch.table(held.join(sets.select("basket", "w"), "basket"))
    left, right, on = meeting(listed, ["basket"], "item", scratch, BLOCK)
    a, b = left.alias("a"), right.alias("b")
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]).filter("a.item < b.item")
    met = met.groupBy(F.col("a.item").alias("x"), F.col("b.item").alias("y")).agg(F.sum("a.w").alias("k"))
    found = (
        met.join(alone.select(F.col("item").alias("x"), F.col("c").alias("a")), "x")
        .join(alone.select(F.col("item").alias("y"), F.col("c").alias("b")), "y")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("lift", F.col("k") * F.col("n") / (F.col("a") * F.col("b")))
        .withColumn("pmi", F.log2("lift"))
        .select(F.col("x").alias("item_a"), F.col("y").alias("item_b"), "k", "a", "b", "n", "lift", "pmi")
    )
    return found, scratch
