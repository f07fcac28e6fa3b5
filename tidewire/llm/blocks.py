"""Pairs of the rows that share a key, with hot keys split into block pairs of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows of a key beyond which it is spread over block pairs.
BLOCK = 4096


def meeting(listed: DataFrame, key: list[str], member: str, scratch: Scratch, most: int = BLOCK) -> tuple[DataFrame, DataFrame, list[str]]:
    """(left, right, columns to join on): every two rows of a key meet exactly once in each order.

    ``listed`` is a written table.  A key of more than ``most`` rows becomes a square of block pairs, each
    of which is one join key of its own, so no task ever gets all rows of a hot key.
    """
    sizes = listed.groupBy(*key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > most)
    hot = scratch.table(sizes.select(*key, F.ceil(F.col("_rows") / most).cast("int").alias("_blocks")))
    if hot.isEmpty():
        return listed, listed, key
    split = listed.join(hot, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    split = split.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = split.withColumn("_i", F.col("_own")).withColumn("_j", every).drop("_own", "_blocks")
    right = split.withColumn("_j", F.col("_own")).withColumn("_i", every).drop("_own", "_blocks")
    return left, right, [*key, "_i", "_j"]
