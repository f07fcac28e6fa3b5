"""Connected components of an edge table by shrinking label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import Stage


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 100) -> DataFrame:
    """(``id``, ``component``): every id with an edge to another one, with the smallest id it reaches.

    Each round gives every id the smallest id next to it, follows that pointer once, and replaces
    the edges by those between the new labels; it ends when no edge is left.
    """
    stage = Stage(edges.sparkSession, "components")
    open_edges = edges.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).filter("a < b").distinct()
    open_edges = stage.write(open_edges)
    total: DataFrame | None = None
    for _ in range(rounds):
        if open_edges.isEmpty():
            break
        near = open_edges.union(open_edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        hop = stage.write(near.select(F.col("a").alias("id"), F.least("a", "b").alias("to")))
        further = hop.select(F.col("id").alias("to"), F.col("to").alias("then"))
        hop = stage.write(hop.join(further, "to", "left").select("id", F.coalesce("then", "to").alias("to")))
        total = hop if total is None else stage.write(_follow(total, hop))
        ends = open_edges.join(hop.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(hop.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        open_edges = stage.write(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"not settled after {rounds} rounds")
    if total is None:
        return open_edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return total.select("id", F.col("to").alias("component"))


def _follow(labels: DataFrame, hop: DataFrame) -> DataFrame:
    onward = hop.select(F.col("id").alias("to"), F.col("to").alias("then"))
    return labels.join(onward, "to", "left").select("id", F.coalesce("then", "to").alias("to"))
