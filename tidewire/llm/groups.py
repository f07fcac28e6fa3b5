"""Problem 3: one group identifier over chains of pairwise matches.

Minimum labels are propagated across the edges and pointer jumping shortens the chains of labels;
each round is written to the shared folder, and rounds go on until no label changes.  After a round
the edges are rewritten to the labels of their ends and repeated ones fall together, so a node with
a third of all edges costs that much once, with the minimum taken before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_ROUNDS = 200


def connected_groups(edges: DataFrame, left: str, right: str) -> tuple[DataFrame, Scratch]:
    """(``node``, ``group``) for every node with an edge to another node; group = smallest node.

    Edges with a null end and loops are ignored; repeated and reversed edges count once; an empty
    edge table gives an empty result.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "groups")
    ends = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).filter("x is not null and y is not null and x <> y")
    rest = scratch.table(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    labels: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        if rest.isEmpty():
            break
        both = rest.union(rest.select("y", "x"))
        step = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("to"))
        jumps = []
        for _ in range(2):  # pointer jumping: each jump doubles the distance a label travels
            step = scratch.table(step)
            jumps.append(step)
            far = step.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            step = step.join(far, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))
        step = scratch.table(step)
        scratch.drop(*jumps)
        old_rest, old_labels = rest, labels
        to_x, to_y = step.select(F.col("node").alias("x"), F.col("to").alias("lx")), step.select(F.col("node").alias("y"), F.col("to").alias("ly"))
        moved = rest.join(to_x, "x").join(to_y, "y").filter("lx <> ly")
        rest = scratch.table(moved.select(F.least("lx", "ly").alias("x"), F.greatest("lx", "ly").alias("y")).distinct())
        if labels is None:
            labels = step
        else:
            follow = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            labels = scratch.table(labels.join(follow, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
            scratch.drop(old_labels)
        scratch.drop(old_rest)
    else:
        raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")
    if labels is None:
        labels = spark.createDataFrame([], "node string, to string")
    return labels.select("node", F.col("to").alias("group")), scratch


def _listed(ids: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(ids, ";"), lambda x: F.trim(x)), lambda x: x != ""))


def label_is(column: Column, wanted: str) -> Column:
    """Whether a hand-typed label is ``wanted``, whatever its case, blanks and underscores."""
    plain = F.regexp_replace(F.upper(column), r"^[\s\h_-]+|[\s\h_-]+$", "")
    return F.regexp_replace(plain, r"[\s\h_-]+", "_") == wanted


def article_links(families: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (x, y): each article of a family row with the row's first, and pairs labelled SAME_EVENT."""
    listed = families.select(_listed(F.col("article_ids")).alias("ids")).filter(F.size("ids") > 1)
    stars = listed.select(F.col("ids")[0].alias("x"), F.explode(F.slice("ids", 2, F.size("ids") - 1)).alias("y"))
    side = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    judged = labels.filter(label_is(F.col("manual_label"), "SAME_EVENT")).select(side("left_article_id").alias("x"), side("right_article_id").alias("y"))
    return stars.union(judged)
