"""Descriptive tables: event sizes, publishers, co-reporting graph, label pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unescaped
from .cluster import event_rows

# The label columns of the pivots, in order.
LABELS = ["SAME_EVENT", "DIFFERENT_EVENT", "UNCERTAIN"]


def event_frame(articles: DataFrame) -> DataFrame:
    """Per event: size, publishers, first and last time, span in days, first five titles."""
    order = F.struct(F.col("event_time").isNull().alias("u"), F.col("event_time").alias("t"), F.col("article_id").alias("i"), F.coalesce("title", F.lit("")).alias("x"))
    rows = event_rows(articles).groupBy("event_cluster_id").agg(
        F.count("*").alias("cluster_size"), F.count_distinct("publisher_domain").alias("n_publishers"), F.min("event_time").alias("first_published_at"),
        F.max("event_time").alias("last_published_at"), F.array_join(F.array_sort(F.collect_set("publisher_domain")), "; ").alias("publishers"),
        F.slice(F.array_sort(F.collect_list(order)), 1, 5).alias("_m"),
    )
    span = (F.unix_micros("last_published_at") - F.unix_micros("first_published_at")) / 86_400_000_000.0
    titles = unescaped(F.array_join(F.transform("_m", lambda s: s["x"]), " | "))
    return rows.withColumn("sample_titles", titles).withColumn("span_days", span).drop("_m")


def size_table(events: DataFrame) -> DataFrame:
    """Events by size with their share of all events."""
    counts = events.groupBy(F.col("cluster_size").alias("event_size_articles")).agg(F.count("*").alias("n_events"))
    total = F.sum("n_events").over(Window.partitionBy())
    return counts.select(
        "event_size_articles", "n_events", F.round(F.col("n_events") / total, 4).alias("share_of_events"), (F.col("event_size_articles") * F.col("n_events")).alias("n_articles"),
        F.when(F.col("event_size_articles") == 1, "singleton").otherwise("multi-article").alias("event_type"),
    )


def publisher_table(articles: DataFrame) -> DataFrame:
    """Per publisher: articles, share, events of all, several and cross-publisher kind, ratios, rank."""
    rows = event_rows(articles).filter("publisher_domain is not null")
    kinds = rows.groupBy("event_cluster_id").agg((F.count("*") >= 2).alias("multi"), (F.count_distinct("publisher_domain") >= 2).alias("cross"))
    per = rows.join(kinds, "event_cluster_id").groupBy("publisher_domain").agg(
        F.count("*").alias("n_articles"), F.count_distinct("event_cluster_id").alias("n_distinct_events"),
        F.count_distinct(F.when(F.col("multi"), F.col("event_cluster_id"))).alias("n_multi_article_events"),
        F.count_distinct(F.when(F.col("cross"), F.col("event_cluster_id"))).alias("n_cross_publisher_events"), F.count_if("cross").alias("articles_in_cross_publisher_events"),
    )
    # one row per publisher from here on
    rank = F.row_number().over(Window.orderBy(F.desc("n_articles"), "publisher_domain"))
    return per.select(
        rank.alias("rank_by_articles"), *per.columns, F.round(F.col("n_articles") / F.sum("n_articles").over(Window.partitionBy()), 4).alias("share_of_articles"),
        F.round(F.col("articles_in_cross_publisher_events") / F.col("n_articles"), 4).alias("share_articles_in_cross_publisher_events"),
        F.round(F.col("n_articles") / F.col("n_distinct_events"), 3).alias("articles_per_event"),
    )


def concentration(articles: DataFrame, by: str = "publisher_domain") -> DataFrame:
    """Herfindahl index over the non-null values of ``by``, the largest value and its share."""
    n = articles.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return share.agg(
        F.count("*").alias("publishers"), F.round(F.sum(F.col("share") * F.col("share")), 6).alias("hhi"), F.max_by(by, F.struct("n", by)).alias("dominant"), F.round(F.max("share"), 6).alias("dominant_share")
    )


def cross_publisher_events(events: DataFrame) -> DataFrame:
    """Events of two or more publishers, with the time of the first report as text."""
    first = F.date_format("first_published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_published_at")
    return events.filter("n_publishers >= 2").select("event_cluster_id", first, "cluster_size", "n_publishers", "publishers", "sample_titles", F.round("span_days", 2).alias("span_days"))


def co_report_edges(articles: DataFrame) -> DataFrame:
    """Publisher pairs that reported the same event, and in how many of these independently.

    Independent: some unit of one differs from some unit of the other, that is, they do not both hold
    the same single unit.  Units are reduced per publisher and event before pairs are made.
    """
    rows = event_rows(articles).filter("publisher_domain is not null")
    held = rows.groupBy("event_cluster_id", "publisher_domain").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    per = rows.groupBy("publisher_domain").agg(F.count_distinct("event_cluster_id").alias("events"))
    a, b = held.alias("a"), held.alias("b")
    met = a.join(b, F.expr("a.event_cluster_id = b.event_cluster_id and a.publisher_domain < b.publisher_domain"))
    apart = F.expr("not (a.lo = a.hi and b.lo = b.hi and a.lo = b.lo)")
    edges = met.groupBy(F.col("a.publisher_domain").alias("publisher_a"), F.col("b.publisher_domain").alias("publisher_b")).agg(
        F.count("*").alias("weight_all"), F.count_if(apart).alias("weight_independent")
    )
    edges = edges.join(per.select(F.col("publisher_domain").alias("publisher_a"), F.col("events").alias("events_a")), "publisher_a")
    edges = edges.join(per.select(F.col("publisher_domain").alias("publisher_b"), F.col("events").alias("events_b")), "publisher_b")
    smaller = F.least("events_a", "events_b")
    return edges.select("publisher_a", "publisher_b", "weight_all", "weight_independent", "events_a", "events_b", F.round(F.col("weight_independent") / smaller, 4).alias("shared_over_smaller_publisher_events"))


def network_figures(edges: DataFrame) -> DataFrame:
    """Nodes, edges with weight, and the largest weight of the co-report graph."""
    nodes = edges.select(F.explode(F.array("publisher_a", "publisher_b")).alias("n")).agg(F.count_distinct("n").alias("nodes"))
    return nodes.crossJoin(edges.agg(F.count_if(F.col("weight_independent") > 0).alias("edges"), F.max("weight_independent").alias("max_weight")))


def pivot_labels(labels: DataFrame, by: str) -> DataFrame:
    """Rows of ``by`` and the counts of each label, zeros filled, with the row total of these labels."""
    wide = labels.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("row")).pivot("manual_label", LABELS).count().fillna(0, LABELS)
    return wide.withColumn("total", sum((F.col(c) for c in LABELS), F.lit(0)))


def stacked_pivots(labels: DataFrame, by: list[str]) -> DataFrame:
    """The pivots of several columns under each other, told apart by ``table``."""
    rows = None
    for c in by:
        one = pivot_labels(labels, c).withColumn("table", F.lit(c))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def joined_once(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails unless ``key`` is unique on both sides."""
    for side, name in ((left, "left"), (right, "right")):
        if not side.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{key} is not unique on the {name} side")
    return left.join(right, key, "left")


def uncovered(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
