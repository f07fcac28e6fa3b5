"""The pN_ queries: each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import consensus, cooccur, groups, history_dedup, langid, markov, mixing, near_copies, packing, textforms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CLOSE = 0.92


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def p1_found(spark, d):
    return textforms.lookalike_pairs(read(spark, d, "articles_master"))[0]


@query
def p1_forms(spark, d):
    """Every title and description in its one form."""
    fields = ("title", "description")
    return textforms.canonical_fields(read(spark, d, "articles_master").select("article_id", *fields), fields)


@query
def p2_found(spark, d):
    found, _ = history_dedup.repeated_records(read(spark, d, "payloads"), read(spark, d, "incoming_records"))
    return found.select("item_no")


@query
def p2_decisions(spark, d):
    """One row per incoming record: new, a repetition with small changes, or a copy."""
    incoming = read(spark, d, "incoming_records")
    found, _ = history_dedup.repeated_records(read(spark, d, "payloads"), incoming)
    items = incoming.select("item_no").filter("item_no is not null").distinct()
    return items.join(found, "item_no", "left").select("item_no", F.coalesce("decision", F.lit("new")).alias("decision"))


def _groups(spark, d):
    links = groups.article_links(read(spark, d, "dedup_family_summary_independent"), read(spark, d, "table5_qc_manual_labels"))
    return groups.connected_groups(links, "x", "y")[0].select(F.col("node").alias("article_id"), F.col("group").alias("group_id"))


@query
def p3_found(spark, d):
    return _groups(spark, d)


@query
def p3_group_sizes(spark, d):
    return _groups(spark, d).groupBy("group_id").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("groups"))


def _described(spark, d):
    articles = read(spark, d, "articles_master").filter("description is not null")
    return near_copies.near_copies(articles, "article_id", ["title", "description"])


@query
def p4_found(spark, d):
    pairs, members, _ = _described(spark, d)
    return near_copies.near_copy_articles(pairs, members)


@query
def p4_groups(spark, d):
    """Each article with a near copy, with the smallest article id of its group and its class of copies."""
    pairs, members, _ = _described(spark, d)
    links = pairs.select(F.col("left_class").alias("x"), F.col("right_class").alias("y")).union(members.select("class_id", "record_id"))
    found, _ = groups.connected_groups(links, "x", "y")
    return found.select(F.col("node").alias("article_id"), F.col("group").alias("group_id"))


def _clusters(spark, d):
    return markov.similarity_clusters(read(spark, d, "article_vectors"))


@query
def p5_found(spark, d):
    """Clusters of mutually similar articles; the graph's threshold is that of the cluster."""
    return _clusters(spark, d)[0].select("article_id", "first_article_id")


@query
def p5_clusters(spark, d):
    return _clusters(spark, d)[1]


@query
def p5_close(spark, d):
    """Clusters of close retellings, at a cosine where the members of many clusters are not all joined: every row
    comes out of the flow."""
    return markov.similarity_clusters(read(spark, d, "article_vectors"), CLOSE)[0].select("article_id", "first_article_id")


def _publishers(spark, d):
    return cooccur.items_together(read(spark, d, "articles_clustered"), cooccur.plain_host("publisher_domain"), F.col("event_cluster_id"))[0]


@query
def p6_found(spark, d):
    met = _publishers(spark, d).filter("k >= 2 and 1000 * k >= n and k * n >= 4 * a * b")
    return met.select(F.col("item_a").alias("publisher_a"), F.col("item_b").alias("publisher_b"))


@query
def p6_pairs(spark, d):
    return _publishers(spark, d).select(
        F.col("item_a").alias("publisher_a"), F.col("item_b").alias("publisher_b"), "k", "a", "b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi")
    )


def _consensus(spark, d):
    features = ["item_type", "stratum_or_event", "context", "ai_note", "review_comment"]
    return consensus.fit_consensus(read(spark, d, "human_review_flagged_17"), features)


@query
def p7_found(spark, d):
    items, _, _ = _consensus(spark, d)
    return items.filter("plain <> ai_label").select("reference", "consensus_label")


@query
def p7_items(spark, d):
    items, _, _ = _consensus(spark, d)
    rounded = (F.round(c, 4).alias(c) for c in ("confidence", "agreement"))
    return items.select("reference", "consensus_label", *rounded, "n_labels", "ai_label")


@query
def p7_annotators(spark, d):
    return _consensus(spark, d)[1]


def _packed(spark, d):
    return packing.pack_documents(read(spark, d, "documents"), read(spark, d, "pack_sizes"))[0]


@query
def p8_found(spark, d):
    return _packed(spark, d).groupBy("pack_name", "doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("pack_name", "doc_id")


@query
def p8_report(spark, d):
    return packing.packing_report(_packed(spark, d))


@query
def p8_bounds(spark, d):
    """Fewest containers that any packing needs."""
    return packing.container_bounds(packing.pieces(read(spark, d, "documents"), read(spark, d, "pack_sizes")))


def _mix(spark, d):
    return mixing.mix_to_targets(read(spark, d, "documents"), read(spark, d, "mix_targets"))


@query
def p9_found(spark, d):
    _, shares, _ = _mix(spark, d)
    return shares.filter("not reachable").select("source")


def _shares(shares):
    return shares.select("source", "target_share", "max_repeats", "available", "used", "copies", F.round("actual_share", 6).alias("actual_share"), "reachable")


@query
def p9_shares(spark, d):
    return _shares(_mix(spark, d)[1])


@query
def p9_held_shares(spark, d):
    """The largest mix in which no source misses its share, over the sources that have documents."""
    targets, documents = read(spark, d, "mix_targets"), read(spark, d, "documents")
    held = documents.select(cooccur.plain_host("source").alias("h")).distinct()
    targets = targets.join(held, cooccur.plain_host("source") == F.col("h"), "left_semi")
    return _shares(mixing.mix_to_targets(documents, targets, hold_shares=True)[1])


def _segments(spark, d):
    documents = read(spark, d, "documents")
    return langid.language_segments(documents, langid.fit_from_tables(read(spark, d, "lang_samples"), documents))


@query
def p10_found(spark, d):
    return langid.relabelled(_segments(spark, d)).select("doc_id", "lang")


@query
def p10_segments(spark, d):
    return _segments(spark, d).select("doc_id", "segment_no", "start", "length", "lang", "confidence", "sentences")
