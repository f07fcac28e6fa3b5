"""Duplicate and syndication families by word-pair blocking.

The blocking is the stated method: pairs sharing at least ``min_shared`` word pairs that occur in no
more than ``most_articles`` articles.  It is lossy on purpose; nothing else is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import family_id
from ..functions.times import hours_apart, instant
from ..functions.urls import matching_key
from .components import components
from .stage import Stage, numbered, spread


# Decision constants.
@dataclass(frozen=True)
class Rules:
    copy_overlap: float = 0.60
    least_words: int = 6
    most_hours: float = 168.0
    number_conflict: float = 0.5
    event_title: float = 0.50
    event_description: float = 0.40
    min_shared: int = 2
    most_articles: int = 60
    large_family: int = 4
    low_density: float = 0.5


RULES = Rules()
#: Word pairs of too many articles whose rows are dropped before the shuffle (the rest of them after it), and bytes of a file's dictionary of word pairs.
HOTTEST, DICTIONARY = 50_000, 8 << 20
EXACT, COPY, SAME_EVENT, UNRELATED = "EXACT_DUPLICATE", "SYNDICATED_COPY", "SAME_EVENT_INDEPENDENT", "UNRELATED"
REASONS = {
    "url": "identical_normalized_canonical_url",
    "text": "identical_normalized_title_and_description",
    "language": "language_mismatch (cross-language matching is out of scope)",
    "week": "copy_evidence_vetoed: published more than a week apart",
    "numbers": "copy_evidence_vetoed: numeric details conflict",
    "headline": "headline_overlap_but_description_missing_or_short: copy cannot be confirmed",
    "lede": "headline_or_lede_overlap_without_copy_level_description_match",
    "below": "below_all_similarity_thresholds",
}


def features(articles: DataFrame, hashed: bool = True) -> DataFrame:
    """Per article what pair scoring reads: normalized texts, word pairs (as 64-bit hashes unless they are to be
    read), numbers, time, language."""
    title, description = T.normalized(F.col("title")), T.normalized(F.col("description"))
    base = articles.select("article_id", "language", matching_key(F.col("canonical_url")).alias("url_key"), title.alias("t"), description.alias("d"), instant(F.col("published_at")).alias("time"))
    words = base.withColumn("tw", T.tokens(F.col("t"))).withColumn("dw", T.tokens(F.col("d")))
    pairs = lambda c: F.transform(T.word_pairs(F.col(c)), lambda p: F.xxhash64(p)) if hashed else T.word_pairs(F.col(c))
    return words.select(
        "article_id", "language", "url_key", "t", "d", "time", pairs("tw").alias("tp"), pairs("dw").alias("dp"),
        F.size("dw").alias("n_words"), T.digit_tokens(F.col("t"), F.col("d")).alias("numbers"),
    )


def pair_frequencies(feats: DataFrame) -> DataFrame:
    """Number of articles with each word pair, in title or description."""
    return feats.select("article_id", F.explode(F.array_union("tp", "dp")).alias("pair")).groupBy("pair").agg(F.count("*").alias("articles"))


def blocked_pairs(feats: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Candidate pairs (a < b) with the number of shared word pairs.

    The features are computed once and articles go by the number of their row.  The rows of the most frequent word pairs are most of
    all and stay where they are; of the others, each article gets the articles after it in the lists of its word pairs, and counts them.
    """
    stage = Stage(feats.sparkSession, "blocking")
    rows = feats.select("article_id", F.array_union("tp", "dp").alias("pairs")).withColumn("n", F.monotonically_increasing_id())
    rows = stage.write(rows, **{"parquet.dictionary.page.size": DICTIONARY})  # once written, the numbers stay
    counts = stage.write(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("articles")).filter("articles > 1"))
    hottest = counts.filter(F.col("articles") > rules.most_articles).orderBy(F.desc("articles"), "pair").limit(HOTTEST).select("pair")
    useful = counts.filter(F.col("articles") <= rules.most_articles).select("pair")
    held = rows.filter("article_id is not null").select("n", F.explode("pairs").alias("pair")).join(F.broadcast(hottest), "pair", "left_anti").join(useful, "pair")
    repeated = rows.groupBy("article_id").agg(F.min("n").alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    if not repeated.isEmpty():  # rows of one id count as one article
        same = rows.select("article_id", "n").join(repeated, "article_id").select("n", "first")
        held = held.join(same, "n", "left").select(F.coalesce("first", "n").alias("n"), "pair")
    lists = held.groupBy("pair").agg(F.array_sort(F.collect_list("n")).alias("ns"))  # of at most most_articles
    after = lists.select("ns", F.posexplode("ns").alias("i", "a")).filter(F.col("i") < F.size("ns") - 1)
    after = spread(after.select("a", F.slice("ns", F.col("i") + 2, F.size("ns")).alias("bs")), "a")  # few bytes, many meetings
    shared = after.select("a", F.explode("bs").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= rules.min_shared)
    named = lambda s: rows.select(F.col("n").alias(s), F.col("article_id").alias(f"{s}_id"))
    return shared.join(named("a"), "a").join(named("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "shared")


def groups_alike(feats: DataFrame, key: Column, reason: str) -> DataFrame:
    """Pairs (a < b) of articles with the same non-null key."""
    keyed = feats.select("article_id", key.alias("key")).filter("key is not null")
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    own = keyed.join(several, "key")
    a, b = own.alias("a"), own.alias("b")
    return a.join(b, F.expr("a.key = b.key and a.article_id < b.article_id")).select(
        F.col("a.article_id").alias("a"), F.col("b.article_id").alias("b"), F.lit(reason).alias("exact_reason")
    )


def exact_pairs(feats: DataFrame) -> DataFrame:
    """Exact duplicates with their reason: same address key first, else same title and description."""
    by_url = groups_alike(feats, F.nullif(F.col("url_key"), F.lit("")), REASONS["url"]).withColumn("rank", F.lit(1))
    both = F.when((F.col("t") != "") & (F.col("d") != ""), F.sha2(F.concat_ws("\n", "t", "d"), 256))
    by_text = groups_alike(feats, both, REASONS["text"]).withColumn("rank", F.lit(2))
    return by_url.unionByName(by_text).groupBy("a", "b").agg(F.min_by("exact_reason", "rank").alias("exact_reason"))


def scored(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """Pairs with both sides' overlaps, number overlap (null if a side has none) and hours apart."""
    side = lambda s: feats.select(F.col("article_id").alias(s), F.struct("language", "tp", "dp", "n_words", "numbers", "time").alias(f"f{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    numbers = F.when((F.size("fa.numbers") > 0) & (F.size("fb.numbers") > 0), T.jaccard(F.col("fa.numbers"), F.col("fb.numbers")))
    return both.select(
        *pairs.columns,
        T.jaccard(F.col("fa.tp"), F.col("fb.tp")).alias("title_sim"),
        T.jaccard(F.col("fa.dp"), F.col("fb.dp")).alias("desc_sim"),
        numbers.alias("number_sim"),
        hours_apart(F.col("fa.time"), F.col("fb.time")).alias("hours_apart"),
        F.least("fa.n_words", "fb.n_words").alias("words"),
        (F.col("fa.language") != F.col("fb.language")).alias("other_language"),
    )


def relation(rules: Rules = RULES) -> tuple[Column, Column]:
    """(relation, reason) of a scored pair that is no exact duplicate."""
    described = F.col("words") >= rules.least_words
    copy = described & (F.col("desc_sim") >= rules.copy_overlap)
    headline = F.col("title_sim") >= rules.event_title
    alike = headline | (F.col("desc_sim") >= rules.event_description)
    # (holds, relation, reason) in the order of precedence
    cases = (
        (F.coalesce("other_language", F.lit(False)), UNRELATED, REASONS["language"]),
        (copy & F.coalesce(F.col("hours_apart") > rules.most_hours, F.lit(False)), SAME_EVENT, REASONS["week"]),
        (copy & F.coalesce(F.col("number_sim") < rules.number_conflict, F.lit(False)), SAME_EVENT, REASONS["numbers"]),
        (copy, COPY, f"description_overlap>={rules.copy_overlap}"),
        (alike & ~described & headline, SAME_EVENT, REASONS["headline"]),
        (alike, SAME_EVENT, REASONS["lede"]),
    )
    name, why = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for holds, rel, reason in cases:
        name, why = name.when(holds, rel), why.when(holds, reason)
    return name.otherwise(UNRELATED), why.otherwise(REASONS["below"])


def related_pairs(feats: DataFrame, rules: Rules = RULES) -> DataFrame:
    """All exact and all candidate pairs with scores, relation and reason."""
    exact = exact_pairs(feats)
    candidates = blocked_pairs(feats, rules).select("a", "b").join(exact, ["a", "b"], "left_anti").withColumn("exact_reason", F.lit(None).cast("string"))
    rel, why = relation(rules)
    is_exact = F.col("exact_reason").isNotNull()
    return scored(exact.unionByName(candidates), feats).select(
        "a", "b", "title_sim", "desc_sim", "number_sim", "hours_apart", F.when(is_exact, EXACT).otherwise(rel).alias("relation"), F.coalesce("exact_reason", why).alias("reason")
    )


def accepted(related: DataFrame) -> DataFrame:
    return related.filter(F.col("relation").isin(EXACT, COPY))


def families(related: DataFrame, rules: Rules = RULES) -> tuple[DataFrame, DataFrame]:
    """(assignment: article_id, duplicate_family_id; families: id, type, size, density, flag, article_ids)."""
    edges = accepted(related)
    parts = components(edges)
    members = parts.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    links = edges.join(parts.select(F.col("id").alias("a"), "component"), "a").groupBy("component")
    links = links.agg(F.count("*").alias("edges"), F.bool_and(F.col("relation") == EXACT).alias("all_exact"))
    size = F.size("ids")
    density = F.col("edges") / (size * (size - 1) / 2)
    named = members.join(links, "component").select(
        "component", family_id(F.col("ids")).alias("duplicate_family_id"), F.when(F.col("all_exact"), EXACT).otherwise(COPY).alias("family_type"), size.alias("family_size"),
        density.alias("edge_density"), F.when((size >= rules.large_family) | (density < rules.low_density), "review_large_or_sparse").otherwise("").alias("flag"), F.array_join("ids", ";").alias("article_ids"),
    )
    assignment = parts.join(named.select("component", "duplicate_family_id"), "component").select(F.col("id").alias("article_id"), "duplicate_family_id")
    return assignment, named.drop("component")


def annotate(articles: DataFrame, assignment: DataFrame) -> DataFrame:
    """``articles`` with only ``duplicate_family_id`` filled; row count, columns and order kept."""
    columns = articles.columns
    return articles.drop("duplicate_family_id").join(assignment, "article_id", "left").select(columns)


def family_summary(articles: DataFrame, assignment: DataFrame, found: DataFrame) -> DataFrame:
    """Families with their publishers and titles, members in the order of their ids."""
    rows = articles.select("article_id", "publisher_id", "title").join(assignment, "article_id")
    lists = rows.groupBy("duplicate_family_id").agg(
        F.array_join(F.array_sort(F.collect_set("publisher_id")), ";").alias("publishers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_id", "title"))), lambda s: s["title"]), " || ").alias("titles"),
    )
    columns = ["duplicate_family_id", "family_type", "family_size", "publishers", "article_ids", "titles", "edge_density", "flag"]
    return found.join(lists, "duplicate_family_id").withColumn("edge_density", F.round("edge_density", 3)).select(columns)


def run_summary(articles: DataFrame, found: DataFrame) -> DataFrame:
    """One row: totals by family type, members, singletons and the largest family."""
    total = articles.agg(F.count("*").alias("articles"))
    sums = found.agg(
        F.count("*").alias("families"), F.coalesce(F.sum("family_size"), F.lit(0)).alias("members"), F.count_if(F.col("family_type") == EXACT).alias("exact"),
        F.count_if(F.col("family_type") == COPY).alias("syndicated"), F.max("family_size").alias("largest_size"),
        F.max_by("duplicate_family_id", F.struct("family_size", "duplicate_family_id")).alias("largest_family"),
    )
    return total.crossJoin(sums).withColumn("singletons", F.col("articles") - F.col("members"))


def hash_controls(articles: DataFrame, pairs: int = 12) -> DataFrame:
    """Neighbouring pairs of the articles in the order of their ids' SHA-256: the unrelated controls."""
    first = articles.select("article_id", F.sha2("article_id", 256).alias("h")).orderBy("h").limit(2 * pairs)
    ranked = first.withColumn("k", F.row_number().over(Window.orderBy("h")) - 1)
    lot = ranked.groupBy(F.floor(F.col("k") / 2).alias("lot")).agg(F.min("article_id").alias("a"), F.max("article_id").alias("b"), F.count("*").alias("n"))
    return lot.filter("n = 2").select("lot", "a", "b")


def qc_buckets(feats: DataFrame, related: DataFrame, assignment: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs for manual checking, each in the first bucket that picks it, numbered ``qc_0001`` on.

    The limit of a bucket is taken before pairs of earlier buckets are skipped.
    """
    stage = Stage(feats.sparkSession, "qc")
    related = stage.write(related)
    keep = ["a", "b", "title_sim", "desc_sim", "number_sim", "hours_apart", "relation", "reason"]

    def top(rows: DataFrame, by: str, most: int) -> DataFrame:
        return rows.orderBy(F.desc(by), "a", "b").limit(most)

    rejected = related.filter(~F.col("relation").isin(EXACT, COPY))
    rel, why = relation()
    controls = scored(hash_controls(feats).select("a", "b"), feats).withColumn("relation", rel).withColumn("reason", why)
    flagged = assignment.join(found.filter("flag <> ''").select("duplicate_family_id"), "duplicate_family_id").select(F.col("article_id").alias("a"))
    buckets = [
        ("POSITIVE", accepted(related).select(keep)),
        ("REJECTED_BORDERLINE", top(rejected.filter((F.col("desc_sim") >= 0.45) & (F.col("desc_sim") < RULES.copy_overlap) | F.contains("reason", F.lit("vetoed"))), "desc_sim", 15)),
        ("PREDICTED_SAME_EVENT_INDEPENDENT", top(rejected.filter(F.col("relation") == SAME_EVENT), "desc_sim", 10)),
        ("RECALL_PROBE_HIGH_TITLE_LOW_DESC", top(rejected.filter("title_sim >= 0.6"), "title_sim", 15)),
        ("UNRELATED_CONTROL", controls),
        ("SUSPICIOUS_LARGE_FAMILY", accepted(related).join(flagged, "a", "left_semi")),
    ]
    all_rows = None
    for k, (name, rows) in enumerate(buckets):
        by = {1: "desc_sim", 2: "desc_sim", 3: "title_sim"}.get(k)
        rows = rows.select(keep).withColumn("bucket_no", F.lit(k)).withColumn("bucket", F.lit(name)).withColumn("_by", F.col(by) if by else F.lit(0.0))
        all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    first = all_rows.withColumn("_k", F.row_number().over(Window.partitionBy("a", "b").orderBy("bucket_no"))).filter("_k = 1")
    positive = F.when(F.col("bucket_no") == 0, F.concat(F.lit("POSITIVE_"), "relation")).otherwise(F.col("bucket"))
    side = lambda s: assignment.select(F.col("article_id").alias(s), F.col("duplicate_family_id").alias(f"_{s}"))
    return (
        numbered(first, [F.col("bucket_no"), F.desc("_by"), F.col("a"), F.col("b")], stage, "_n")
        .join(side("a"), "a", "left")
        .join(side("b"), "b", "left")
        .select(
            F.format_string("qc_%04d", "_n").alias("pair_id"), positive.alias("bucket"), F.col("a").alias("left_article_id"), F.col("b").alias("right_article_id"),
            F.round("title_sim", 3).alias("title_jaccard"), F.round("desc_sim", 3).alias("desc_jaccard"), F.round("number_sim", 3).alias("number_jaccard"),
            F.round("hours_apart", 1).alias("hours_apart"), F.col("relation").alias("predicted_relation"), F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("").alias("duplicate_family_id"),
            F.col("reason").alias("review_notes"),
        )
    )
