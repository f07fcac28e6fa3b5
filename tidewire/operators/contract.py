"""The data contract: schema, enumerations, times, identifiers, uniqueness; union into the master table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import exact_reference, fingerprint
from ..functions.text import filled
from ..functions.times import has_zero_offset
from ..schemas import ARTICLE_COLUMNS, AUDIT_COLUMNS, BRANCHES, COLLECTION_MODES, CONFIDENCES


class ContractError(ValueError):
    """A frame does not meet the contract; the message lists rule and number of rows."""


def check_columns(df: DataFrame, expected: list[str]) -> None:
    """Same columns in the same order, else an error that names the missing and the unexpected ones."""
    if df.columns != expected:
        missing = [c for c in expected if c not in df.columns]
        extra = [c for c in df.columns if c not in expected]
        raise ContractError(f"columns differ: missing {missing}, unexpected {extra}, order {df.columns}")


def row_rules(branch: str | None = None, relevant_only: bool = False, audited: bool = False) -> dict[str, Column]:
    """Rule name to "this row breaks it".  Identifiers of rejected audit rows may be missing."""
    outside = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    active = F.col("rejection_reason").isNull() if audited else F.lit(True)
    rules = {
        "branch": outside("branch", BRANCHES if branch is None else [branch]),
        "collection_mode": active & outside("collection_mode", COLLECTION_MODES),
        "timestamp_confidence": outside("timestamp_confidence", CONFIDENCES),
        "first_seen_at": active & ~has_zero_offset(F.col("first_seen_at")),
        "published_at": F.col("published_at").isNotNull() & ~has_zero_offset(F.col("published_at")),
        "article_id": active & ~filled(F.col("article_id")),
        "title": active & ~filled(F.col("title")),
        "canonical_url": active & ~filled(F.col("canonical_url")),
        "raw_payload_ref": active & ~exact_reference(F.col("raw_payload_ref")),
        "vietnam_relevance": F.col("vietnam_relevance").isNull(),
        "duplicate_family_id": F.col("duplicate_family_id").isNotNull(),
    }
    if relevant_only:
        rules["not_relevant"] = ~F.coalesce("vietnam_relevance", F.lit(False))
    return rules


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows) for every rule, from one pass over the rows."""
    sums = df.agg(*(F.count_if(breaks).alias(name) for name, breaks in rules.items()))
    return sums.select(F.explode(F.create_map(*(x for name in rules for x in (F.lit(name), F.col(name))))).alias("rule", "rows"))


def examples(df: DataFrame, column: str, breaks: Column, most: int = 5) -> DataFrame:
    """Up to ``most`` distinct offending values, for a report."""
    return df.filter(breaks).select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(most)


def require(df: DataFrame, rules: dict[str, Column], name: str = "frame") -> DataFrame:
    """``df`` itself, or a ContractError."""
    broken = {r["rule"]: r["rows"] for r in violations(df, rules).filter("rows > 0").collect()}  # one row per rule
    if broken:
        raise ContractError(f"{name}: {broken}")
    return df


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, null keys, keys that stand twice or more, rows beyond the first of a key."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    held = F.col(key).isNotNull()
    return per.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~held, F.col("n"))), F.lit(0)).alias("null_keys"), F.count_if(held & (F.col("n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(held & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("rows_beyond_first"),
    )


def build_master(domestic: DataFrame, international: DataFrame, audits: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(master, audit): the branches' validated rows under each other, validated again."""
    for df, branch in ((domestic, "domestic"), (international, "international")):
        check_columns(df, ARTICLE_COLUMNS)
        require(df, row_rules(branch, relevant_only=True), branch)
    master = require(domestic.unionByName(international), row_rules(relevant_only=True), "master")
    audit = None
    if audits is not None:
        for df, branch in zip(audits, BRANCHES):
            check_columns(df, AUDIT_COLUMNS)
            require(df, row_rules(branch, audited=True), f"{branch} audit")
        audit = require(audits[0].unionByName(audits[1]), row_rules(audited=True), "audit")
    return master, audit


def output_problems(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule, rows) for a clustered output: every input row unchanged, an event for each, families whole."""
    same = [c for c in before.columns if c != "event_cluster_id"]
    lost = before.select(same).exceptAll(after.select(same)).agg(F.count("*").alias("rows")).select(F.lit("rows_lost").alias("rule"), "rows")
    added = after.select(same).exceptAll(before.select(same)).agg(F.count("*").alias("rows")).select(F.lit("rows_added").alias("rule"), "rows")
    none = after.agg(F.count_if(F.col("event_cluster_id").isNull()).alias("rows")).select(F.lit("no_event").alias("rule"), "rows")
    per = after.filter("duplicate_family_id is not null").groupBy("duplicate_family_id").agg(F.count_distinct("event_cluster_id").alias("n"))
    split = per.agg(F.count_if(F.col("n") > 1).alias("rows")).select(F.lit("family_split").alias("rule"), "rows")
    return lost.unionByName(added).unionByName(none).unionByName(split)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free fingerprint of their content."""
    return df.agg(F.count("*").alias("rows"), fingerprint(df.columns).alias("fingerprint"))
