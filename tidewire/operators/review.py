"""Human review sheets: blind copies, checks, merging, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled

# Columns a blind sheet shows, and those a reviewer fills.
SHOWN = ["review_id", "item_type", "reference", "stratum_or_event", "context", "allowed_human_labels"]
FILLED = ["human_label", "reviewer", "review_comment"]


def blind_sheet(sheet: DataFrame) -> DataFrame:
    """The sheet without earlier labels, with empty columns for the reviewer."""
    return sheet.select(*SHOWN, *(F.lit("").alias(c) for c in FILLED))


def changed_cells(main: DataFrame, returned: DataFrame) -> DataFrame:
    """(review_id, column) where a returned sheet differs from the main one in a shown column.

    Null and empty are the same; a row on one side only differs in ``review_id``.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in SHOWN))).alias("c")
    a, b = (df.select("review_id", cells).select("review_id", "c.*").distinct() for df in (main, returned))
    return a.exceptAll(b).union(b.exceptAll(a)).select("review_id", "column").distinct()


def allowed(label: Column, list_text: Column) -> Column:
    """Whether a label stands in a `` / `` list, spelt exactly so."""
    return F.coalesce(F.array_contains(F.transform(F.split(list_text, "/"), lambda x: F.trim(x)), label), F.lit(False))


def label_problems(sheet: DataFrame) -> DataFrame:
    """(review_id, problem) of labels outside the allowed list and of empty reviewers."""
    found = F.array_compact(
        F.array(F.when(~allowed(F.col("human_label"), F.col("allowed_human_labels")), "label_not_allowed"), F.when(~filled(F.col("reviewer")), "reviewer_empty"))
    )
    return sheet.select("review_id", F.explode(found).alias("problem"))


def agreement_flags(sheet: DataFrame) -> DataFrame:
    """Each row with Y or N for exact agreement of the human with the first and the second pass."""
    same = lambda c: F.when(F.coalesce(F.col("human_label"), F.lit("")) == F.coalesce(F.col(c), F.lit("")), "Y").otherwise("N")
    return sheet.select("review_id", "reference", "ai_label", "second_pass_label", "human_label", same("ai_label").alias("first_pass_yn"), same("second_pass_label").alias("second_pass_yn"))


def agreement_counts(flags: DataFrame) -> DataFrame:
    yes = lambda c: F.count_if(F.col(c) == "Y")
    return flags.agg(F.count("*").alias("n"), yes("first_pass_yn").alias("first_pass"), yes("second_pass_yn").alias("second_pass"))


def disagreements(flags: DataFrame) -> DataFrame:
    return flags.filter("first_pass_yn = 'N' or second_pass_yn = 'N'")


def review_sample(audit: DataFrame, size: int, seed: str = "20260920") -> DataFrame:
    """Half relevant, half not, of the rows without a rejection, filled up from the rest; in the order of a
    seeded hash, so that it is the same in every run."""
    valid = audit.filter("rejection_reason is null")
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col("raw_payload_ref")), 256)
    ranked = valid.withColumn("_h", h).withColumn("_k", F.row_number().over(Window.partitionBy("vietnam_relevance").orderBy("_h", "raw_payload_ref")))
    return ranked.orderBy(F.col("_k") > max(1, size // 2), "_h", "raw_payload_ref").limit(size).drop("_h", "_k")


def head_sample(audit: DataFrame, size: int, order: list[str]) -> DataFrame:
    """As ``review_sample``, but the first rows in a stated order instead of a hash."""
    valid = audit.filter("rejection_reason is null")
    ranked = valid.withColumn("_k", F.row_number().over(Window.partitionBy("vietnam_relevance").orderBy(*order)))
    return ranked.orderBy(F.col("_k") > max(1, size // 2), *order).limit(size).drop("_k")
