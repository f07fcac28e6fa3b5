"""A clustering run: gates, families, events, output checks and the manifest of what was done."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster, contract, dedup
from .stage import Stage


@dataclass(frozen=True)
class Run:
    clustered: DataFrame  # the articles with family and event
    families: DataFrame
    events: DataFrame
    manifest: DataFrame


def clustering_run(articles: DataFrame, vectors: DataFrame, threshold: float = 0.30, window_days: float = 5.0, linkage: str = "complete", expected: str | None = None) -> Run:
    """Families and events of ``articles`` (X1 columns, without families), or a ContractError at the first gate that fails.

    Gates: columns and row rules of the input and, where ``expected`` is given, its fingerprint; after the run, every input row
    unchanged, an event for each, families whole.  The manifest has the fingerprint of the input, the setting and the run figures.
    """
    stage = Stage(articles.sparkSession, "run")
    contract.check_columns(articles, contract.ARTICLE_COLUMNS)
    contract.require(articles, contract.row_rules(), "input")
    mark = stage.write(contract.content_fingerprint(articles))
    if expected is not None and mark.head()["fingerprint"] != expected:
        raise contract.ContractError(f"the input's fingerprint is not {expected}")
    feats = stage.write(dedup.features(articles))
    related = stage.write(dedup.related_pairs(feats))
    assignment, families = dedup.families(related)
    annotated = stage.write(dedup.annotate(articles, assignment))
    found = stage.write(cluster.units(annotated, vectors))
    clustered = stage.write(cluster.propagate(annotated, cluster.cluster(found, threshold, window_days, linkage)))
    problems = {r["rule"]: r["rows"] for r in contract.output_problems(annotated, clustered).filter("rows > 0").collect()}  # one row per rule
    if problems:
        raise contract.ContractError(f"output: {problems}")
    events = stage.write(cluster.summaries(clustered, vectors))
    manifest = mark.crossJoin(cluster.metrics(events)).crossJoin(found.agg(F.count("*").alias("units")))  # one row each
    setting = {"distance_threshold": threshold, "window_days": window_days, "linkage": linkage}
    return Run(clustered, families, events, manifest.select("*", *(F.lit(v).alias(k) for k, v in setting.items())))
