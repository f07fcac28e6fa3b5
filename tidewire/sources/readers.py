"""Readers: tables, logs of JSON lines, sheets, state files.  Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import archive_label
from ..schemas import FEED_STATE, PAYLOAD, SIGHTING


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one with the schema where nothing is there."""
    return table(spark, path, schema) if _matches(spark, path) else spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of plain or gzipped JSON lines; blank and broken lines are skipped, no file gives no row."""
    if not _matches(spark, pattern):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern)


def broken_lines(spark: SparkSession, pattern: str, schema: str) -> int:
    """How many lines ``json_lines`` skips."""
    if not _matches(spark, pattern):
        return 0
    bad = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(pattern).cache()
    try:
        return bad.filter("_bad is not null").count()
    finally:
        bad.unpersist()


def _log(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    """The day files of one kind below ``<root>/<branch>/<host>/``, with branch, host and day of the file."""
    rows = json_lines(spark, f"{root.rstrip('/')}/*/*/{kind}-*.jsonl*", schema)
    if "_metadata" not in dir(rows) and not rows.inputFiles():
        return rows.selectExpr("*", "cast(null as string) as archive", "cast(null as string) as file_branch", "cast(null as string) as file_host", "cast(null as string) as day")
    path = F.col("_metadata.file_path")
    part = lambda k: F.element_at(F.split(path, "/"), F.lit(-k))
    return rows.select(
        "*", archive_label(path).alias("archive"), part(3).alias("file_branch"), part(2).alias("file_host"), F.regexp_extract(part(1), r"-(\d{4}-\d{2}-\d{2})\.", 1).alias("day")
    )


def payload_log(spark: SparkSession, root: str) -> DataFrame:
    return _log(spark, root, "payloads", PAYLOAD)


def sighting_log(spark: SparkSession, root: str) -> DataFrame:
    return _log(spark, root, "sightings", SIGHTING)


def collector_hosts(log: DataFrame) -> DataFrame:
    """Branches and hosts that have ever written to a log, sorted."""
    return log.select("file_branch", "file_host").distinct().orderBy("file_branch", "file_host")


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with header, quoted line breaks and an optional byte-order mark; nulls are empty text."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    first = rows.columns[0]
    return rows.withColumnRenamed(first, first.lstrip("\ufeff")).fillna("")


def feed_state(spark: SparkSession, path: str) -> DataFrame:
    """One row with the nested state map; a missing or broken file is an empty state."""
    none = F.from_json(F.lit("{}"), FEED_STATE)
    if not _matches(spark, path):
        return spark.range(1).select(none.alias("state"))
    return spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", FEED_STATE), none).alias("state"))


def news_index(spark: SparkSession, pattern: str) -> DataFrame:
    """Articles of saved news-index responses (``{"articles": [...]}``); broken responses give none."""
    schema = "articles array<struct<url: string, title: string, seendate: string, domain: string, language: string, sourcecountry: string>>"
    if not _matches(spark, pattern):
        return spark.createDataFrame([], "url string, title string, seendate string, domain string, language string, sourcecountry string")
    parsed = spark.read.text(pattern, wholetext=True).select(F.from_json("value", schema).alias("j"))
    return parsed.select(F.explode("j.articles").alias("a")).select("a.*").filter("trim(url) <> ''").groupBy("url").agg(F.min(F.struct("seendate", "title", "domain", "language", "sourcecountry")).alias("a")).select("url", "a.title", "a.seendate", "a.domain", "a.language", "a.sourcecountry")
