"""Writers: tables, logs, sheets, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A Parquet table in place of what was there."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).mode("overwrite").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """As ``write_table``, but readers see the old table until the new one is whole; ``df`` may read it."""
    spark, aside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{aside}.new")
    new, fs = _file_system(spark, f"{aside}.new")
    target, old = _file_system(spark, path)[0], _file_system(spark, f"{aside}.old")[0]
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)


def append_lines(df: DataFrame, path: str, compress: bool = False) -> None:
    """Rows as JSON lines beside those already there."""
    df.write.mode("append").option("compression", "gzip" if compress else "none").json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A CSV sheet with header, quotes doubled."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_manifest(df: DataFrame, path: str) -> str:
    """The first row of a one-row frame as a JSON file with sorted keys, replaced as a whole."""
    row = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).head()
    text = json.dumps(json.loads(row["j"]), sort_keys=True, indent=2, ensure_ascii=False)
    spark = df.sparkSession
    aside, fs = _file_system(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = _file_system(spark, path)[0]
    fs.delete(target, False)
    fs.rename(aside, target)
    return text
