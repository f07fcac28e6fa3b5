"""Written tables that cut long plans, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def folder_for(setting: str | None, master: str, application: str) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Where it is unset, a temporary one of this
    machine, if all executors run in this process; on a cluster that is an error."""
    if setting:
        return setting.rstrip("/")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that all executors share")
    if application not in _own:
        _own[application] = f"file://{tempfile.mkdtemp(prefix='tidewire-')}"
    return _own[application]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` divided by ``keys`` into all shuffle partitions, for work that costs far more than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, order: list[Column], stage: Stage, name: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1 on: places in sorted ranges, and a count of the ranges before."""
    ranges = stage.write(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(offsets, "_range").withColumn(name, F.col("_before") + place).drop("_range", "_before")


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    return folder_for(spark.conf.get("spark.checkpoint.dir", None), context.master, context.applicationId)


class Stage:
    """Parquet tables of one run below the shared folder.

    ``write`` gives a frame back with a fresh plan.  ``drop`` deletes tables that no later plan reads;
    whatever is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._tables = 0

    def write(self, df: DataFrame, partition_by: str | None = None, **options: str | int) -> DataFrame:
        self._tables += 1
        path = f"{self.root}/t{self._tables}"
        writer = df.write.mode("overwrite").options(**options)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        if self._tables == 1:
            files, root = self._files(self.root)
            files.deleteOnExit(root)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._stage_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(getattr(df, "_stage_path", ""))

    def clear(self) -> None:
        self._delete(self.root)

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        if path.startswith(self.root):
            files, p = self._files(path)
            files.delete(p, True)
