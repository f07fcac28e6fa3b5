"""Continuous ingest: polled records to a payload log, a sighting log and the seen index.

Each micro-batch anti-joins the seen table on disk instead of keeping an ever-growing state store.
The checkpoint orders the writes: a batch that is run again after a crash writes its own
``batch=<n>`` folders once more, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import entry_key, record_id
from ..operators.history import flag_new
from ..schemas import ENTRY

POLLED = (
    "observed_at string, run_id string, branch string, collector_host string, source_system string, source_locator string, publisher_id_hint string, "
    f"content_hash string, payload struct<{ENTRY.replace(' string', ': string')}>"
)
PAIR = "entry_key string, content_hash string"
DIVISIONS = 256  # of the seen pairs; a batch reads those of its own entries
FEED = ["branch", "collector_host", "source_locator"]


def division(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(DIVISIONS)).cast("int").alias("division")



class Ingest:
    """Logs below ``root``: payloads/, sightings/ and pairs/ (the seen pairs), one folder per batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if self._there(name) else self.spark.createDataFrame([], schema)

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def seen_pairs(self, before: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """All seen pairs; with ``near``, those of the divisions in which the entries of ``near`` may stand."""
        pairs = self._read("pairs", f"{PAIR}, batch int, division int")
        if near is not None:
            wanted = [r[0] for r in near.select(division("entry_key")).distinct().collect()]  # at most DIVISIONS numbers
            pairs = pairs.filter(F.col("division").isin(wanted))
        return (pairs if before is None else pairs.filter(F.col("batch") < before)).drop("division")

    def feed_results(self) -> DataFrame:
        """Per run and feed: entries, new ones, and the first sighting in that batch."""
        return self._read("feeds", "run_id string, branch string, collector_host string, source_locator string, n_entries long, n_new long, feed_started_at string, batch int")

    def feed_starts(self) -> DataFrame:
        """When each collector first saw an entry of each feed."""
        return self.feed_results().groupBy(*FEED).agg(F.min("feed_started_at").alias("feed_started_at"))

    def compact(self, before: int) -> None:
        """The batches below ``before`` of each log as one folder, batch ``before - 1``, in files of a size.

        Not while a stream writes.  The new folder is whole before the old ones go; after a crash in between it
        stands beside the log as ``<name>.compact``.
        """
        for name in ("payloads", "sightings", "feeds", "pairs"):
            log = self.spark.read.parquet(f"{self.root}/{name}").filter(F.col("batch") < before).drop("batch")
            parts = ["division"] if name == "pairs" else []
            spread = log.repartition(*parts) if parts else log.repartitionByRange("observed_at" if "observed_at" in log.columns else "run_id")
            spread.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.root}/{name}.compact")
            path = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
            files = path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in files.listStatus(path(name)):
                folder = status.getPath().getName()
                if folder.startswith("batch=") and int(folder[6:]) < before:
                    files.delete(status.getPath(), True)
            files.rename(path(f"{name}.compact"), path(f"{name}/batch={before - 1}"))

    def write_batch(self, polled: DataFrame, number: int) -> None:
        """Payloads of new contents, a sighting for every record, and the new pairs."""
        keyed = polled.withColumn("entry_key", entry_key(F.col("payload.link"), F.col("content_hash")))
        flagged = flag_new(keyed, self.seen_pairs(number, keyed), [F.col("observed_at"), F.col("run_id")]).withColumn("raw_record_id", record_id(F.col("entry_key"), F.col("content_hash")))
        flagged = flagged.withColumn("payload_ref", F.concat(F.lit(f"{self.root}/payloads#raw_record_id="), "raw_record_id")).persist()
        new = flagged.filter("is_new")
        payload = ["raw_record_id", "entry_key", "content_hash", "source_system", "source_locator", "publisher_id_hint", "observed_at", "payload"]
        sighting = ["observed_at", "run_id", "branch", "collector_host", "entry_key", "content_hash", "is_new", "payload_ref"]
        feeds = flagged.groupBy("run_id", *FEED).agg(F.count("*").alias("n_entries"), F.count_if("is_new").alias("n_new"), F.min("observed_at").alias("feed_started_at"))
        try:
            for name, rows in (("payloads", new.select(payload)), ("sightings", flagged.select(sighting)), ("feeds", feeds)):
                rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={number}")
            pairs = new.select("entry_key", "content_hash", division("entry_key"))
            pairs.repartition("division").write.mode("overwrite").partitionBy("division").parquet(f"{self.root}/pairs/batch={number}")
        finally:
            flagged.unpersist()

    def run(self, landing: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
        """Take in every file of JSON lines that has landed, then stop; call again for later files."""
        polled = self.spark.readStream.schema(POLLED).option("maxFilesPerTrigger", files_per_batch).json(landing)
        return polled.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_flags(sightings: DataFrame, feed_starts: DataFrame) -> DataFrame:
    """Stream-static join: records published before their feed was watched (null if unknown)."""
    from ..functions.times import is_pre_start

    joined = sightings.join(feed_starts, ["branch", "collector_host", "source_locator"], "left")
    return joined.withColumn("is_pre_start", is_pre_start(F.col("published_at"), F.col("feed_started_at")))
