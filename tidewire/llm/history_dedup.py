"""Problem 2: new batches against all history, by content-defined chunking.

A record's visible words, joined by blanks, are cut where a rolling hash over WINDOW bytes has its upper
BOUNDARY_BITS bits clear, so an edit moves only the boundaries next to it.  A persistent table maps
chunk hashes to contents; a batch looks up the rarest chunks of its contents there, the shared
chunks' bytes are totalled, and a content whose shared bytes cover COVERAGE of the larger of the two is
decided: an exact word check follows.  Contents of accepted records are appended.

Chunks of several words cannot meet every pair at the threshold ``t`` (edits may touch each chunk), so contents that
coverage leaves undecided are looked up in a second persistent table, of word pairs.  A pair at ``t`` shares at
least ``ceil(t n)`` of a content's ``n`` word pairs, so one of its ``n - ceil(t n) + 1`` rarest is among
them, and the table lists all: this holds for any length and any place of the edits.

All tables are divided by the leading bits of their key and every lookup reads the divisions of the batch's own
keys only, so its cost depends on the batch: with ``bits`` chosen by ``bits_for``, a division has
about the same number of rows whatever the size of the history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .near_copies import EPS, PARITY, class_key, differing_bits, least_shared, list_array, overlap_of
from .scratch import Scratch
from .visible import parity_map, word_pair_hashes, words

THRESHOLD = 0.6
WINDOW = 8  # bytes
BOUNDARY_BITS = 4  # chunks of 16 bytes on average
LONGEST = 4095  # bytes of a chunk; its length stands in the lower SIZE_BITS bits of its key
SIZE_BITS = 12
COVERAGE = 0.5
#: Keys whose lookups make more comparisons than this are looked up in SALTS parts.
HOT, SALTS = 1 << 26, 64
#: Word pairs that a division of the index should hold, and what a record is reckoned at.
DIVISION_ROWS, RECORD_ROWS = 500_000, 64
MOST_BITS = 14  # 16,384 divisions: the bound of what the driver learns of a batch
_MIX = np.uint64(0x9E3779B97F4A7C15)


def chunks_of(data: bytes) -> np.ndarray:
    """Keys of the distinct chunks: 52 bits of hash above 12 bits of length."""
    cuts = [0]
    if len(data) >= WINDOW:
        rolled = np.ndarray((len(data) - WINDOW + 1,), "<u8", data, strides=(1,))
        cuts += (np.flatnonzero(rolled * _MIX >> np.uint64(64 - BOUNDARY_BITS) == 0) + WINDOW).tolist()
    if cuts[-1] != len(data):
        cuts.append(len(data))
    keys = set()
    for start, end in zip(cuts, cuts[1:]):
        for a in range(start, end, LONGEST):
            part = data[a : min(end, a + LONGEST)]
            keys.add(xxhash.xxh3_64_intdigest(part) >> SIZE_BITS << SIZE_BITS | len(part))
    return np.fromiter(keys, np.uint64, len(keys)).view(np.int64)


def chunk_bytes(key: Column) -> Column:
    return key.bitwiseAND(LONGEST)


READ = "ref long, since long, hi long, lo long, n int, total long, b0 long, b1 long, b2 long, pairs array<long>, chunks array<long>"
CONTENT = ["hi", "lo"]
HEAD = ["n", "total", *PARITY]


def read_records(records: DataFrame, fields: list[str]) -> DataFrame:
    """The one pass over the texts of ``records`` (ref, since, *fields): the name of each content, and its word
    pairs and chunks where this task has not given that content before.  Records without a word pair
    give no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            rows, sizes, pairs, chunk_sizes, chunks = [], [], [], [], []
            for ref, since, *texts in zip(*(batch.column(c).to_pylist() for c in ("ref", "since", *fields))):
                tokens = words(*texts)
                held = word_pair_hashes(tokens)
                if not len(held):
                    continue
                name = class_key(held)
                cut = None if name in given else chunks_of(" ".join(tokens).encode())
                given.add(name)
                sizes.append(None if cut is None else len(held))
                chunk_sizes.append(None if cut is None else len(cut))
                if cut is not None:
                    pairs.append(held.view(np.int64))
                    chunks.append(cut)
                rows.append((ref, since, *name, len(held), None if cut is None else int((cut & LONGEST).sum()), *parity_map(held)))
            columns = [*zip(*rows)] or [()] * 9
            arrays = [pa.array(c, pa.int32() if k == 4 else pa.int64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, list_array(pairs, sizes), list_array(chunks, chunk_sizes)], [*_names(READ)])

    return records.select("ref", "since", *fields).mapInArrow(read, READ)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def contents_of(read: DataFrame) -> DataFrame:
    """One row per content, with ``first``: the least ``since`` of its records."""
    only = (F.first(c, ignorenulls=True).alias(c) for c in (*HEAD, "pairs", "chunks"))
    return read.groupBy(*CONTENT).agg(F.min("since").alias("first"), *only)


def bits_for(records: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, records * RECORD_ROWS / DIVISION_ROWS))), 1, MOST_BITS))


_POSTING = "key long, hi long, lo long, first long, n int, total long, b0 long, b1 long, b2 long, division int"
TABLES = {
    "contents": "hi long, lo long, first long, n int, total long, b0 long, b1 long, b2 long, pairs array<long>, chunks array<long>, division int",
    "chunks": _POSTING,
    "pairs": _POSTING,
    "chunk_counts": "key long, contents long, division int",
    "pair_counts": "key long, contents long, division int",
}


class SeenIndex:
    """The persistent tables under ``folder``, each divided by the leading ``bits`` of its key:

    ``contents`` (by name), ``chunks`` and ``pairs`` (key to content), ``chunk_counts`` and ``pair_counts`` (key to number of
    contents, one row for each append).  ``bits`` is fixed when the index is made; ``divided`` copies an index that has outgrown it.
    """

    def __init__(self, spark: SparkSession, folder: str, bits: int = 4):
        self.spark, self.folder, self.bits = spark, folder.rstrip("/"), bits

    def division(self, key: str) -> Column:
        return F.shiftrightunsigned(key, 64 - self.bits).cast("int")

    def add(self, records: DataFrame, fields: list[str], scratch: Scratch) -> None:
        """Append the contents of ``records`` that the index does not hold."""
        self.append(contents_of(read_records(records, fields)), scratch)

    accept = add

    def append(self, contents: DataFrame, scratch: Scratch) -> None:
        new = scratch.table(contents)
        if self.holds("contents"):
            new = scratch.table(new.join(self.near("contents", new.select("hi")).select(*CONTENT), CONTENT, "left_anti"))
        self._write("contents", new, "hi")
        for kind in ("chunks", "pairs"):
            self._write(kind, keyed(new, kind), "key")
            counts = new.select(F.explode(kind).alias("key")).groupBy("key").agg(F.count("*").alias("contents"))
            self._write(f"{kind[:-1]}_counts", counts, "key")

    def divided(self, folder: str, bits: int, scratch: Scratch) -> "SeenIndex":
        """A copy of the index under ``folder`` in other divisions."""
        other = SeenIndex(self.spark, folder, bits)
        other.append(self.table("contents").drop("division"), scratch)
        return other

    def _write(self, name: str, rows: DataFrame, key: str) -> None:
        divided = rows.withColumn("division", self.division(key))
        divided.repartition("division").write.mode("append").partitionBy("division").parquet(f"{self.folder}/{name}")

    def holds(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def near(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of the divisions of a table in which ``keys`` (one column) may stand."""
        wanted = [r[0] for r in keys.select(self.division(keys.columns[0])).distinct().collect()]  # at most 2**MOST_BITS numbers
        table = self.table(name)
        return (table if len(wanted) == 1 << self.bits else table.filter(F.col("division").isin(wanted))).drop("division")

    def rarest(self, new: DataFrame, kind: str) -> DataFrame:
        """The postings of the contents ``new`` with ``contents``, the number of indexed and new contents that hold a key, and
        ``rank`` and ``before`` (bytes of rarer keys) within a content, rarest first."""
        each = keyed(new, kind)
        fresh = each.groupBy("key").agg(F.count("*").alias("contents"))
        known = self.near(f"{kind[:-1]}_counts", each.select("key")).groupBy("key").agg(F.sum("contents").alias("contents"))
        counts = fresh.join(known.withColumnRenamed("contents", "c"), "key", "left").select("key", (F.col("contents") + F.coalesce("c", F.lit(0))).alias("contents"))
        order = Window.partitionBy(*CONTENT).orderBy("contents", "key")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        return each.join(counts, "key").select(
            "*", F.row_number().over(order).alias("rank"), F.coalesce(F.sum(chunk_bytes(F.col("key"))).over(before), F.lit(0)).alias("before")
        )

    def candidates(self, looked: DataFrame, new: DataFrame, kind: str, threshold: float, scratch: Scratch) -> DataFrame:
        """(ahi, alo, bhi, blo): contents that share a looked-up key with an earlier one and may reach the threshold."""
        looked = scratch.table(looked.filter("contents > 1"))  # a key that one content holds meets nothing
        listed = self.near(kind, looked.select("key")).unionByName(keyed(new, kind))
        work = looked.groupBy("key").agg((F.count("*") * F.max("contents")).alias("comparisons"))
        hot = scratch.table(work.filter(F.col("comparisons") > HOT).select("key"))
        if hot.isEmpty():
            met = _met(looked, listed, ["key"], threshold)
        else:
            met = _met(looked.join(hot, "key", "left_anti"), listed, ["key"], threshold)
            parts = looked.join(hot, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = met.union(_met(parts, listed.join(hot, "key").withColumn("salt", F.pmod(F.xxhash64(*CONTENT), F.lit(SALTS)).cast("int")), ["key", "salt"], threshold))
        return scratch.table(met.distinct())

    def compared(self, met: DataFrame, new: DataFrame, scratch: Scratch) -> DataFrame:
        """``met`` with the overlap of each two contents and ``covered``, the share of shared chunk bytes in the larger."""
        names = scratch.table(met.select(F.col("bhi").alias("hi"), F.col("blo").alias("lo")).distinct())
        held = self.near("contents", names.select("hi")).unionByName(new)
        side = lambda df, x: df.select(*(F.col(c).alias(f"{x}{c}") for c in (*CONTENT, "total", "pairs", "chunks")))
        both = met.join(side(new, "a"), ["ahi", "alo"]).join(side(held.join(names, CONTENT, "left_semi"), "b"), ["bhi", "blo"])
        shared = F.aggregate(F.array_intersect("achunks", "bchunks"), F.lit(0).cast("long"), lambda s, x: s + chunk_bytes(x))
        return both.select("ahi", "alo", "bhi", "blo", overlap_of("apairs", "bpairs").alias("overlap"), (shared / F.greatest("atotal", "btotal")).alias("covered"))

    def check(self, batch: DataFrame, fields: list[str], scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
        """(ref, decision, overlap, covered) of each record of ``batch`` that repeats an indexed or an earlier
        batch record: ``copy`` (the same word pairs) or ``near_copy``; the figures are the best of the matches looked at.

        ``batch``: ref, since, *fields; no earlier text is read.
        """
        read = scratch.table(read_records(batch, fields))
        own = contents_of(read)
        known = self.near("contents", read.select("hi")).select(*CONTENT, F.lit(True).alias("known"))
        own = scratch.table(own.join(known, CONTENT, "left"))
        firsts = own.select(*CONTENT, "first", F.coalesce("known", F.lit(False)).alias("known"))
        seen = read.select("ref", "since", *CONTENT).distinct().join(firsts, CONTENT).withColumn("copy", F.col("known") | (F.col("since") > F.col("first")))
        new = own.filter("known is null").drop("known")

        least = F.lit(1 - COVERAGE) * F.col("total")
        by_chunks = self.candidates(self.rarest(new, "chunks").filter(F.col("before") <= least), new, "chunks", threshold, scratch)
        decided = self.compared(by_chunks, new, scratch).filter((F.col("covered") >= COVERAGE) & (F.col("overlap") >= threshold - EPS))
        decided = scratch.table(decided)

        rest = scratch.table(new.join(decided.select(F.col("ahi").alias("hi"), F.col("alo").alias("lo")), CONTENT, "left_anti"))
        enough = F.col("n") - F.ceil(threshold * F.col("n") - EPS) + 1
        by_pairs = self.candidates(self.rarest(rest, "pairs").filter(F.col("rank") <= enough), new, "pairs", threshold, scratch)
        exact = self.compared(by_pairs, new, scratch).filter(F.col("overlap") >= threshold - EPS)

        best = decided.unionByName(exact).groupBy(F.col("ahi").alias("hi"), F.col("alo").alias("lo"))
        best = best.agg(F.max("overlap").alias("overlap"), F.max("covered").alias("covered"))
        found = seen.join(best, CONTENT, "left").filter(F.col("copy") | F.col("overlap").isNotNull())
        pick = lambda c: F.when(F.col("copy"), 1.0).otherwise(F.col(c)).alias(c)
        return found.select("ref", F.when(F.col("copy"), "copy").otherwise("near_copy").alias("decision"), pick("overlap"), pick("covered"))


def keyed(contents: DataFrame, kind: str) -> DataFrame:
    """Postings (key, content, first, head) of the chunks or word pairs of contents."""
    return contents.select(F.explode(kind).alias("key"), *CONTENT, "first", *HEAD)


def _met(looked: DataFrame, listed: DataFrame, on: list[str], threshold: float) -> DataFrame:
    a, b = looked.alias("a"), listed.alias("b")
    n = F.col("a.n") + F.col("b.n")
    near = (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - EPS) & ((n - differing_bits("a", "b", PARITY)) / 2 >= least_shared(n, threshold))
    return (
        a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
        .filter(F.expr("b.first < a.first and (b.hi <> a.hi or b.lo <> a.lo)") & near)
        .select(*(F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "ab" for c in CONTENT))
    )


FIELDS = ["title", "body"]


def payload_texts(records: DataFrame, ref: Column, since: Column) -> DataFrame:
    """(ref, since, title, body) of raw records: body is ``summary``, else ``description``."""
    return records.select(
        ref.cast("long").alias("ref"), since.cast("long").alias("since"), F.col("payload.title").alias("title"), F.coalesce("payload.summary", "payload.description").alias("body")
    )


def repeated_records(history: DataFrame, incoming: DataFrame) -> tuple[DataFrame, Scratch]:
    """Each record of ``incoming`` that repeats a record of ``history`` or an incoming record of
    smaller ``item_no``: ``item_no``, ``decision`` (``copy`` or ``near_copy``), ``overlap``, ``covered``.

    Records without two words repeat nothing.  Null payloads and null texts are empty texts; a null
    ``item_no`` is left out; repeated rows of one ``item_no`` count once.
    """
    scratch = Scratch(incoming.sparkSession, "seen")
    index = SeenIndex(incoming.sparkSession, f"{scratch.root}/index", bits_for(history.count()))
    index.add(payload_texts(history, F.lit(None), F.lit(-1)), FIELDS, scratch)
    item = F.col("item_no")
    found = index.check(payload_texts(incoming.filter("item_no is not null"), item, item), FIELDS, scratch)
    rank = F.max(F.struct(F.col("decision") == "copy", "overlap", "covered", "decision")).alias("m")
    return found.groupBy(F.col("ref").alias("item_no")).agg(rank).select("item_no", "m.decision", "m.overlap", "m.covered"), scratch
