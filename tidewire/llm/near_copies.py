"""Problem 4: near-duplicate records by a byte-position inverted index with count filtering.

Every distinct two-word sequence of a record is hashed to 64 bits: the upper 56 are a position in a
sparse byte map, the lower 8 the byte that stands there.  Two records share a positional byte exactly
where they share a two-word sequence.  The inverted index lists records under (position, byte), the number of
listed positional bytes that two records share is tallied, and pairs that reach the guaranteed minimum
are verified on all their positional bytes.

* A pair with an overlap (Jaccard) of ``t`` shares at least ``o = ceil(t / (1 + t) * (|A| + |B|))`` of
  them.  The index leaves out the commonest ones: the larger record lists all but its ``ceil(t |B|) - TALLY``
  commonest, the smaller all but ``ceil(2t / (1 + t) |A|) - TALLY``.  The TALLY rarest that a pair shares are
  then listed by both, so its tally is at least ``min(TALLY, o)``: nothing is capped and no pair is lost.
* Rarity is the exact number of records that hold a positional byte, counted over all records.  One that a
  single record holds meets nothing and is not listed.
* A (position, byte) listed by very many records is split into block pairs.
* Before they are tallied, pairs are rejected by an upper bound of what they share, from 192 parity bits of
  each record: exact, and it keeps most meetings of common bytes out of the shuffle.

Exact copies are one class: the index holds one representative of each, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, meeting
from .scratch import Scratch
from .visible import parity_map, word_pair_hashes, words

THRESHOLD = 0.6
#: Listed positional bytes that a pair at the threshold is guaranteed to share (all of them, if fewer).
TALLY = 3
EPS = 1e-9


def class_key(pairs: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set of word pairs, as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(pairs.tobytes()), np.int64).tolist())


READ = "record_id string, hi long, lo long, b0 long, b1 long, b2 long, keys array<long>"
PARITY = ["b0", "b1", "b2"]


def positional_bytes(records: DataFrame, fields: list[str]) -> DataFrame:
    """The one pass over the texts: per record the name of its set of positional bytes, and the set itself
    (null where this task has given that set before).  Records without a word pair give no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            ids, names, bits, keys, sizes = [], [], [], [], []
            for record, *texts in zip(*(batch.column(c).to_pylist() for c in ("record_id", *fields))):
                pairs = word_pair_hashes(words(*texts))
                if not len(pairs):
                    continue
                name = class_key(pairs)
                ids.append(record)
                names.append(name)
                bits.append(parity_map(pairs))
                sizes.append(None if name in given else len(pairs))
                if sizes[-1] is not None:
                    given.add(name)
                    keys.append(pairs.view(np.int64))
            columns = [*zip(*names), *zip(*bits)] or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), *(pa.array(c, pa.int64()) for c in columns), list_array(keys, sizes)], ["record_id", "hi", "lo", *PARITY, "keys"]
            )

    return records.select("record_id", *fields).mapInArrow(read, READ)


def list_array(parts: list[np.ndarray], sizes: list[int | None]) -> pa.Array:
    """An Arrow array of lists from the values of those that are not null."""
    null = np.fromiter((n is None for n in sizes), bool, len(sizes))
    ends = np.cumsum(np.fromiter((n or 0 for n in sizes), np.int64, len(sizes)))
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32), mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def byte_index(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The inverted index (position, byte, cid, n, b0, b1, b2, small): the positional bytes that each class
    lists, and whether it lists one also as the smaller side of a pair.

    ``classes``: cid, n, b0, b1, b2, keys.
    """
    each = classes.select("cid", "n", F.explode("keys").alias("key"))
    held = each.groupBy("key").agg(F.count("*").alias("records")).filter("records > 1")
    ranked = each.join(held, "key").withColumn("common", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("records"), "key")))
    left_out = lambda share: F.ceil(F.lit(share) * F.col("n") - EPS) - TALLY
    listed = ranked.filter(F.col("common") > left_out(threshold)).join(classes.select("cid", *PARITY), "cid")
    return listed.select(
        F.shiftright("key", 8).alias("position"),
        F.col("key").bitwiseAND(0xFF).cast("short").alias("byte"),
        "cid", "n", *PARITY,
        (F.col("common") > left_out(2 * threshold / (1 + threshold))).alias("small"),
    )


def differing_bits(a: str, b: str, bits: list[str]) -> F.Column:
    """Bits in which two rows differ: for parity bits, at most the elements that only one of two sets has."""
    return sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in bits), F.lit(0))


def least_shared(n: F.Column, threshold: float) -> F.Column:
    """What two sets of ``n`` elements together share at the threshold."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * n - EPS)


def tallied_pairs(index: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of classes whose shared listed positional bytes reach the guaranteed minimum."""
    left, right, on = meeting(index, ["position", "byte"], "cid", scratch, BLOCK)
    a, b = left.alias("a"), right.alias("b")
    smaller = F.expr("a.n < b.n or a.n = b.n and a.cid < b.cid")
    n = F.col("a.n") + F.col("b.n")
    least = least_shared(n, threshold)
    return (
        a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
        .filter(F.col("a.small") & smaller & (F.col("a.n") >= F.lit(threshold) * F.col("b.n") - EPS))
        .filter((n - differing_bits("a", "b", PARITY)) / 2 >= least)
        .groupBy(F.col("a.cid").alias("a"), F.col("b.cid").alias("b"))
        .agg(F.count("*").alias("tally"), F.max(least).alias("least"))
        .filter(F.col("tally") >= F.least(F.lit(TALLY), "least"))
        .select("a", "b")
    )


def overlap_of(a: str, b: str) -> F.Column:
    """Shared distinct word pairs over those in either, of two columns of hashed sets."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def near_copies(records: DataFrame, id_column: str, fields: list[str], threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, Scratch]:
    """(pairs of classes with their overlap, members of classes, the scratch tables behind them).

    ``pairs``: ``a``, ``b`` (numbers of classes), ``left_class``, ``right_class`` (smallest member id of each,
    smaller first) and ``overlap``; ``members``: ``record_id``, ``cid``, ``class_id``.  Every record with at least
    two words is a member of one class, or of several if it stands in rows with different texts.

    Null ids are left out; null fields are empty texts; records of fewer than two words match
    nothing; repeated rows count once; all other columns are ignored.
    """
    scratch = Scratch(records.sparkSession, "near")
    own = records.select(F.col(id_column).cast("string").alias("record_id"), *(F.col(f).alias(f"f{k}") for k, f in enumerate(fields)))
    read = scratch.table(positional_bytes(own.filter("record_id is not null"), [f"f{k}" for k in range(len(fields))]))
    named = read.groupBy("hi", "lo").agg(F.min("record_id").alias("class_id"), F.first("keys", ignorenulls=True).alias("keys"), *(F.first(b).alias(b) for b in PARITY))
    # numbers of 64 bits that cannot collide: given once, in a written table
    classes = scratch.table(named.select(F.monotonically_increasing_id().alias("cid"), F.size("keys").alias("n"), "class_id", "hi", "lo", *PARITY, "keys"))
    members = scratch.table(read.select("record_id", "hi", "lo").distinct().join(classes.select("hi", "lo", "cid", "class_id"), ["hi", "lo"]).select("record_id", "cid", "class_id"))
    scratch.drop(read)
    index = scratch.table(byte_index(classes, threshold))
    met = scratch.table(tallied_pairs(index, threshold, scratch))
    scratch.drop(index)
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("class_id").alias(f"{c}_class"), F.col("keys").alias(f"{c}_keys"))
    scored = met.join(side("a"), "a").join(side("b"), "b").withColumn("overlap", overlap_of("a_keys", "b_keys"))
    pairs = scored.filter(F.col("overlap") >= threshold - EPS).select(
        "a", "b", F.least("a_class", "b_class").alias("left_class"), F.greatest("a_class", "b_class").alias("right_class"), "overlap"
    )
    return scratch.table(pairs), members, scratch


def near_copy_articles(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of different records at or above the threshold, copies expanded, smaller id first."""
    side = lambda c, r: members.select(F.col("cid").alias(c), F.col("record_id").alias(r))
    across = pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y").filter("x <> y")
    same = side("cid", "x").join(side("cid", "y"), "cid").select("x", "y").filter("x < y")
    return across.union(same).select(F.least("x", "y").alias("left_article_id"), F.greatest("x", "y").alias("right_article_id")).distinct()
