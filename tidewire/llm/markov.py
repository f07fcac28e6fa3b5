"""Problem 5: similarity clusters by Markov clustering on a graph of near vectors.

The graph joins vectors with a cosine of at least the threshold.  Its pairs come from a
cross-polytope hash index over every vector (never all pairs): two vectors are compared if they
share a bucket in one of the tables and their 256 sign bits are close enough, and then their
cosine is computed exactly.  The number of tables follows from the chance that a pair at the threshold shares a
hash value, simulated for the vectors' dimension, so that at most MISS of the pairs at the threshold itself are
missed, and far fewer above it; the tests measure it against brute force.

Markov clustering runs on the distributed sparse matrix of the graph with loops: squaring, inflation,
pruning of small entries, until nothing moves.  Members with the same neighbours (true twins) have equal
columns in every power, so they are one matrix index with a multiplicity: exact, and a cluster of mutually similar members,
whatever its size, is a single entry.  Attractor rows define the clusters; members with the
strongest flow, then the nearest to the cluster's mean, represent them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, meeting
from .groups import connected_groups
from .near_copies import differing_bits
from .scratch import Scratch

THRESHOLD = 0.8
INFLATION = 2.0
#: Entries are judged against the largest of their column, which shrinks with the size of a cluster: below
#: PRUNE of it they go (unless their members together hold PRUNE of the column), the flow is still when no entry
#: moves by STILL of it, and rows within TIE of it are equal.
PRUNE = 1e-4
STILL = 1e-3
TIE = 1e-6
LEAST_ROUNDS, ROUNDS = 3, 100
SEED = 20
#: Share of the pairs exactly at the threshold that all tables together may miss.
MISS = 0.02
#: Rows that a bucket of vectors without neighbours should hold, at any number of vectors.
BUCKET_ROWS = 256
SIGN_BITS = 256
SIGNS = [f"s{k}" for k in range(SIGN_BITS // 64)]
TYPICAL = 3


def hash_values(n: int, dim: int) -> int:
    """Cross-polytope values per table: as many as give buckets of BUCKET_ROWS."""
    return max(1, int(np.ceil(np.log(max(n, 1) / BUCKET_ROWS) / np.log(2 * dim))))


@lru_cache(maxsize=16)
def meet_once(dim: int, threshold: float, pairs: int = 20_000) -> float:
    """Chance that two vectors at the threshold share one cross-polytope value, by seeded simulation."""
    rng = np.random.default_rng(SEED)
    met = 0
    for _ in range(pairs // 1000):
        x, z = rng.normal(size=(2, 1000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * z
        p, q = np.abs(x).argmax(1), np.abs(y).argmax(1)
        met += int(((p == q) & (np.sign(x[np.arange(1000), p]) == np.sign(y[np.arange(1000), q]))).sum())
    return met / pairs


def tables(values: int, dim: int, threshold: float = THRESHOLD) -> int:
    meet = min(meet_once(dim, threshold) ** values, 1 - 1e-9)
    return max(1, int(np.ceil(np.log(MISS) / np.log(1 - meet)))) if meet > 0 else 1


def most_different(threshold: float) -> int:
    """Sign bits in which a pair at the threshold may differ: the mean and five deviations."""
    p = np.arccos(threshold) / np.pi
    return int(np.ceil(SIGN_BITS * p + 5 * np.sqrt(SIGN_BITS * p * (1 - p))))


def rotations(dim: int, count: int) -> np.ndarray:
    """Random orthogonal matrices [count, dim, dim], the same in every task."""
    rng = np.random.default_rng(SEED)
    return np.linalg.qr(rng.normal(size=(count, dim, dim)))[0].astype(np.float32)


def unit_rows(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors, their unit rows): of the length ``dim``, no nulls, no NaN, not zero."""
    usable = [k for k, v in enumerate(vectors) if v is not None and len(v) == dim and None not in v]
    x = np.array([vectors[k] for k in usable], np.float64).reshape(len(usable), dim)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return np.array(usable, np.int64)[good], (x[good] / norm[good, None]).astype(np.float32)


HASHED = "article_id string, n1 long, n2 long, s0 long, s1 long, s2 long, s3 long, buckets array<int>, unit array<float>"


def hashed_vectors(vectors: DataFrame, dim: int, values: int, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the 128-bit name of its unit vector and its sign bits, and the vector's bucket in each table and the
    vector itself where this task has not listed it before: exact copies are one vector."""
    count = tables(values, dim, threshold)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = rotations(dim, count * values + -(-SIGN_BITS // dim))
        turn, signs = every[: count * values], every[count * values :]
        listed: set[bytes] = set()
        for batch in batches:
            at, x = unit_rows(batch.column("embedding").to_pylist(), dim)
            if not len(at):
                continue
            names = [xxhash.xxh3_128_digest(r.tobytes()) for r in np.round(x, 6) + np.float32(0)]
            bucket = np.zeros((len(x), count), np.int64)
            for k in range(count * values):
                y = x @ turn[k]
                top = np.abs(y).argmax(1)
                value = 2 * top + (y[np.arange(len(y)), top] > 0)
                bucket[:, k // values] = bucket[:, k // values] * (2 * dim) + value
            # 31 bits of (table, values); the sign bits tell apart what falls together
            mixed = (bucket.astype(np.uint64) * np.uint64(count) + np.arange(count, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            keys = (mixed >> np.uint64(33)).astype(np.int32)
            bits = np.concatenate([x @ s for s in signs], 1)[:, :SIGN_BITS] > 0
            packed = np.packbits(bits, axis=1).view(np.int64)
            old = np.zeros(len(x), bool)
            for k, name in enumerate(names):
                old[k] = name in listed
                listed.add(name)
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("article_id").take(pa.array(at)), *map(pa.array, (name[:, 0], name[:, 1], *packed.T)), _lists(keys, old), _lists(x, old)],
                [c.split()[0] for c in HASHED.split(", ")],
            )

    return vectors.select("article_id", "embedding").mapInArrow(rows, HASHED)


def _lists(values: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.where(null, 0, values.shape[1]))))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(null, False)), pa.array(values[~null].ravel()))


def different_vectors(hashed: DataFrame, scratch: Scratch, named: DataFrame | None = None) -> DataFrame:
    """(vid, n1, n2, s0 to s3, buckets, unit) once per different vector, of those in ``named`` (n1, n2) where it is given; numbers
    of 64 bits that cannot collide."""
    only = (F.first(c, ignorenulls=True).alias(c) for c in (*SIGNS, "buckets", "unit"))
    every = hashed.groupBy("n1", "n2").agg(*only)
    every = every if named is None else every.join(named.select("n1", "n2").distinct(), ["n1", "n2"], "left_semi")
    return scratch.table(every.select(F.monotonically_increasing_id().alias("vid"), "*"))


def near_vectors(different: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (x, y, cosine) of different vectors, x < y, at or above the threshold."""
    left, right, on = meeting(different.select("vid", *SIGNS, F.explode("buckets").alias("bucket")), ["bucket"], "vid", scratch, BLOCK)
    a, b = left.alias("a"), right.alias("b")
    met = (
        a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
        .filter((F.col("a.vid") < F.col("b.vid")) & (differing_bits("a", "b", SIGNS) <= most_different(threshold)))
        .select(F.col("a.vid").alias("x"), F.col("b.vid").alias("y"))
        .distinct()
    )
    dot = F.aggregate(F.zip_with("u", "v", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return (
        met.join(different.select(F.col("vid").alias("x"), F.col("unit").alias("u")), "x")
        .join(different.select(F.col("vid").alias("y"), F.col("unit").alias("v")), "y")
        .select("x", "y", dot.alias("cosine"))
        .filter(F.col("cosine") >= threshold)
    )


def markov_flow(edges: DataFrame, scratch: Scratch, inflation: float = INFLATION) -> DataFrame:
    """(node, attractor, flow): the attractor each node's flow ends in, and the flow through the node.

    ``edges``: undirected (x, y), once each.
    """
    both = edges.select(F.col("x").alias("node"), F.col("y").alias("next")).union(edges.select("y", "x"))
    closed = both.union(edges.select("x", "x")).union(edges.select("y", "y")).distinct()
    mark = closed.groupBy("node").agg(F.count("*").alias("degree"), F.expr("bit_xor(xxhash64(next))").alias("h1"), F.expr("bit_xor(xxhash64(next, 7))").alias("h2"))
    # twins: the smallest member stands for all; counted before the shuffle
    groups = mark.groupBy("degree", "h1", "h2").agg(F.min("node").alias("lump"), F.count("*").alias("m"))
    lumps = scratch.table(mark.join(groups, ["degree", "h1", "h2"]).select("node", "lump", "m"))
    to_lump = lumps.select(F.col("node"), "lump")
    heads = lumps.filter("node = lump").select("lump", "m")
    quotient = (
        closed.join(lumps.filter("node = lump").select("node"), "node", "left_semi")
        .join(to_lump.withColumnRenamed("node", "next").withColumnRenamed("lump", "row"), "next")
        .select(F.col("node").alias("col"), "row")
        .distinct()
    )
    weight = heads.select(F.col("lump").alias("row"), F.col("m").alias("mr"))
    entries = quotient.join(weight, "row").select("col", "row", "mr", F.lit(1.0).alias("p"))
    current = scratch.table(_normalised(entries))
    alone = current.groupBy("col").agg(F.count("*").alias("rows")).filter("rows = 1").select("col")
    settled = scratch.table(current.join(alone, "col", "left_semi"))
    final = settled.unionByName(_still(scratch.table(current.join(alone, "col", "left_anti")), scratch, inflation))
    systems, _ = connected_groups(_links(final), "x", "y")
    flow = final.join(heads.select(F.col("lump").alias("col"), F.col("m").alias("mc")), "col").groupBy("row").agg(F.sum(F.col("p") * F.col("mc")).alias("flow"))
    return (
        to_lump.join(systems.select(F.col("node").alias("lump"), "group"), "lump", "left")
        .join(flow.withColumnRenamed("row", "lump"), "lump", "left")
        .select("node", F.coalesce("group", "lump").alias("attractor"), F.coalesce("flow", F.lit(0.0)).alias("flow"))
    )


def _still(current: DataFrame, scratch: Scratch, inflation: float = INFLATION) -> DataFrame:
    """The matrix (col, row, mr, p) after squaring and inflation until nothing moves."""
    if current.isEmpty():
        return current
    for done in range(1, ROUNDS + 1):
        onward = current.select(F.col("row").alias("mid"), "col", F.col("mr").alias("mm"), F.col("p").alias("q"))
        squared = (
            current.select(F.col("col").alias("mid"), "row", "mr", "p")
            .join(onward, "mid")
            .groupBy("col", "row")
            .agg(F.max("mr").alias("mr"), F.sum(F.col("p") * F.col("q") * F.col("mm")).alias("p"))
        )
        inflated = _normalised(squared.withColumn("p", F.pow("p", F.lit(inflation))))
        top = inflated.groupBy("col").agg(F.max("p").alias("top"))
        kept = inflated.join(top, "col").filter((F.col("p") * F.col("mr") >= PRUNE) | (F.col("p") >= PRUNE * F.col("top"))).drop("top")
        following = scratch.table(_normalised(kept))
        old = current.select("col", "row", F.col("p").alias("was"))
        peak = following.groupBy("col").agg(F.max("p").alias("peak"))
        change = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))) / F.col("peak")
        moved = following.join(old, ["col", "row"], "full").join(peak, "col").agg(F.max(change).alias("d")).head()["d"]
        scratch.drop(current)
        current = following
        if done >= LEAST_ROUNDS and moved < STILL:
            return current
    raise RuntimeError(f"the flow still moves by {moved:.2g} of a column's largest entry after {ROUNDS} rounds")


def _links(final: DataFrame) -> DataFrame:
    """Links (x, y) of columns to the rows they end in.

    A column that ends in itself is linked to all rows equal to its largest, so attractors that share their
    flow evenly are one system whatever the order of sums; another column to the smallest of them.
    """
    top = final.groupBy("col").agg(F.max("p").alias("top"))
    equal = final.join(top, "col").filter(F.col("p") >= (1 - TIE) * F.col("top")).select("col", "row")
    to = equal.groupBy("col").agg(F.min("row").alias("least"), F.bool_or(F.col("row") == F.col("col")).alias("own"))
    return equal.join(to, "col").filter(F.col("own") | (F.col("row") == F.col("least"))).select(F.col("col").alias("x"), F.col("row").alias("y"))


def _normalised(entries: DataFrame) -> DataFrame:
    total = entries.groupBy("col").agg(F.sum(F.col("p") * F.col("mr")).alias("t"))
    return entries.join(total, "col").select("col", "row", "mr", (F.col("p") / F.col("t")).alias("p"))


def similarity_clusters(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, Scratch]:
    """(members, clusters, scratch).

    ``members``: ``article_id``, ``first_article_id`` (smallest of the cluster), ``vid`` and ``flow``, for
    every article in a cluster of two or more.  ``clusters``: ``first_article_id``, ``size``, and the
    TYPICAL most typical members in order.

    Null, empty, zero and not-finite vectors, and vectors of another length than the most common one,
    are in no cluster; vectors need not be of unit length; an article in several rows counts once, with the vector whose
    name (a hash) is the smallest; null ids are left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "markov")
    rows = vectors.select(F.col("article_id").cast("string").alias("article_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.filter("article_id is not null and embedding is not null and size(embedding) > 0")
    shape = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = shape[0] if shape else (1, 0)
    hashed = scratch.table(hashed_vectors(rows.filter(F.size("embedding") == dim), dim, hash_values(n, dim), threshold))
    # an article in several rows is judged by name, so that no vector is moved for it
    named = scratch.table(hashed.groupBy("article_id").agg(F.min(F.struct("n1", "n2")).alias("s")).select("article_id", "s.*"))
    different = different_vectors(hashed, scratch, named)
    units = different.select("vid", "unit")
    edges = scratch.table(near_vectors(different, threshold, scratch).select("x", "y"))
    flows = scratch.table(markov_flow(edges, scratch))
    placed = named.join(different.select("n1", "n2", "vid"), ["n1", "n2"])
    held = placed.select("article_id", "vid").join(flows.withColumnRenamed("node", "vid"), "vid", "left")
    held = held.withColumn("attractor", F.coalesce("attractor", "vid")).withColumn("flow", F.coalesce("flow", F.lit(1.0)))
    named = held.groupBy("attractor").agg(F.min("article_id").alias("first_article_id"), F.count("*").alias("size")).filter("size > 1")
    members = scratch.table(held.join(named, "attractor").select("article_id", "first_article_id", "size", "vid", "flow"))
    return members, _described(members, units), scratch


def _described(members: DataFrame, units: DataFrame) -> DataFrame:
    placed = members.join(units, "vid")
    means = placed.select("first_article_id", F.posexplode("unit").alias("d", "u")).groupBy("first_article_id", "d").agg(F.avg("u").alias("u"))
    means = means.groupBy("first_article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "u"))), lambda s: s["u"]).alias("mean"))
    near = F.aggregate(F.zip_with("unit", "mean", lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    ranked = placed.join(means, "first_article_id").select("first_article_id", "size", "article_id", F.round("flow", 9).alias("flow"), F.round(near, 9).alias("near"))
    order = (F.desc("flow"), F.desc("near"), F.asc("article_id"))
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("article_id"), F.lit(64)))
    best = salted.withColumn("k", F.row_number().over(Window.partitionBy("first_article_id", "salt").orderBy(*order))).filter(F.col("k") <= TYPICAL)
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("first_article_id").orderBy(*order))).filter(F.col("k") <= TYPICAL)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "article_id"))), lambda s: s["article_id"])
    return best.groupBy("first_article_id").agg(F.max("size").alias("size"), F.array_join(listed, ";").alias("typical_members"))
