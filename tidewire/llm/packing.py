"""Problem 8: filling fixed-capacity containers, with a certified bound.

Documents are spread over partitions of bounded size and each is packed by best-fit decreasing.
Dual feasible functions give a lower bound on the containers a partition needs; where the packing
meets it, the partition is certified and done.  Partitions with a gap give the documents of
their emptier containers to an exchange, which regroups them and packs again, until a round saves less than
LEAST_SAVED of the containers it packs again.  The functions are sums over texts, so the same bound is also given for
all texts at once.

A text longer than the capacity is cut into full pieces, which fill containers of their own, and a
rest, which is packed like any other text.  No other text is divided.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import token_size
from .scratch import Scratch

PARTITION_ROWS = 20_000  # documents that one task packs at a time
LEAST_SAVED = 0.001
MOST_PACKS = 1_000  # capacities; more are an error
#: Containers filled to this share stay closed in an exchange.
WELL_FILLED = 0.995


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Fewest containers that any packing of ``sizes`` needs, by dual feasible functions.

    The plain volume bound, the functions that round large items up and drop small ones (one for each
    of up to 64 item sizes up to half the capacity), and the rounding functions u(k) for k = 1..20.
    """
    if not len(sizes):
        return 0
    x, best = sizes.astype(np.int64), -(-int(sizes.sum()) // capacity)
    small = np.unique(x[(x > 0) & (2 * x <= capacity)])
    for eps in small[np.linspace(0, len(small) - 1, min(64, len(small))).astype(int)] if len(small) else ():
        value = np.where(x > capacity - eps, capacity, np.where(x >= eps, x, 0)).sum()
        best = max(best, -(-int(value) // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        # in units of capacity / k: x if (k + 1) x is whole, else floor((k + 1) x) / k
        value = np.where(whole, k * x, (scaled // capacity) * capacity).sum()
        best = max(best, -(-int(value) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest first, each into the fullest container it fits."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # (free space, container), sorted
    used = 0
    for k in order.tolist():
        size = int(sizes[k])
        if not size and used:
            break  # empty texts need no room: all in the first container
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, bin_no = room.pop(at)
        else:
            free, bin_no, used = capacity, used, used + 1
        out[k] = bin_no
        if free > size:
            insort(room, (free - size, bin_no))
    return out


PACKED = "pack_name string, doc_id long, piece_no int, size long, capacity long, part long, bin long, gap int"


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    """Pack one partition (one pack_name, one part)."""
    capacity = int(part["capacity"].iloc[0])
    part = part.iloc[np.lexsort((part["piece_no"], part["doc_id"]))]
    sizes = part["size"].to_numpy(np.int64)
    bins = best_fit_decreasing(sizes, capacity)
    gap = int(bins.max()) + 1 - lower_bound(sizes, capacity)
    return part.assign(bin=bins, gap=gap)[["pack_name", "doc_id", "piece_no", "size", "capacity", "part", "bin", "gap"]]


def pieces(documents: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity, doc_id, piece_no, start, size): whole texts, or full pieces and a rest.

    Null texts have no size and are not packed; empty texts are items of size 0.  Packs with a null or
    non-positive capacity are left out; a pack named twice keeps its smallest capacity.
    """
    sized = documents.filter("text is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(token_size("text")).alias("total"))
    named = packs.filter("capacity_tokens > 0 and pack_name is not null").groupBy("pack_name").agg(F.min("capacity_tokens").cast("long").alias("capacity"))
    listed = named.orderBy("pack_name").limit(MOST_PACKS + 1).collect()
    if len(listed) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    if not listed:
        return sized.limit(0).select(F.lit("").alias("pack_name"), "total").selectExpr("pack_name", "0L capacity", "0L doc_id", "total", "0 piece_no", "0L start", "0L size")
    one = lambda r: F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["capacity"]).cast("long").alias("capacity"))
    each = sized.withColumn("p", F.explode(F.array(*map(one, listed)))).select("p.*", "doc_id", "total")
    last = F.greatest(F.ceil(F.col("total") / F.col("capacity")), F.lit(1)).cast("int") - 1
    return (
        each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("start", F.col("piece_no") * F.col("capacity"))
        .withColumn("size", F.least("capacity", F.col("total") - F.col("start")))
    )


def pack_documents(documents: DataFrame, packs: DataFrame) -> tuple[DataFrame, Scratch]:
    """Every text in containers of every capacity: ``pack_name``, ``doc_id``, ``piece_no``, ``start``,
    ``size``, ``capacity``, ``container`` (unique within a pack), ``certified``: whether the containers of its partition
    are proven fewest, and ``gap``: by how many they may be too many.
    """
    scratch = Scratch(documents.sparkSession, "pack")
    items = scratch.table(pieces(documents, packs).select("pack_name", "doc_id", "piece_no", "start", "size", "capacity", "total"))
    cut = items.filter("size = capacity")
    loose = items.filter("size < capacity")
    rows = loose.groupBy("pack_name").agg(F.count("*").alias("n"))
    parts = F.greatest(F.ceil(F.col("n") / PARTITION_ROWS), F.lit(1))
    placed = loose.join(F.broadcast(rows), "pack_name").withColumn("part", F.pmod(F.xxhash64("doc_id"), parts))  # a row per pack
    packed = scratch.table(placed.select("pack_name", "doc_id", "piece_no", "size", "capacity", "part").groupBy("pack_name", "part").applyInPandas(_pack, PACKED))
    r, saved = 0, True
    while saved:
        r += 1
        open_bins = (
            packed.filter("gap > 0")
            .groupBy("pack_name", "part", "bin")
            .agg(F.sum("size").alias("filled"), F.max("capacity").alias("cap"), F.count("*").alias("rows"))
            .filter(F.col("filled") < WELL_FILLED * F.col("cap"))
        )
        total = open_bins.groupBy("pack_name").agg(F.sum("rows").alias("n"), F.count("*").alias("bins"), F.count_distinct("part").alias("from_parts"))
        total = scratch.table(total)
        if total.isEmpty():
            break
        moved = packed.join(open_bins.select("pack_name", "part", "bin"), ["pack_name", "part", "bin"], "left_semi")
        lot = -F.pmod(F.xxhash64("doc_id", F.lit(r)), F.greatest(F.ceil(F.col("n") / PARTITION_ROWS), F.lit(1))) - 1 - r * F.lit(1 << 40)
        again = moved.join(F.broadcast(total.select("pack_name", "n")), "pack_name").withColumn("part", lot)
        again = scratch.table(again.select("pack_name", "doc_id", "piece_no", "size", "capacity", "part").groupBy("pack_name", "part").applyInPandas(_pack, PACKED))
        after = again.groupBy("pack_name", "part").agg(F.count_distinct("bin").alias("b")).groupBy("pack_name").agg(F.sum("b").alias("after"))
        better = scratch.table(total.join(after, "pack_name").filter("after < bins").select("pack_name", (F.col("after") <= F.col("bins") * (1 - LEAST_SAVED)).alias("much")))
        saved = not better.filter("much").isEmpty()
        better = better.select("pack_name")
        stay = packed.join(open_bins.select("pack_name", "part", "bin").join(better, "pack_name"), ["pack_name", "part", "bin"], "left_anti")
        packed = scratch.table(stay.unionByName(again.join(better, "pack_name", "left_semi")))
    filled = packed.select("pack_name", "doc_id", "piece_no", F.concat_ws("-", F.lit("p"), "part", "bin").alias("container"), "gap", (F.col("gap") <= 0).alias("certified"))
    rest = loose.join(filled, ["pack_name", "doc_id", "piece_no"])
    full = cut.withColumn("container", F.concat_ws("-", F.lit("f"), "doc_id", "piece_no")).withColumn("certified", F.lit(True)).withColumn("gap", F.lit(0))
    columns = ["pack_name", "doc_id", "piece_no", "start", "size", "capacity", "total", "container", "certified", "gap"]
    return full.select(columns).unionByName(rest.select(columns)), scratch


def container_bounds(items: DataFrame) -> DataFrame:
    """(pack_name, documents, size, least_by_size, least_containers): fewest containers that any packing of all texts of
    a pack needs, by size alone and by dual feasible functions: those that round items above ``capacity - e`` up and drop those below ``e``,
    for 32 values of ``e`` up to half the capacity, and the rounding functions u(k) for k = 1..20.

    ``items``: pack_name, doc_id, size, capacity.
    """
    x, c = F.col("size"), F.col("capacity")
    values = []
    for j in range(1, 33):
        e = F.floor(c * j / 64)
        values.append((F.when((x > c - e) & (x >= e), c).when(x >= e, x).otherwise(0), c))
    for k in range(1, 21):
        values.append((F.when((k + 1) * x % c == 0, k * x).otherwise(F.floor((k + 1) * x / c) * c), k * c))
    bounds = F.greatest(F.ceil(F.sum(x) / F.max(c)), *(F.ceil(F.sum(v) / F.max(unit)) for v, unit in values))
    return items.groupBy("pack_name").agg(
        F.count_distinct("doc_id").alias("documents"), F.sum(x).alias("size"), F.ceil(F.sum(x) / F.max(c)).alias("least_by_size"), bounds.alias("least_containers")
    )


def packing_report(packed: DataFrame) -> DataFrame:
    """Per pack: containers, their certified bound over all texts, the share of containers that are proven fewest within their
    partition, and the unused share."""
    boxes = packed.groupBy("pack_name", "container").agg(F.sum("size").alias("size"), F.max("capacity").alias("capacity"), F.bool_and("certified").alias("certified"))
    per = boxes.groupBy("pack_name").agg(
        F.count("*").alias("containers"), F.round(F.avg(F.col("certified").cast("double")), 6).alias("certified_share"), F.round(1 - F.sum("size") / F.sum("capacity"), 6).alias("unused_share")
    )
    return per.join(container_bounds(packed), "pack_name").select(
        "pack_name", "documents", "containers", "least_containers", (F.col("containers") - F.col("least_containers")).alias("gap"), "certified_share", "unused_share"
    )
