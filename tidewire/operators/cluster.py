"""Events: units of duplicate families, time-gated agglomerative clustering, propagation, summaries.

Two units can only end in one cluster through pairs closer than the threshold and inside the time
window, so clusters never cross the components of that pair graph.  Pairs come from matrix products of blocks of
neighbouring time buckets; each component is clustered on its own, which gives exactly the clusters of the whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import event_id
from ..functions.times import days, effective_time
from ..functions.vectors import cosine_distance, unit
from .components import components
from .stage import Stage

GATED = 2.0
LINKAGES = ("average", "complete")
#: Units of a block, of which a task holds two (some 200 MB), and units of one component beyond which clustering it is an error:
#: its distances are held by one task (800 MB).
BLOCK, MOST_UNITS = 65_536, 10_000
#: Vectors multiplied at a time, near pairs of them from which all their distances are taken again exactly, and units that the sweep clusters in one call.
TILE, DENSE, LOT = (512, 2_048), 65_536, 4_096
#: The grid of the sweep and its row of the setting used before.
THRESHOLDS, WINDOWS = (0.20, 0.25, 0.30, 0.35), (3.0, 5.0, 10.0)
BASELINE = (0.35, 10.0, "average")
#: Columns of a cluster of the sweep: publishers are 1 or 2 (several), ``square`` is of the sum of its ``k`` unit vectors.
EVENT = ["bits", "cluster_size", "n_publishers", "first", "last", "square", "k"]


def with_event_time(articles: DataFrame) -> DataFrame:
    """Articles with ``event_time`` (timestamp), ``event_day`` (days since the epoch) and ``time_source``."""
    time, source = effective_time(F.col("published_at"), F.col("first_seen_at"))
    return articles.withColumn("event_time", time).withColumn("event_day", days(time)).withColumn("time_source", source)


def unit_key() -> Column:
    return F.coalesce("duplicate_family_id", "article_id")


def units(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per unit: a duplicate family or a single article, with its earliest day and the unit mean
    of its members' vectors.  Articles without a vector are in no unit."""
    timed = with_event_time(articles).select("article_id", unit_key().alias("unit"), "event_day")
    held = timed.join(vectors.filter("embedding is not null").select("article_id", "embedding"), "article_id")
    single = held.groupBy("unit").agg(F.count("*").alias("n"), F.min("event_day").alias("day"), F.first("embedding").alias("v"))
    alone = single.filter("n = 1").select("unit", "day", "n", unit(F.col("v")).alias("vector"))
    several = single.filter("n > 1").select("unit", "day", "n")
    cells = held.join(several.select("unit"), "unit").select("unit", F.posexplode("embedding").alias("d", "x"))
    mean = cells.groupBy("unit", "d").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("unit")
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return alone.unionByName(several.join(mean, "unit").select("unit", "day", "n", unit(F.col("v")).alias("vector")))


def block_pairs(found: DataFrame, window_days: float) -> DataFrame:
    """``found`` once for every pair of blocks that it is in: ``k``, ``p``, ``ahead``, ``q`` (block p of time bucket k meets
    block q of the bucket ``ahead`` of it) and ``side`` (0: of the first block).

    A bucket is divided into blocks of at most about BLOCK units, so its size does not bound a task.  A block meets itself where it
    meets the first block of the next bucket, and on its own only if there is none.
    """
    keyed = found.filter("day is not null").withColumn("k", F.floor(F.col("day") / window_days))
    sizes = keyed.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))  # a row per stretch of the window
    around = sizes.join(sizes.select((F.col("k") - 1).alias("k"), F.col("m").alias("after")), "k", "left").join(sizes.select((F.col("k") + 1).alias("k"), F.col("m").alias("before")), "k", "left")
    placed = keyed.join(around, "k").withColumn("own", F.pmod(F.xxhash64("unit"), F.col("m")).cast("int"))

    def met(blocks: Column, k: Column, first: bool, ahead: int) -> Column:
        p, q = (lambda x: F.col("own")), (lambda x: x)
        p, q = (p, q) if first else (q, p)
        return F.transform(blocks, lambda x: F.struct(k.alias("k"), p(x).cast("int").alias("p"), F.lit(ahead).alias("ahead"), q(x).cast("int").alias("q"), F.lit(0 if first else 1).alias("side")))

    to = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    places = F.concat(
        met(F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda x: (x > F.col("own")) | (x == F.col("own")) & F.col("after").isNull()), F.col("k"), True, 0),
        met(to(F.col("own")), F.col("k"), False, 0),
        met(to(F.col("after")), F.col("k"), True, 1),
        met(to(F.col("before")), F.col("k") - 1, False, 1),
    )
    return placed.select(F.explode(places).alias("at"), "unit", "day", "vector").select("at.*", "unit", "day", "vector")


def near_units(found: DataFrame, threshold: float, window_days: float) -> DataFrame:
    """Pairs (a < b, distance, gap) of units closer than ``threshold`` whose days are at most ``window_days`` apart.

    Units of unknown time are near nothing.  Products in single precision leave out what is surely too far; the distances of the rest
    are in double precision.
    """

    def near(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("day")
        side, day, names = table.column("side").to_numpy(), table.column("day").to_numpy(), table.column("unit").combine_chunks()
        x = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(names), -1)
        rough, least = x.astype(np.float32), 1.0 - threshold - 2e-7 * (x.shape[1] + 8)
        p, ahead, q = (table.column(c)[0].as_py() for c in ("p", "ahead", "q"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        meetings = [(left, left)] if ahead == 0 and p == q else [(left, right), (left, left)] if ahead == 1 and q == 0 else [(left, right)]
        found_i, found_j, found_d = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
        for rows, columns in meetings:
            for at in range(0, len(rows), TILE[0]):
                i = rows[at : at + TILE[0]]
                low = at if rows is columns else np.searchsorted(day[columns], day[i[0]] - window_days - 1e-6)
                high = np.searchsorted(day[columns], day[i[-1]] + window_days + 1e-6, "right")
                for start in range(low, high, TILE[1]):
                    j = columns[start : min(start + TILE[1], high)]
                    u, v = np.divmod(np.flatnonzero(rough[i] @ rough[j].T > least), len(j))
                    if len(u) > DENSE:
                        distance = np.clip(1.0 - x[i] @ x[j].T, 0.0, 2.0)
                        u, v = np.nonzero(distance < threshold)
                        distance = distance[u, v]
                    else:
                        distance = np.clip(1.0 - np.einsum("nd,nd->n", x[i[u]], x[j[v]]), 0.0, 2.0)
                    u, v = i[u], j[v]
                    kept = (distance < threshold) & (np.abs(day[u] - day[v]) <= window_days)
                    if rows is columns:
                        kept &= u < v
                    found_i.append(u[kept]), found_j.append(v[kept]), found_d.append(distance[kept])
        i, j, distance = map(np.concatenate, (found_i, found_j, found_d))
        u, v = names.take(pa.array(i)), names.take(pa.array(j))
        swap = pc.greater(u, v)
        return pa.table([pc.if_else(swap, v, u), pc.if_else(swap, u, v), pa.array(distance), pa.array(np.abs(day[i] - day[j]))], ["a", "b", "distance", "gap"])

    return block_pairs(found, window_days).groupBy("k", "p", "ahead", "q").applyInArrow(near, "a string, b string, distance double, gap double")


def agglomerate(vectors: np.ndarray, times: np.ndarray, threshold: float, window_days: float, linkage: str) -> np.ndarray:
    """Labels of one component: the closest two clusters merge while their distance is below the threshold."""
    return agglomerations(gated(vectors, times, window_days), (threshold,), linkage)[0]


def gated(vectors: np.ndarray, times: np.ndarray, window_days: float) -> np.ndarray:
    """Distances of one component's units; those too far apart in time have GATED."""
    if len(vectors) > MOST_UNITS:
        raise ValueError(f"{len(vectors)} units hang together, more than {MOST_UNITS}: use a smaller threshold or window")
    x = np.asarray(vectors, np.float64)
    distance = np.clip(1.0 - x @ x.T, 0.0, 2.0)
    distance[~(np.abs(times[:, None] - times[None, :]) <= window_days)] = GATED
    np.fill_diagonal(distance, np.inf)
    return distance


def agglomerations(distance: np.ndarray, thresholds: tuple[float, ...], linkage: str) -> list[np.ndarray]:
    """Labels under each of the ascending thresholds, from one run: up to where it stops, a run is the same under a larger one.
    ``distance`` is written over.

    Each row's nearest is kept, so a merge costs a row and the rows whose nearest it was.
    """
    label, size = np.arange(len(distance)), np.ones(len(distance))
    nearest = distance.argmin(1)
    least = distance[np.arange(len(distance)), nearest]
    labels: list[np.ndarray] = []
    while True:
        i = int(least.argmin())
        while len(labels) < len(thresholds) and not least[i] < thresholds[len(labels)]:
            labels.append(label.copy())
        if len(labels) == len(thresholds):
            return labels
        i, j = sorted((i, int(nearest[i])))
        joined = np.maximum(distance[i], distance[j]) if linkage == "complete" else (size[i] * distance[i] + size[j] * distance[j]) / (size[i] + size[j])
        distance[i], distance[:, i] = joined, joined
        distance[i, i] = np.inf
        distance[j], distance[:, j] = np.inf, np.inf
        label[label == j] = i
        size[i] += size[j]
        # a joined distance is never below both of its parts, so no other row gets a nearer one; an equal one counts if it stands first
        tied = (distance[:, i] == least) & (i < nearest)
        nearest[tied] = i
        stale = np.flatnonzero((nearest == i) & ~tied | (nearest == j))
        stale = np.union1d(stale, [i, j])
        nearest[stale] = distance[stale].argmin(1)
        least[stale] = distance[stale, nearest[stale]]


def swept(vectors: np.ndarray, times: np.ndarray, thresholds: tuple[float, ...], windows: tuple[float, ...], linkages: tuple[str, ...]) -> list[tuple[np.ndarray, int]]:
    """The different clusters (places of their units) of one component under all settings, each with the sum of the bits of its settings.

    Settings are numbered by threshold, window and linkage; thresholds ascend.
    """
    every = (1 << len(thresholds) * len(windows) * len(linkages)) - 1
    gap = np.abs(times[:, None] - times[None, :])
    widest, base = gap.max(), gated(vectors, times, np.inf)
    if widest <= min(windows) and base[~np.eye(len(base), dtype=bool)].max() < thresholds[0]:
        return [(np.arange(len(base)), every)]
    ways: dict[bytes, int] = {}
    done: dict[tuple[float, str], list[np.ndarray]] = {}
    for w, window in enumerate(windows):
        for k, linkage in enumerate(linkages):
            same = (min(window, widest), linkage)
            if same not in done:
                distance = base.copy()
                distance[~(gap <= window)] = GATED
                np.fill_diagonal(distance, np.inf)
                done[same] = agglomerations(distance, thresholds, linkage)
            for t, label in enumerate(done[same]):
                key = label.tobytes()
                ways[key] = ways.get(key, 0) | 1 << (t * len(windows) + w) * len(linkages) + k
    clusters: dict[bytes, int] = {}
    for key, bits in ways.items():
        label = np.frombuffer(key, int)
        for root in np.unique(label):
            members = np.flatnonzero(label == root).tobytes()
            clusters[members] = clusters.get(members, 0) | bits
    return [(np.frombuffer(members, int), bits) for members, bits in clusters.items()]


def cluster(found: DataFrame, threshold: float = 0.30, window_days: float = 5.0, linkage: str = "complete") -> DataFrame:
    """(unit, cluster): the cluster is named by its smallest unit; every unit is in one."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}, got {linkage!r}")
    stage = Stage(found.sparkSession, "events")
    found = stage.write(found)
    parts = components(near_units(found, threshold, window_days).select("a", "b"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("unit", ignore_index=True)
        label = agglomerate(np.stack(part["vector"]), part["day"].to_numpy(float), threshold, window_days, linkage)
        return pd.DataFrame({"unit": part["unit"], "cluster": part["unit"].to_numpy()[label]})

    inside = found.join(parts.select(F.col("id").alias("unit"), "component"), "unit").select("unit", "day", "vector", "component")
    clustered = inside.groupBy("component").applyInPandas(one, "unit string, cluster string")
    return found.select("unit").join(clustered, "unit", "left").select("unit", F.coalesce("cluster", "unit").alias("cluster"))


def propagate(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Articles with ``event_cluster_id``: the hash of the cluster's earliest article (unknown time last, then
    id).  An article whose unit has no cluster is its own event."""
    timed = with_event_time(articles.drop("event_cluster_id")).withColumn("_unit", unit_key())
    placed = timed.join(clusters.withColumnRenamed("unit", "_unit"), "_unit", "left").withColumn("_c", F.coalesce("cluster", "_unit"))
    anchors = placed.groupBy("_c").agg(event_id(F.min_by("article_id", F.struct(F.col("event_day").isNull(), "event_day", "article_id"))).alias("event_cluster_id"))
    return placed.join(anchors, "_c").select(*[c for c in articles.columns if c != "event_cluster_id"], "event_cluster_id")


def event_rows(articles: DataFrame) -> DataFrame:
    return with_event_time(articles).withColumn("unit", unit_key()).filter("event_cluster_id is not null")


def mean_similarity(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean cosine over the pairs inside each event, from the sum of its unit vectors: no pairs are made."""
    held = articles.select("article_id", "event_cluster_id").filter("event_cluster_id is not null").join(vectors.filter("embedding is not null"), "article_id")
    cells = held.select("event_cluster_id", F.posexplode(unit(F.col("embedding"))).alias("d", "x"))
    sums = cells.groupBy("event_cluster_id", "d").agg(F.sum("x").alias("s"), F.count("*").alias("k"))
    total = sums.groupBy("event_cluster_id").agg(F.sum(F.col("s") * F.col("s")).alias("t"), F.max("k").alias("k")).filter("k > 1")
    return total.select("event_cluster_id", ((F.col("t") - F.col("k")) / (F.col("k") * (F.col("k") - 1))).alias("mean_intra_similarity"))


def summaries(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per event, singletons too: sizes, times, span, similarity, members and first titles."""
    rows = event_rows(articles)
    order = F.struct(F.col("event_day").isNull().alias("u"), F.col("event_day").alias("t"), F.col("article_id").alias("i"), F.coalesce("title", F.lit("")).alias("x"))
    members = F.array_sort(F.collect_list(order))
    listed = rows.groupBy("event_cluster_id").agg(
        F.count("*").alias("cluster_size"),
        F.count_distinct("unit").alias("n_units"),
        F.count_distinct("publisher_domain").alias("n_publishers"),
        F.count_distinct("duplicate_family_id").alias("n_duplicate_families"),
        F.min("event_time").alias("_first"),
        F.max("event_time").alias("_last"),
        F.array_join(F.array_sort(F.collect_set("publisher_domain")), "; ").alias("publishers"),
        F.array_join(F.array_sort(F.collect_set("duplicate_family_id")), "; ").alias("duplicate_families"),
        members.alias("_m"),
    )
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return listed.join(mean_similarity(articles, vectors), "event_cluster_id", "left").select(
        "event_cluster_id", "cluster_size", "n_units", "n_publishers", "n_duplicate_families", iso("_first").alias("first_published_at"), iso("_last").alias("last_published_at"),
        F.round(days(F.col("_last")) - days(F.col("_first")), 3).alias("span_days"), F.round("mean_intra_similarity", 4).alias("mean_intra_similarity"), "publishers", "duplicate_families",
        F.array_join(F.transform("_m", lambda s: s["i"]), "; ").alias("article_ids"), F.array_join(F.transform(F.slice("_m", 1, 5), lambda s: s["x"]), " | ").alias("sample_titles"),
    )


def metrics(summary: DataFrame, *by: str) -> DataFrame:
    """Run figures, from the summary so that they always agree with it; one row for each value of ``by``."""
    size, multi = F.col("cluster_size"), F.col("cluster_size") >= 2
    return summary.groupBy(*by).agg(
        F.sum(size).alias("total_articles"), F.count("*").alias("total_events"), F.count_if(size == 1).alias("singleton_events"), F.count_if(multi).alias("multi_article_events"),
        F.coalesce(F.sum(F.when(multi, size)), F.lit(0)).alias("articles_in_multi_article_events"), F.count_if(F.col("n_publishers") >= 2).alias("cross_publisher_events"),
        F.count_if(size >= 10).alias("events_ge_10_articles"), F.max(size).alias("largest_event_size"),
        F.max_by("event_cluster_id", F.struct(size, F.col("event_cluster_id"))).alias("largest_event_id"),
        F.round(F.max(F.when(multi, F.col("span_days"))), 3).alias("max_span_days"), F.round(F.avg(F.when(multi, F.col("span_days"))), 3).alias("mean_span_days_multi"),
        F.round(F.avg(F.when(multi, F.col("mean_intra_similarity"))), 4).alias("mean_intra_similarity_multi"),
    )


def size_distribution(summary: DataFrame) -> DataFrame:
    return summary.filter("cluster_size >= 2").groupBy("cluster_size").agg(F.count("*").alias("events"))


def sweep(articles: DataFrame, vectors: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, windows: tuple[float, ...] = WINDOWS, linkages: tuple[str, ...] = LINKAGES) -> DataFrame:
    """The run figures of each setting, all from one join and the components at the loosest.

    A component is clustered under all settings at once, and what a cluster's figures need comes from sums of its units: each
    different cluster is one row with a bit for each of its settings, and so is a unit that is near no other.
    """
    thresholds, spark = tuple(sorted(thresholds)), articles.sparkSession
    grid = [(1 << n, *x) for n, x in enumerate((t, w, k) for t in thresholds for w in windows for k in linkages)]
    if len(grid) > 62:
        raise ValueError(f"{len(grid)} settings, more than the 62 bits that mark them")
    settings = F.broadcast(spark.createDataFrame(grid, "bit long, distance_threshold double, window_days double, linkage string"))  # the grid is a parameter
    stage = Stage(spark, "sweep")
    found = stage.write(units(articles, vectors))
    timed = with_event_time(articles).withColumn("unit", unit_key())
    facts = timed.groupBy("unit").agg(
        F.count("*").alias("articles"), F.min("publisher_domain").alias("low"), F.max("publisher_domain").alias("high"),
        F.unix_micros(F.min("event_time")).alias("first"), F.unix_micros(F.max("event_time")).alias("last"),
    )
    # as in mean_similarity; the sum of a unit of one vector is that vector
    cells = timed.select("article_id", "unit").join(found.filter("n > 1").select("unit"), "unit").join(vectors.filter("embedding is not null"), "article_id").select("unit", F.posexplode(unit(F.col("embedding"))).alias("d", "x"))
    sums = cells.groupBy("unit", "d").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("s"), F.count("*").alias("vectors")).groupBy("unit")
    sums = sums.agg(F.max("vectors").alias("vectors"), F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda c: c["s"]).alias("sums"))
    facts = stage.write(facts.join(sums, "unit", "left"))
    parts = components(stage.write(near_units(found, max(thresholds), max(windows)).select("a", "b"))).select(F.col("id").alias("unit"), "component")

    def lot(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("component", "ascending"), ("unit", "ascending")])
        wide = lambda c, rows: table.column(c).combine_chunks().take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        x, day = wide("vector", np.arange(len(table))), table.column("day").to_numpy()
        total, several = x.copy(), np.flatnonzero(table.column("vectors").is_valid().to_numpy())
        if len(several):
            total[several] = wide("sums", several)
        count = lambda c, null: table.column(c).fill_null(null).to_numpy()
        lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        names = pc.unique(pa.chunked_array(table.column("low").chunks + table.column("high").chunks, pa.string())).drop_null().sort()
        place = lambda c, null: pc.index_in(table.column(c), names).fill_null(null).to_numpy()
        component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.diff(component, prepend=-1, append=-1))
        clusters = [(a + members, bits) for a, b in zip(edges, edges[1:]) for members, bits in swept(x[a:b], day[a:b], thresholds, windows, linkages)]
        at, starts = np.concatenate([m for m, _ in clusters]), np.cumsum([0] + [len(m) for m, _ in clusters[:-1]])
        of = lambda how, values: how.reduceat(values[at], starts)
        k, first, last = of(np.add, count("vectors", 1)), of(np.minimum, count("first", highest)), of(np.maximum, count("last", lowest))
        low, high, square = of(np.minimum, place("low", len(names))), of(np.maximum, place("high", -1)), (np.add.reduceat(total[at], starts) ** 2).sum(1)
        unknown = first > last
        columns = [pa.array([b for _, b in clusters]), pa.array(of(np.add, count("articles", 0))), pa.array(np.where(low < high, 2, 1)), pa.array(first, mask=unknown), pa.array(last, mask=unknown), pa.array(square), pa.array(k)]
        return pa.table([c.cast(pa.float64() if n == "square" else pa.int64()) for n, c in zip(EVENT, columns)], EVENT)

    inside = found.join(parts, "unit").join(facts, "unit").withColumn("lot", F.pmod(F.xxhash64("component"), F.lit(1 + parts.count() // LOT)))
    met = inside.groupBy("lot").applyInArrow(lot, ", ".join(f"{c} {'double' if c == 'square' else 'long'}" for c in EVENT))
    square = F.aggregate("sums", F.lit(0.0), lambda a, c: a + c * c)
    alone = facts.join(parts, "unit", "left_anti").select(F.lit((1 << len(grid)) - 1).cast("long").alias("bits"), F.col("articles").alias("cluster_size"), F.when(F.col("low") < F.col("high"), 2).otherwise(1).cast("long").alias("n_publishers"), "first", "last", square.alias("square"), F.col("vectors").alias("k"))
    day_of = lambda c: F.col(c) / F.lit(86_400_000_000.0)
    similarity = F.when(F.col("k") > 1, (F.col("square") - F.col("k")) / (F.col("k") * (F.col("k") - 1)))
    events = met.unionByName(alone).withColumn("span_days", F.round(day_of("last") - day_of("first"), 3)).withColumn("mean_intra_similarity", F.round(similarity, 4))
    summary = events.withColumn("event_cluster_id", F.lit("")).crossJoin(settings.select("bit")).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    figures = metrics(summary, "bit").join(settings, "bit")
    share = 1 - F.col("articles_in_multi_article_events") / F.col("total_articles")
    previous = F.struct("distance_threshold", "window_days", "linkage") == F.struct(*map(F.lit, BASELINE))
    return figures.select(
        "distance_threshold", "window_days", "linkage", previous.alias("is_previous_baseline"), "total_events", "multi_article_events", "singleton_events",
        F.round(share, 4).alias("singleton_article_share"), "articles_in_multi_article_events", "cross_publisher_events", "events_ge_10_articles", "largest_event_size",
        "max_span_days", "mean_span_days_multi", "mean_intra_similarity_multi",
    )


def sweep_edges(found: DataFrame, thresholds: list[float], windows: list[float]) -> DataFrame:
    """Near pairs for each setting, all from one join at the loosest."""
    spark = found.sparkSession
    gaps = near_units(found, max(thresholds), max(windows))
    grid = spark.createDataFrame([(t, w) for t in thresholds for w in windows], "threshold double, window_days double")
    met = gaps.select("distance", "gap").crossJoin(F.broadcast(grid))  # the grid is a parameter
    held = (F.col("distance") < F.col("threshold")) & (F.col("gap") <= F.col("window_days"))
    return met.groupBy("threshold", "window_days").agg(F.count_if(held).alias("pairs"))


def intra_pairs(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs inside an event and not of one duplicate family, with distance and days apart."""
    held = event_rows(articles).join(vectors.filter("embedding is not null"), "article_id")
    held = held.select("article_id", "event_cluster_id", "publisher_domain", "duplicate_family_id", "event_day", unit(F.col("embedding")).alias("v"))
    a, b = held.alias("a"), held.alias("b")
    met = a.join(b, F.expr("a.event_cluster_id = b.event_cluster_id and a.article_id < b.article_id")).filter(~F.coalesce(F.expr("a.duplicate_family_id = b.duplicate_family_id"), F.lit(False)))
    return _pair_columns(met)


def inter_pairs(articles: DataFrame, vectors: DataFrame, window_days: float, within: float) -> DataFrame:
    """Pairs of different events and families within the time window and closer than ``within``."""
    held = event_rows(articles).join(vectors.filter("embedding is not null"), "article_id").filter("event_day is not null")
    near = near_units(held.select(F.col("article_id").alias("unit"), F.col("event_day").alias("day"), unit(F.col("embedding")).alias("vector")), within, window_days)
    side = lambda s: held.select(F.col("article_id").alias(s), F.struct("event_cluster_id", "duplicate_family_id", "publisher_domain").alias(f"f{s}"))
    met = near.join(side("a"), "a").join(side("b"), "b").filter((F.col("fa.event_cluster_id") != F.col("fb.event_cluster_id")) & ~F.coalesce(F.expr("fa.duplicate_family_id = fb.duplicate_family_id"), F.lit(False)))
    return met.select(
        F.col("a").alias("left_article_id"), F.col("b").alias("right_article_id"), F.col("fa.publisher_domain").alias("left_publisher"), F.col("fb.publisher_domain").alias("right_publisher"),
        F.col("fa.event_cluster_id").alias("left_event_cluster_id"), F.col("fb.event_cluster_id").alias("right_event_cluster_id"), "distance", "gap",
    )


def _pair_columns(met: DataFrame) -> DataFrame:
    first = F.col("a.article_id") < F.col("b.article_id")
    pick = lambda c, x: F.when(first == x, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    return met.select(
        pick("article_id", True).alias("left_article_id"), pick("article_id", False).alias("right_article_id"), pick("publisher_domain", True).alias("left_publisher"),
        pick("publisher_domain", False).alias("right_publisher"), pick("event_cluster_id", True).alias("left_event_cluster_id"), pick("event_cluster_id", False).alias("right_event_cluster_id"),
        cosine_distance(F.col("a.v"), F.col("b.v")).alias("distance"), F.abs(F.col("a.event_day") - F.col("b.event_day")).alias("gap"),
    )


def weakest_links(intra: DataFrame, most: int = 30) -> DataFrame:
    """The least similar pair of each event, worst events first."""
    w = Window.partitionBy("left_event_cluster_id").orderBy(F.desc("distance"), "left_article_id", "right_article_id")
    worst = intra.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    return worst.orderBy(F.desc("distance"), "left_article_id", "right_article_id").limit(most)


def nearest_events(inter: DataFrame, most: int = 30) -> DataFrame:
    """The closest pair of each two events, closest first."""
    keyed = inter.withColumn("_lo", F.least("left_event_cluster_id", "right_event_cluster_id")).withColumn("_hi", F.greatest("left_event_cluster_id", "right_event_cluster_id"))
    w = Window.partitionBy("_lo", "_hi").orderBy("distance", "left_article_id", "right_article_id")
    best = keyed.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_lo", "_hi")
    return best.orderBy("distance", "left_article_id", "right_article_id").limit(most)


def sampled_pairs(intra: DataFrame, seed: str, most: int = 30, per_event: int = 2) -> DataFrame:
    """A fixed random sample in the order of a seeded hash, at most ``per_event`` pairs of one event."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), "left_article_id", "right_article_id"), 256)
    w = Window.partitionBy("left_event_cluster_id").orderBy("h")
    spread = intra.withColumn("h", h).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_event)
    return spread.orderBy("h").limit(most).drop("_k", "h")


def qc_strata(articles: DataFrame, vectors: DataFrame, window_days: float, within: float = 0.5, most: int = 30, seed: str = "42") -> DataFrame:
    """The four strata of pairs for manual labelling; a pair is in the first stratum that takes it."""
    stage = Stage(articles.sparkSession, "strata")
    intra = stage.write(intra_pairs(articles, vectors))
    keys = ["left_article_id", "right_article_id"]
    weak = stage.write(weakest_links(intra, most))
    rest = intra.join(weak.select(*keys), keys, "left_anti")
    other = F.coalesce(F.col("left_publisher") != F.col("right_publisher"), F.lit(True))
    picked = [
        ("INTRA_CLUSTER_WEAKEST_LINK", weak),
        ("INTRA_CLUSTER_CROSS_PUB", sampled_pairs(rest.filter(other), seed, most)),
        ("INTRA_CLUSTER_SAME_PUB", sampled_pairs(rest.filter(~other), seed, most)),
        ("INTER_CLUSTER_NEAR", nearest_events(inter_pairs(articles, vectors, window_days, within), most)),
    ]
    rows = None
    for name, part in picked:
        one = part.select(F.lit(name).alias("stratum"), *keys, "left_publisher", "right_publisher", "left_event_cluster_id", "right_event_cluster_id", F.round("distance", 4).alias("cosine_distance"), F.round("gap", 3).alias("days_apart"))
        rows = one if rows is None else rows.unionByName(one)
    texts = lambda s: articles.select(F.col("article_id").alias(f"{s}_article_id"), F.col("title").alias(f"{s}_title"), F.coalesce("description", F.lit("")).alias(f"{s}_description"))
    return rows.join(texts("left"), "left_article_id").join(texts("right"), "right_article_id").withColumn("manual_label", F.lit("")).withColumn("review_notes", F.lit(""))
