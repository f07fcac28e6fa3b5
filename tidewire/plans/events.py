"""Events: time-gated clustering, summaries, samples.

The stored ``event_cluster_id`` serves as the event where a query is about summaries of events; the
clustering queries compute their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, read
from ..operators import cluster as C
from ..operators.components import components

EVENT_TIME = "coalesce(try_cast(published_at as timestamptz), try_cast(first_seen_at as timestamptz))"
TIMED = f"timed as (select *, {EVENT_TIME} as event_time, epoch_us({EVENT_TIME}) / 86400000000.0 as event_day, coalesce(duplicate_family_id, article_id) as unit from articles_clustered)"
VECTOR = "list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double)))))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
UNITS = f"""raw as (select unit, event_day, cast(embedding as double[]) as e from timed join article_vectors using (article_id) where embedding is not null),
counted as (select unit, count(*) as n, min(event_day) as day, any_value(e) as v from raw group by unit),
cells as (select unit, unnest(e) as x, generate_subscripts(e, 1) as i from raw where unit in (select unit from counted where n > 1)),
means as (select unit, list(x order by i) as v from (select unit, i, avg(x) as x from cells group by 1, 2) group by 1),
plain as (select c.unit, c.day, c.n, coalesce(m.v, c.v) as v from counted c left join means m using (unit)),
lengths as (select *, sqrt({DOT.format(a='v', b='v')}) as len from plain),
units as (select unit, day, n, list_transform(v, lambda x: x / case when len = 0 then 1 else len end) as vector from lengths)"""
NEAR = f"""near as (select x.unit as a, y.unit as b, least(greatest(1 - {DOT.format(a='x.vector', b='y.vector')}, 0), 2) as distance, abs(x.day - y.day) as gap from units x join units y on x.unit < y.unit and abs(x.day - y.day) <= {{w}})"""


def _articles(spark, d):
    return read(spark, d, "articles_clustered")


def _vectors(spark, d):
    return read(spark, d, "article_vectors")


def _units(spark, d):
    return C.units(_articles(spark, d), _vectors(spark, d))


@query(f"with {TIMED}, {UNITS} select unit, round(day, 6) as day, n, round(vector[1], 5) as v1, round(vector[64], 5) as v64 from units")
def unit_collapse(spark, d):
    return _units(spark, d).select("unit", F.round("day", 6).alias("day"), "n", F.round(F.col("vector")[0], 5).alias("v1"), F.round(F.col("vector")[63], 5).alias("v64"))


@query(f"with {TIMED}, {UNITS}, {NEAR.format(w=5)} select a, b, round(distance, 5) as distance from near where distance < 0.3")
def time_gated_pairs(spark, d):
    return C.near_units(_units(spark, d), 0.30, 5.0).select("a", "b", F.round("distance", 5).alias("distance"))


@query(
    f"""with recursive {TIMED}, {UNITS}, {NEAR.format(w=5)}, edge as (select a, b from near where distance < 0.3), both_ways as (select a, b from edge union select b, a from edge),
        reach as (select a as id, b as other from both_ways union select r.id, w.b from reach r join both_ways w on w.a = r.other)
        select id, least(id, min(other)) as component from reach group by id"""
)
def event_components(spark, d):
    return components(C.near_units(_units(spark, d), 0.30, 5.0))


@query()
def event_clusters(spark, d):
    """Complete linkage, 0.30, five days: agglomeration is not expressible in SQL."""
    return C.propagate(_articles(spark, d), C.cluster(_units(spark, d))).select("article_id", "event_cluster_id")


@query()
def event_clusters_average(spark, d):
    return C.propagate(_articles(spark, d), C.cluster(_units(spark, d), 0.30, 5.0, "average")).select("article_id", "event_cluster_id")


@query()
def param_sweep(spark, d):
    """The run figures under each of the 24 settings."""
    return C.sweep(_articles(spark, d), _vectors(spark, d))


@query(
    f"""with {TIMED}, {UNITS}, {NEAR.format(w=10)}, grid as (select t.threshold, w.window_days from (values (0.2::double), (0.25::double), (0.3::double), (0.35::double)) t(threshold), (values (3.0::double), (5.0::double), (10.0::double)) w(window_days))
        select threshold, window_days, count(*) filter (distance < threshold and gap <= window_days) as pairs from near, grid group by 1, 2"""
)
def param_sweep_pairs(spark, d):
    return C.sweep_edges(_units(spark, d), [0.2, 0.25, 0.3, 0.35], [3.0, 5.0, 10.0])


EVENTS = f"{TIMED}, ev as (select * from timed where event_cluster_id is not null)"
SIMILARITY = f"""cellsum as (select event_cluster_id, i, sum(x) as s, count(*) as k from (select event_cluster_id, unnest({VECTOR}) as x, generate_subscripts(embedding, 1) as i from ev join article_vectors using (article_id) where embedding is not null) group by 1, 2),
sim as (select event_cluster_id, (sum(s * s) - max(k)) / (max(k) * (max(k) - 1)) as m from cellsum group by 1 having max(k) > 1)"""
SUMMARY = """summ as (select event_cluster_id, count(*) as cluster_size, count(distinct unit) as n_units, count(distinct publisher_domain) as n_publishers, count(distinct duplicate_family_id) as n_duplicate_families,
  coalesce(strftime(timezone('UTC', min(event_time)), '%Y-%m-%dT%H:%M:%SZ'), '') as first_published_at, coalesce(strftime(timezone('UTC', max(event_time)), '%Y-%m-%dT%H:%M:%SZ'), '') as last_published_at,
  round(max(event_day) - min(event_day), 3) as span_days, coalesce(string_agg(distinct publisher_domain, '; ' order by publisher_domain), '') as publishers,
  coalesce(string_agg(distinct duplicate_family_id, '; ' order by duplicate_family_id), '') as duplicate_families, string_agg(article_id, '; ' order by event_day nulls last, article_id) as article_ids,
  array_to_string(list_slice(list(coalesce(title, '') order by event_day nulls last, article_id), 1, 5), ' | ') as sample_titles from ev group by 1)"""


@query(f"with {EVENTS}, {SIMILARITY}, {SUMMARY} select s.*, round(m, 4) as mean_intra_similarity from summ s left join sim using (event_cluster_id)")
def event_summary(spark, d):
    return C.summaries(_articles(spark, d), _vectors(spark, d))


@query(f"with {EVENTS}, {SIMILARITY} select event_cluster_id, round(m, 5) as mean_intra_similarity from sim")
def event_similarity(spark, d):
    return C.mean_similarity(_articles(spark, d), _vectors(spark, d)).select("event_cluster_id", F.round("mean_intra_similarity", 5).alias("mean_intra_similarity"))


@query(
    f"""with {EVENTS}, {SIMILARITY}, {SUMMARY}, j as (select s.*, round(m, 4) as sm from summ s left join sim using (event_cluster_id))
        select cast(sum(cluster_size) as bigint) as total_articles, count(*) as total_events, count(*) filter (cluster_size = 1) as singleton_events, count(*) filter (cluster_size >= 2) as multi_article_events,
               cast(coalesce(sum(cluster_size) filter (cluster_size >= 2), 0) as bigint) as articles_in_multi_article_events, count(*) filter (n_publishers >= 2) as cross_publisher_events,
               count(*) filter (cluster_size >= 10) as events_ge_10_articles, max(cluster_size) as largest_event_size, arg_max(event_cluster_id, (cluster_size, event_cluster_id)) as largest_event_id,
               round(max(span_days) filter (cluster_size >= 2), 3) as max_span_days, round(avg(span_days) filter (cluster_size >= 2), 3) as mean_span_days_multi,
               round(avg(sm) filter (cluster_size >= 2), 4) as mean_intra_similarity_multi from j"""
)
def event_metrics(spark, d):
    return C.metrics(C.summaries(_articles(spark, d), _vectors(spark, d)))


@query(f"with {EVENTS}, {SUMMARY} select cluster_size, count(*) as events from summ where cluster_size >= 2 group by 1")
def event_size_distribution(spark, d):
    return C.size_distribution(C.summaries(_articles(spark, d), _vectors(spark, d)))


@query(f"with {EVENTS}, {SUMMARY} select event_cluster_id, cluster_size, n_publishers, article_ids from summ where cluster_size >= 2")
def multi_article_events(spark, d):
    return C.summaries(_articles(spark, d), _vectors(spark, d)).filter("cluster_size >= 2").select("event_cluster_id", "cluster_size", "n_publishers", "article_ids")


HELD = f"held as (select article_id, event_cluster_id, publisher_domain, duplicate_family_id, event_day, {VECTOR} as v from ev join article_vectors using (article_id) where embedding is not null)"
PAIR = f"x.article_id as left_article_id, y.article_id as right_article_id, least(greatest(1 - {DOT.format(a='x.v', b='y.v')}, 0), 2) as distance, abs(x.event_day - y.event_day) as gap"
INTRA = f"intra as (select {PAIR}, x.event_cluster_id as ev1 from held x join held y on x.event_cluster_id = y.event_cluster_id and x.article_id < y.article_id and not coalesce(x.duplicate_family_id = y.duplicate_family_id, false))"
INTER = f"inter as (select {PAIR}, least(x.event_cluster_id, y.event_cluster_id) as lo, greatest(x.event_cluster_id, y.event_cluster_id) as hi from held x join held y on x.article_id < y.article_id and x.event_cluster_id <> y.event_cluster_id and abs(x.event_day - y.event_day) <= 5 and not coalesce(x.duplicate_family_id = y.duplicate_family_id, false))"


@query(
    f"""with {EVENTS}, {HELD}, {INTRA}, r as (select *, row_number() over (partition by ev1 order by distance desc, left_article_id, right_article_id) as k from intra)
        select left_article_id, right_article_id, round(distance, 4) as cosine_distance, round(gap, 3) as days_apart from r where k = 1 order by distance desc, left_article_id, right_article_id limit 30"""
)
def weakest_links(spark, d):
    rows = C.weakest_links(C.intra_pairs(_articles(spark, d), _vectors(spark, d)))
    return rows.select("left_article_id", "right_article_id", F.round("distance", 4).alias("cosine_distance"), F.round("gap", 3).alias("days_apart"))


@query(
    f"""with {EVENTS}, {HELD}, {INTER}, r as (select *, row_number() over (partition by lo, hi order by distance, left_article_id, right_article_id) as k from inter where distance < 0.5)
        select left_article_id, right_article_id, round(distance, 4) as cosine_distance, round(gap, 3) as days_apart from r where k = 1 order by distance, left_article_id, right_article_id limit 30"""
)
def nearest_cross_event_pairs(spark, d):
    rows = C.nearest_events(C.inter_pairs(_articles(spark, d), _vectors(spark, d), 5.0, 0.5))
    return rows.select("left_article_id", "right_article_id", F.round("distance", 4).alias("cosine_distance"), F.round("gap", 3).alias("days_apart"))


@query(
    f"""with {EVENTS}, {HELD}, {INTRA}, h as (select *, sha256('42|' || left_article_id || '|' || right_article_id) as h from intra), r as (select *, row_number() over (partition by ev1 order by h) as k from h)
        select left_article_id, right_article_id from r where k <= 2 order by h limit 30"""
)
def sampled_event_pairs(spark, d):
    return C.sampled_pairs(C.intra_pairs(_articles(spark, d), _vectors(spark, d)), "42").select("left_article_id", "right_article_id")


@query()
def event_qc_strata(spark, d):
    """The four strata together; each is compared on its own above."""
    return C.qc_strata(_articles(spark, d), _vectors(spark, d), 5.0)


@query()
def event_qc_counts(spark, d):
    return C.qc_strata(_articles(spark, d), _vectors(spark, d), 5.0).groupBy("stratum").agg(F.count("*").alias("pairs"))
