"""Descriptive tables and review sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, read
from ..operators import analysis as A
from ..operators import review as R
from .events import EVENTS


def _articles(spark, d):
    return read(spark, d, "articles_clustered")


def _labels(spark, d):
    return read(spark, d, "table5_qc_manual_labels")


def _sheet(spark, d):
    return read(spark, d, "human_review_flagged_17")


FRAME = """frame as (select event_cluster_id, count(*) as cluster_size, count(distinct publisher_domain) as n_publishers, min(event_time) as first_t, max(event_time) as last_t,
  coalesce(string_agg(distinct publisher_domain, '; ' order by publisher_domain), '') as publishers, array_to_string(list_slice(list(coalesce(title, '') order by event_time nulls last, article_id), 1, 5), ' | ') as sample_titles,
  (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 86400000000.0 as span_days from ev group by 1)"""
ISO = "strftime(timezone('UTC', {c}), '%Y-%m-%dT%H:%M:%SZ')"


@query(f"with {EVENTS}, {FRAME} select event_cluster_id, cluster_size, n_publishers, {ISO.format(c='first_t')} as first_published_at, {ISO.format(c='last_t')} as last_published_at, publishers, sample_titles, round(span_days, 4) as span_days from frame")
def event_frame(spark, d):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    rows = A.event_frame(_articles(spark, d))
    return rows.select("event_cluster_id", "cluster_size", "n_publishers", iso("first_published_at"), iso("last_published_at"), "publishers", "sample_titles", F.round("span_days", 4).alias("span_days"))


@query(
    f"""with {EVENTS}, {FRAME}, c as (select cluster_size as event_size_articles, count(*) as n_events from frame group by 1)
        select event_size_articles, n_events, round(n_events / sum(n_events) over (), 4) as share_of_events, event_size_articles * n_events as n_articles,
               case when event_size_articles = 1 then 'singleton' else 'multi-article' end as event_type from c"""
)
def event_size_hist(spark, d):
    return A.size_table(A.event_frame(_articles(spark, d)))


@query(
    f"""with {EVENTS}, k as (select event_cluster_id, count(*) >= 2 as multi, count(distinct publisher_domain) >= 2 as crosses from ev where publisher_domain is not null group by 1),
        t as (select publisher_domain, count(*) as n_articles, count(distinct event_cluster_id) as n_distinct_events, count(distinct event_cluster_id) filter (multi) as n_multi_article_events,
                     count(distinct event_cluster_id) filter (crosses) as n_cross_publisher_events, count(*) filter (crosses) as articles_in_cross_publisher_events
              from ev join k using (event_cluster_id) where publisher_domain is not null group by 1)
        select cast(row_number() over (order by n_articles desc, publisher_domain) as integer) as rank_by_articles, t.*, round(n_articles / sum(n_articles) over (), 4) as share_of_articles,
               round(articles_in_cross_publisher_events / n_articles, 4) as share_articles_in_cross_publisher_events, round(n_articles / n_distinct_events, 3) as articles_per_event from t"""
)
def publisher_table(spark, d):
    return A.publisher_table(_articles(spark, d))


@query(
    """with n as (select publisher_domain, count(*) as n from articles_clustered where publisher_domain is not null group by 1), s as (select *, n / sum(n) over () as share from n)
       select count(*) as publishers, round(sum(share * share), 6) as hhi, arg_max(publisher_domain, (n, publisher_domain)) as dominant, round(max(share), 6) as dominant_share from s"""
)
def hhi(spark, d):
    return A.concentration(_articles(spark, d))


@query(f"with {EVENTS}, {FRAME} select event_cluster_id, {ISO.format(c='first_t')} as first_published_at, cluster_size, n_publishers, publishers, sample_titles, round(span_days, 2) as span_days from frame where n_publishers >= 2")
def cross_publisher_events(spark, d):
    return A.cross_publisher_events(A.event_frame(_articles(spark, d)))


EDGES = f"""{EVENTS}, by_pub as (select event_cluster_id, publisher_domain, list(distinct unit) as units from ev where publisher_domain is not null group by 1, 2),
per as (select publisher_domain, count(distinct event_cluster_id) as events from ev where publisher_domain is not null group by 1),
edge as (select x.publisher_domain as publisher_a, y.publisher_domain as publisher_b, count(*) as weight_all,
           count(*) filter (len(list_filter(x.units, lambda u: len(list_filter(y.units, lambda w: w <> u)) > 0)) > 0) as weight_independent
         from by_pub x join by_pub y on x.event_cluster_id = y.event_cluster_id and x.publisher_domain < y.publisher_domain group by 1, 2)"""


@query(
    f"""with {EDGES} select e.*, pa.events as events_a, pb.events as events_b, round(weight_independent / least(pa.events, pb.events), 4) as shared_over_smaller_publisher_events
        from edge e join per pa on pa.publisher_domain = publisher_a join per pb on pb.publisher_domain = publisher_b"""
)
def co_report_edges(spark, d):
    return A.co_report_edges(_articles(spark, d))


@query(f"with {EDGES} select (select count(distinct n) from (select publisher_a as n from edge union all select publisher_b from edge)) as nodes, count(*) filter (weight_independent > 0) as edges, max(weight_independent) as max_weight from edge")
def network_figures(spark, d):
    return A.network_figures(A.co_report_edges(_articles(spark, d)))


def _pivot_sql(by: str, extra: str = "") -> str:
    counts = ", ".join(f"count(*) filter (manual_label = '{x}') as \"{x}\"" for x in A.LABELS)
    inside = ", ".join(f"'{x}'" for x in A.LABELS)
    return f"select {by} as \"row\", {counts}, count(*) filter (manual_label in ({inside})) as total{extra} from table5_qc_manual_labels where {by} is not null group by {by}"


@query(_pivot_sql("stratum"))
def label_pivot(spark, d):
    return A.pivot_labels(_labels(spark, d), "stratum")


@query(_pivot_sql("failure_pattern"))
def failure_pivot(spark, d):
    return A.pivot_labels(_labels(spark, d), "failure_pattern")


@query(_pivot_sql("stratum", ", 'stratum' as \"table\"") + " union all " + _pivot_sql("failure_pattern", ", 'failure_pattern' as \"table\""))
def stacked_pivots(spark, d):
    return A.stacked_pivots(_labels(spark, d), ["stratum", "failure_pattern"])


@query("select manual_label as value, count(*) as n from table5_qc_manual_labels group by 1")
def label_counts(spark, d):
    return A.value_counts(_labels(spark, d), "manual_label")


@query(
    """select l.qc_row, manual_label, a.title as left_title, b.title as right_title from table5_qc_manual_labels l left join articles_clustered a on a.article_id = l.left_article_id left join articles_clustered b on b.article_id = l.right_article_id"""
)
def qc_label_titles(spark, d):
    """Labels joined once with the titles of both sides; the article id must be unique."""
    titles = _articles(spark, d).select("article_id", "title")
    labels = _labels(spark, d).select("qc_row", "manual_label", "left_article_id", "right_article_id")
    pairs = A.joined_once(labels.select("qc_row", "manual_label"), labels.select("qc_row", "left_article_id", "right_article_id"), "qc_row")
    named = lambda s: titles.select(F.col("article_id").alias(f"{s}_article_id"), F.col("title").alias(f"{s}_title"))
    return pairs.join(named("left"), "left_article_id", "left").join(named("right"), "right_article_id", "left").select("qc_row", "manual_label", "left_title", "right_title")


@query("select distinct event_cluster_id from articles_clustered where event_cluster_id is not null and event_cluster_id not in (select reference from human_review_flagged_17 where reference is not null)")
def events_without_review(spark, d):
    reviewed = _sheet(spark, d).select(F.col("reference").alias("event_cluster_id"))
    return A.uncovered(_articles(spark, d).filter("event_cluster_id is not null"), reviewed, "event_cluster_id")




@query("select review_id, item_type, reference, stratum_or_event, context, allowed_human_labels, '' as human_label, '' as reviewer, '' as review_comment from human_review_flagged_17")
def blind_sheet(spark, d):
    return R.blind_sheet(_sheet(spark, d))


@query(
    r"""with s as (select distinct review_id, context from human_review_flagged_17) select review_id, 'context' as "column" from s where review_id % 7 = 0 and coalesce(context, '') <> '' group by review_id"""
)
def changed_cells(spark, d):
    """A returned sheet in which every seventh context was blanked, compared with the main one."""
    sheet = _sheet(spark, d)
    returned = sheet.withColumn("context", F.when(F.col("review_id") % 7 == 0, "").otherwise(F.col("context")))
    return R.changed_cells(sheet, returned)


@query(
    """select review_id, unnest(list_filter([case when not coalesce(list_contains(list_transform(string_split(allowed_human_labels, '/'), lambda x: trim(x)), human_label), false) then 'label_not_allowed' end,
              case when trim(coalesce(reviewer, '')) = '' then 'reviewer_empty' end], lambda x: x is not null)) as problem from human_review_flagged_17"""
)
def label_problems(spark, d):
    return R.label_problems(_sheet(spark, d))


FLAGS = "flags as (select review_id, reference, ai_label, second_pass_label, human_label, case when coalesce(human_label, '') = coalesce(ai_label, '') then 'Y' else 'N' end as first_pass_yn, case when coalesce(human_label, '') = coalesce(second_pass_label, '') then 'Y' else 'N' end as second_pass_yn from human_review_flagged_17)"


@query(f"with {FLAGS} select count(*) as n, count(*) filter (first_pass_yn = 'Y') as first_pass, count(*) filter (second_pass_yn = 'Y') as second_pass from flags")
def agreement(spark, d):
    return R.agreement_counts(R.agreement_flags(_sheet(spark, d)))


@query(f"with {FLAGS} select * from flags where first_pass_yn = 'N' or second_pass_yn = 'N'")
def disagreements(spark, d):
    return R.disagreements(R.agreement_flags(_sheet(spark, d)))




def _audit(spark, d):
    return _articles(spark, d).withColumn("rejection_reason", F.lit(None).cast("string"))


@query(
    """with r as (select article_id, raw_payload_ref, sha256('20260920|' || raw_payload_ref) as h, row_number() over (partition by vietnam_relevance order by sha256('20260920|' || raw_payload_ref), raw_payload_ref) as k from articles_clustered)
       select article_id from r order by k > 50, h, raw_payload_ref limit 100"""
)
def review_sample_stratified(spark, d):
    return R.review_sample(_audit(spark, d), 100).select("article_id")


@query(
    """with r as (select article_id, first_seen_at, row_number() over (partition by vietnam_relevance order by first_seen_at, article_id) as k from articles_clustered)
       select article_id from r order by k > 50, first_seen_at, article_id limit 100"""
)
def head_sample(spark, d):
    return R.head_sample(_audit(spark, d), 100, ["first_seen_at", "article_id"]).select("article_id")
