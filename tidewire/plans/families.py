"""Duplicate families of the articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, read
from ..operators import components as comps
from ..operators import dedup
from ..operators.stage import Stage
from .scalars import DESCRIPTION, MATCHING, TITLE

PAIRS_OF = "list_distinct(case when len({w}) < 2 then {w} else list_transform(generate_series(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1]) end)"
FEATS = f"""feats as (
  select *, {PAIRS_OF.format(w='tw')} as tp, {PAIRS_OF.format(w='dw')} as dp, len(dw) as n_words, list_distinct(regexp_extract_all(t || ' ' || d, '[0-9]+')) as numbers
  from (select *, case when t = '' then cast([] as varchar[]) else string_split(t, ' ') end as tw, case when d = '' then cast([] as varchar[]) else string_split(d, ' ') end as dw
        from (select article_id, language, {MATCHING.replace('url', 'canonical_url')} as url_key, {TITLE} as t, {DESCRIPTION} as d, try_cast(published_at as timestamptz) as time from articles_clustered)))"""
HELD = "held as (select article_id, unnest(list_distinct(list_concat(tp, dp))) as pair from feats)"
FREQUENT = "freq as (select pair, count(*) as articles from held group by pair)"
CANDIDATES = """cand as (select x.article_id as a, y.article_id as b, count(*) as shared from held x join held y on x.pair = y.pair and x.article_id < y.article_id
  join freq f on f.pair = x.pair and f.articles between 2 and 60 group by 1, 2 having count(*) >= 2)"""
EXACT = """exact_all as (
  select x.article_id as a, y.article_id as b, 1 as rank, 'identical_normalized_canonical_url' as why from feats x join feats y on x.url_key = y.url_key and x.url_key <> '' and x.article_id < y.article_id
  union all
  select x.article_id, y.article_id, 2, 'identical_normalized_title_and_description' from feats x join feats y on x.t = y.t and x.d = y.d and x.t <> '' and x.d <> '' and x.article_id < y.article_id),
exact as (select a, b, arg_min(why, rank) as exact_reason from exact_all group by a, b)"""
JACCARD = "case when len({x}) = 0 or len({y}) = 0 then 0.0 else len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) end"
SCORED = f"""pairs as (select a, b, exact_reason from exact union all select a, b, null from cand where (a, b) not in (select (a, b) from exact)),
scored as (select p.a, p.b, p.exact_reason, {JACCARD.format(x='x.tp', y='y.tp')} as title_sim, {JACCARD.format(x='x.dp', y='y.dp')} as desc_sim,
  case when len(x.numbers) > 0 and len(y.numbers) > 0 then {JACCARD.format(x='x.numbers', y='y.numbers')} end as number_sim,
  abs(epoch_us(x.time) - epoch_us(y.time)) / 3600000000.0 as hours_apart, least(x.n_words, y.n_words) as words, coalesce(x.language <> y.language, false) as other_language
  from pairs p join feats x on x.article_id = p.a join feats y on y.article_id = p.b),
ruled as (select *, words >= 6 as described, title_sim >= 0.5 as headline, title_sim >= 0.5 or desc_sim >= 0.4 as alike, words >= 6 and desc_sim >= 0.6 as copied from scored),
related as (select a, b, title_sim, desc_sim, number_sim, hours_apart,
  case when exact_reason is not null then 'EXACT_DUPLICATE' when other_language then 'UNRELATED' when copied and (coalesce(hours_apart > 168, false) or coalesce(number_sim < 0.5, false)) then 'SAME_EVENT_INDEPENDENT'
       when copied then 'SYNDICATED_COPY' when alike then 'SAME_EVENT_INDEPENDENT' else 'UNRELATED' end as relation,
  case when exact_reason is not null then exact_reason when other_language then 'language_mismatch (cross-language matching is out of scope)'
       when copied and coalesce(hours_apart > 168, false) then 'copy_evidence_vetoed: published more than a week apart' when copied and coalesce(number_sim < 0.5, false) then 'copy_evidence_vetoed: numeric details conflict'
       when copied then 'description_overlap>=0.6' when alike and not described and headline then 'headline_overlap_but_description_missing_or_short: copy cannot be confirmed'
       when alike then 'headline_or_lede_overlap_without_copy_level_description_match' else 'below_all_similarity_thresholds' end as reason from ruled)"""
ACCEPTED = "acc as (select * from related where relation in ('EXACT_DUPLICATE', 'SYNDICATED_COPY'))"
CLOSURE = """both_ways as (select a, b from acc union select b, a from acc),
reach as (select a as id, b as other from both_ways union select r.id, w.b from reach r join both_ways w on w.a = r.other),
comp as (select id, least(id, min(other)) as component from reach group by id)"""
FAMILIES = """members as (select component, list_sort(list(id)) as ids from comp group by component),
links as (select component, count(*) as edges, bool_and(relation = 'EXACT_DUPLICATE') as all_exact from acc join comp on comp.id = acc.a group by component),
fam as (select component, 'dupfam_' || substr(sha256(array_to_string(ids, '|')), 1, 12) as duplicate_family_id, case when all_exact then 'EXACT_DUPLICATE' else 'SYNDICATED_COPY' end as family_type,
  cast(len(ids) as integer) as family_size, edges / (len(ids) * (len(ids) - 1) / 2.0) as edge_density, array_to_string(ids, ';') as article_ids from members join links using (component)),
found as (select *, case when family_size >= 4 or edge_density < 0.5 then 'review_large_or_sparse' else '' end as flag from fam),
assigned as (select id as article_id, duplicate_family_id from comp join found using (component))"""
TO_PAIRS = f"with {FEATS}, {HELD}, {FREQUENT}, {CANDIDATES}, {EXACT}, {SCORED}"
TO_FAMILIES = f"with recursive {FEATS}, {HELD}, {FREQUENT}, {CANDIDATES}, {EXACT}, {SCORED}, {ACCEPTED}, {CLOSURE}, {FAMILIES}"


def _articles(spark, d):
    return read(spark, d, "articles_clustered")


def _related(spark, d):
    # written once: blocking, exact groups and scoring all read the features
    feats = Stage(spark, "features").write(dedup.features(_articles(spark, d)))
    return feats, dedup.related_pairs(feats)


def _families(spark, d):
    stage = Stage(spark, "families")
    feats = stage.write(dedup.features(_articles(spark, d)))
    related = stage.write(dedup.related_pairs(feats))
    return feats, related, *dedup.families(related)


@query(f"with {FEATS}, {HELD}, {FREQUENT} select pair, articles from freq where articles >= 2")
def word_pair_frequencies(spark, d):
    return dedup.pair_frequencies(dedup.features(_articles(spark, d), hashed=False)).filter("articles >= 2")


@query(f"with {FEATS}, {HELD}, {FREQUENT}, {CANDIDATES} select a, b, shared from cand")
def candidate_pairs(spark, d):
    return dedup.blocked_pairs(dedup.features(_articles(spark, d)))


@query(f"with {FEATS}, {EXACT} select a, b, exact_reason from exact")
def exact_pairs(spark, d):
    return dedup.exact_pairs(dedup.features(_articles(spark, d)))


@query(f"{TO_PAIRS} select a, b, round(title_sim, 6) as title_sim, round(desc_sim, 6) as desc_sim, round(number_sim, 6) as number_sim, round(hours_apart, 6) as hours_apart, relation, reason from related")
def pair_relations(spark, d):
    _, related = _related(spark, d)
    return related.select("a", "b", *(F.round(c, 6).alias(c) for c in ("title_sim", "desc_sim", "number_sim", "hours_apart")), "relation", "reason")


@query(f"{TO_PAIRS} select relation, count(*) as pairs from related group by relation")
def relation_counts(spark, d):
    return _related(spark, d)[1].groupBy("relation").agg(F.count("*").alias("pairs"))


@query(f"{TO_FAMILIES} select duplicate_family_id, family_type, family_size, round(edge_density, 6) as edge_density, flag, article_ids from found")
def dup_families(spark, d):
    found = _families(spark, d)[3]
    return found.withColumn("edge_density", F.round("edge_density", 6))


@query(f"{TO_FAMILIES} select id, component from comp")
def pair_components(spark, d):
    _, related = _related(spark, d)
    return comps.components(dedup.accepted(related))


@query(f"{TO_FAMILIES} select a.article_id, s.duplicate_family_id from articles_clustered a left join assigned s using (article_id)")
def dedup_annotate(spark, d):
    _, _, assignment, _ = _families(spark, d)
    return dedup.annotate(_articles(spark, d), assignment).select("article_id", "duplicate_family_id")


@query(
    f"""{TO_FAMILIES}, lists as (select assigned.duplicate_family_id, array_to_string(list_sort(list(distinct publisher_id) filter (publisher_id is not null)), ';') as publishers, string_agg(title, ' || ' order by article_id) as titles
        from assigned join articles_clustered using (article_id) group by 1)
        select duplicate_family_id, family_type, family_size, publishers, article_ids, titles, round(edge_density, 3) as edge_density, flag from found join lists using (duplicate_family_id)"""
)
def family_summary(spark, d):
    _, _, assignment, found = _families(spark, d)
    return dedup.family_summary(_articles(spark, d), assignment, found)


@query(f"{TO_FAMILIES} select family_size, count(*) as families from found group by family_size")
def family_size_hist(spark, d):
    return _families(spark, d)[3].groupBy("family_size").agg(F.count("*").alias("families"))


@query(
    f"""{TO_FAMILIES} select (select count(*) from articles_clustered) as articles, count(*) as families, cast(coalesce(sum(family_size), 0) as bigint) as members,
        count(*) filter (family_type = 'EXACT_DUPLICATE') as exact, count(*) filter (family_type = 'SYNDICATED_COPY') as syndicated, max(family_size) as largest_size,
        arg_max(duplicate_family_id, (family_size, duplicate_family_id)) as largest_family, (select count(*) from articles_clustered) - cast(coalesce(sum(family_size), 0) as bigint) as singletons from found"""
)
def dedup_run_summary(spark, d):
    return dedup.run_summary(_articles(spark, d), _families(spark, d)[3])


CONTROLS = """first24 as (select article_id, row_number() over (order by sha256(article_id)) - 1 as k from articles_clustered order by k limit 24),
controls as (select k // 2 as lot, min(article_id) as a, max(article_id) as b from first24 group by 1 having count(*) = 2)"""


@query(f"with {CONTROLS} select lot, a, b from controls")
def hash_controls(spark, d):
    return dedup.hash_controls(_articles(spark, d))


@query(
    f"""{TO_FAMILIES}, rejected as (select * from related where relation not in ('EXACT_DUPLICATE', 'SYNDICATED_COPY')),
        picked as (
          select a, b, desc_sim, title_sim, relation, 0 as bucket_no, 0.0 as by_value from acc
          union all (select a, b, desc_sim, title_sim, relation, 1, desc_sim from rejected where desc_sim >= 0.45 and desc_sim < 0.6 or contains(reason, 'vetoed') order by desc_sim desc, a, b limit 15)
          union all (select a, b, desc_sim, title_sim, relation, 2, desc_sim from rejected where relation = 'SAME_EVENT_INDEPENDENT' order by desc_sim desc, a, b limit 10)
          union all (select a, b, desc_sim, title_sim, relation, 3, title_sim from rejected where title_sim >= 0.6 order by title_sim desc, a, b limit 15)
          union all select a, b, desc_sim, title_sim, relation, 5, 0.0 from acc where a in (select article_id from assigned join found using (duplicate_family_id) where flag <> '')),
        once as (select *, row_number() over (partition by a, b order by bucket_no) as k from picked)
        select case bucket_no when 0 then 'POSITIVE_' || relation when 1 then 'REJECTED_BORDERLINE' when 2 then 'PREDICTED_SAME_EVENT_INDEPENDENT' when 3 then 'RECALL_PROBE_HIGH_TITLE_LOW_DESC' else 'SUSPICIOUS_LARGE_FAMILY' end as bucket,
               a as left_article_id, b as right_article_id, round(title_sim, 3) as title_jaccard, round(desc_sim, 3) as desc_jaccard, relation as predicted_relation from once where k = 1"""
)
def dedup_qc_buckets(spark, d):
    """All buckets but the controls, which ``hash_controls`` compares."""
    feats, related, assignment, found = _families(spark, d)
    rows = dedup.qc_buckets(feats, related, assignment, found).filter("bucket <> 'UNRELATED_CONTROL'")
    return rows.select("bucket", "left_article_id", "right_article_id", "title_jaccard", "desc_jaccard", "predicted_relation")


@query()
def dedup_qc_sheet(spark, d):
    """The whole sheet with numbers and notes; the order of equal scores is by id."""
    return dedup.qc_buckets(*_families(spark, d))
