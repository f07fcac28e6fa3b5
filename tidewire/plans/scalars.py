"""Scalar functions over article and payload columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, read
from ..operators.stage import spread
from ..functions import hashing, text, times, urls
from ..functions.relevance import INTERNATIONAL_TERMS, PATTERNS, RULES, domestic_relevance, international_relevance, with_deciding_rule
from ..operators import cleaning
from ..operators.history import entry_picks

SHAPE_SQL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_sql(column: str, tracking: tuple[str, ...], mobile: bool, sort: bool, port: bool) -> str:
    """The URL rules in SQL, for queries that need no re-encoding."""
    part = lambda k: f"regexp_extract(trim({column}), '{SHAPE_SQL}', {k})"
    drop = ", ".join(f"'{t}'" for t in tracking)
    host = rf"regexp_replace(regexp_replace(lower(regexp_replace({part(2)}, '^.*@', '')), ':[0-9]*$', ''), '^(?:{'www|m' if mobile else 'www'})\.', '')"
    items = f"list_filter(string_split({part(4)}, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ({drop}))"
    items = f"list_transform({items}, lambda x: case when contains(x, '=') then x else x || '=' end)"
    q = f"array_to_string({f'list_sort({items})' if sort else items}, '&')"
    p = rf"regexp_replace(regexp_replace({part(3)}, ';[^/]*$', ''), '/+$', '')" if not port else rf"regexp_replace({part(3)}, '/+$', '')"
    at = rf"regexp_extract({part(2)}, '(:[0-9]+)$', 1)" if port else "''"
    return f"case when coalesce({part(2)}, '') = '' then '' else lower({part(1)}) || '://' || {host} || {at} || {p} || case when {q} = '' then '' else '?' || {q} end end"


CANONICAL = url_sql("url", urls.DOMESTIC_TRACKING, True, False, False)
MATCHING = url_sql("url", urls.MATCHING_TRACKING, False, True, True)


@query(f"select distinct article_id, url, {CANONICAL} as canonical, {url_sql('url', urls.INTERNATIONAL_TRACKING, True, False, False)} as canonical_intl from articles_master")
def url_canonicalize(spark, d):
    rows = read(spark, d, "articles_master").select("article_id", "url").distinct()
    return rows.select("article_id", "url", urls.canonical_url(F.col("url")).alias("canonical"), urls.canonical_url(F.col("url"), urls.INTERNATIONAL_TRACKING).alias("canonical_intl"))


@query(f"select distinct article_id, url, {MATCHING} as match_key from articles_master")
def url_match_key(spark, d):
    return read(spark, d, "articles_master").select("article_id", "url").distinct().withColumn("match_key", urls.matching_key(F.col("url")))


@query(f"with c as (select distinct url, {CANONICAL} as canonical from articles_master) select url, case when canonical <> '' then substr(sha256(canonical), 1, 16) end as made_id from c")
def url_article_id(spark, d):
    return read(spark, d, "articles_master").select("url").distinct().withColumn("made_id", urls.article_id(urls.canonical_url(F.col("url"))))


@query(r"select lower(regexp_replace(regexp_extract(trim(url), '://([^/?#:@]*)', 1), '^(?i:www)\.', '')) as host, count(*) as rows from articles_master group by 1")
def url_hosts(spark, d):
    return read(spark, d, "articles_master").groupBy(urls.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("rows"))


@query(
    """with dim as (select publisher_domain as host, min(publisher_id) as dim_id, cast(null as varchar) as dim_group, 'VN' as dim_country
                   from articles_clustered where publisher_domain is not null group by 1 having count(*) >= 5)
       select a.article_id, case when d.host is not null then d.dim_id else a.publisher_id end as publisher_id,
              case when d.host is not null then d.dim_group else a.publisher_group_id end as publisher_group_id,
              case when d.host is not null then d.dim_country else a.publisher_country end as publisher_country
       from articles_clustered a left join dim d on a.publisher_domain = d.host"""
)
def publisher_dim_join(spark, d):
    rows = read(spark, d, "articles_clustered").select("article_id", "publisher_domain", "publisher_id", "publisher_group_id", "publisher_country")
    sizes = rows.filter("publisher_domain is not null").groupBy(F.col("publisher_domain").alias("host")).agg(F.min("publisher_id").alias("dim_id"), F.count("*").alias("n"))
    dim = sizes.filter("n >= 5").select("host", "dim_id", F.lit(None).cast("string").alias("dim_group"), F.lit("VN").alias("dim_country"))
    fallback = {c: F.col(c) for c in ("publisher_id", "publisher_group_id", "publisher_country")}
    return cleaning.with_publisher(rows, dim, "publisher_domain", fallback).select("article_id", "publisher_id", "publisher_group_id", "publisher_country")


@query(
    """select item_no, coalesce(nullif(trim(payload.link), ''), 'nourl:' || content_hash) as made_key,
              sha256(coalesce(nullif(trim(payload.link), ''), 'nourl:' || content_hash) || '|' || content_hash) as made_record,
              case when trim(coalesce(payload.link, '')) <> '' then payload.link else source_locator end as candidate
       from incoming_records"""
)
def record_identities(spark, d):
    key = hashing.entry_key(F.col("payload.link"), F.col("content_hash"))
    candidate = hashing.candidate_key(F.col("payload.link"), F.col("source_locator"))
    return read(spark, d, "incoming_records").select("item_no", key.alias("made_key"), hashing.record_id(key, F.col("content_hash")).alias("made_record"), candidate.alias("candidate"))


@query()
def content_hashes(spark, d):
    """Canonical-JSON hash of each payload: key order cannot be stated in SQL, so it is tested in Python."""
    rows = read(spark, d, "payloads")
    return rows.select("raw_record_id", hashing.content_hash(F.to_json("payload")).alias("made_hash"))


@query()
def poll_record_ids(spark, d):
    rows = read(spark, d, "payloads")
    made = hashing.poll_record_id(F.col("source_system"), F.col("source_locator"), F.col("observed_at"), F.to_json("payload"))
    return rows.select("raw_record_id", made.alias("poll_record_id"))


@query(
    """select raw_record_id, nullif(payload.link, '') as link, nullif(payload.title, '') as title, coalesce(nullif(payload.summary, ''), nullif(payload.description, '')) as description,
              coalesce(nullif(payload.published, ''), nullif(payload.pubdate, ''), nullif(payload.updated, '')) as published, nullif(payload.category, '') as category from payloads"""
)
def field_picks(spark, d):
    return read(spark, d, "payloads").select("raw_record_id", *(c.alias(n) for n, c in entry_picks().items()))


@query(
    r"""with t as (select raw_record_id, regexp_replace(trim(coalesce(nullif(payload.published, ''), nullif(payload.pubdate, ''), nullif(payload.updated, ''))), '^[A-Za-z]{3,9},?\s+', '') as s from payloads),
        z as (select raw_record_id, s, coalesce(try_strptime(s, '%d %b %Y %H:%M:%S %z'), case when regexp_matches(s, '\d[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$') then try_cast(s as timestamptz) end) as zoned,
                     coalesce(try_strptime(s, '%d %b %Y %H:%M:%S'), try_strptime(s, '%Y-%m-%dT%H:%M:%S'), try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%d/%m/%Y %H:%M:%S'), try_strptime(s, '%d/%m/%Y %H:%M'), try_strptime(s, '%Y-%m-%d')) as naive from t)
        select raw_record_id, case when zoned is not null then strftime(timezone('UTC', zoned), '%Y-%m-%dT%H:%M:%SZ') when naive is not null then strftime(naive - interval 7 hour, '%Y-%m-%dT%H:%M:%SZ') end as published_at,
               case when zoned is not null then 'publisher_reported' when naive is not null then 'publisher_reported_timezone_inferred' else 'unavailable' end as confidence from z"""
)
def publisher_times(spark, d):
    rows = read(spark, d, "payloads").select("raw_record_id", entry_picks()["published"].alias("p"))
    time, confidence = times.publisher_time(F.col("p"))
    return rows.select("raw_record_id", times.iso_text(time).alias("published_at"), confidence.alias("confidence"))


@query(
    """select article_id, strftime(strptime(strftime(cast(first_seen_at as timestamp), '%Y%m%dT%H%M%SZ'), '%Y%m%dT%H%M%SZ'), '%Y-%m-%dT%H:%M:%SZ') as seen from articles_clustered"""
)
def compact_seen_dates(spark, d):
    compact = F.date_format(times.instant(F.col("first_seen_at")), "yyyyMMdd'T'HHmmss'Z'")
    return read(spark, d, "articles_clustered").select("article_id", times.iso_text(times.compact_seen_date(compact)).alias("seen"))


NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(nfc_normalize(coalesce({c}, ''))), '<[^>]+>', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}\x{{85}}\x{{1C}}-\x{{1F}}]+', ' ', 'g'))"
TITLE, DESCRIPTION = NORMAL.format(c="title"), NORMAL.format(c="description")


@query(f"select article_id, {TITLE} as t, {DESCRIPTION} as d from articles_clustered")
def text_normalize(spark, d):
    return read(spark, d, "articles_clustered").select("article_id", text.normalized(F.col("title")).alias("t"), text.normalized(F.col("description")).alias("d"))


@query(
    f"""with n as (select article_id, {TITLE} as t, {DESCRIPTION} as d from articles_clustered),
        w as (select *, case when d = '' then cast([] as varchar[]) else string_split(d, ' ') end as dw from n)
        select article_id, len(dw) as n_words, len(list_distinct(case when len(dw) < 2 then dw else list_transform(generate_series(1, len(dw) - 1), lambda i: dw[i] || ' ' || dw[i + 1]) end)) as n_pairs,
               array_to_string(list_sort(list_distinct(regexp_extract_all(t || ' ' || d, '\\d+'))), ';') as numbers from w""".replace("\\\\", "\\")
)
def token_stats(spark, d):
    rows = read(spark, d, "articles_clustered").select("article_id", text.normalized(F.col("title")).alias("t"), text.normalized(F.col("description")).alias("d"))
    words = text.tokens(F.col("d"))
    return rows.select(
        "article_id", F.size(words).alias("n_words"), F.size(text.word_pairs(words)).alias("n_pairs"), F.array_join(F.array_sort(text.digit_tokens(F.col("t"), F.col("d"))), ";").alias("numbers")
    )


@query(
    r"""with t as (select article_id, trim(regexp_replace(nfc_normalize(coalesce(title, '')), '[\s\p{Z}\x{85}]+', ' ', 'g')) as t, trim(regexp_replace(nfc_normalize(coalesce(description, '')), '[\s\p{Z}\x{85}]+', ' ', 'g')) as d from articles_clustered)
        select article_id, case when length(d) > 0 then t || '. ' || d else t end as text from t"""
)
def embedding_texts(spark, d):
    return read(spark, d, "articles_clustered").select("article_id", text.embedding_text(F.col("title"), F.col("description")).alias("text"))


@query("select article_id, 384 as dim, 1.0::double as length from articles_clustered where title is not null and trim(title) <> ''")
def text_embeddings(spark, d):
    """Embedding texts through the encoder that needs no model."""
    from ..functions.vectors import dot
    from ..operators.embedding import embedded, hashed_words

    texts = read(spark, d, "articles_clustered").filter("trim(title) <> ''").select("article_id", text.embedding_text(F.col("title"), F.col("description")).alias("text"))
    v = F.col("embedding")
    return embedded(texts, "article_id", "text", hashed_words).select("article_id", F.size(v).alias("dim"), F.round(F.sqrt(dot(v, v)), 5).alias("length"))


@query(
    r"""select raw_record_id, trim(regexp_replace(regexp_replace(coalesce(payload.summary, payload.description, ''), '<[^>]+>', ' ', 'g'), '^\s+|\s+$', '', 'g')) as body from payloads"""
)
def markup_free(spark, d):
    return read(spark, d, "payloads").select("raw_record_id", text.clean_html(F.coalesce("payload.summary", "payload.description")).alias("body"))


@query(
    """select article_id, case when try_cast(published_at as timestamptz) is not null then 'published_at' when try_cast(first_seen_at as timestamptz) is not null then 'first_seen_at' else 'missing' end as time_source,
              strftime(timezone('UTC', coalesce(try_cast(published_at as timestamptz), try_cast(first_seen_at as timestamptz))), '%Y-%m-%dT%H:%M:%SZ') as event_time,
              round(epoch_us(coalesce(try_cast(published_at as timestamptz), try_cast(first_seen_at as timestamptz))) / 86400000000.0, 6) as event_day from articles_clustered"""
)
def effective_times(spark, d):
    rows = read(spark, d, "articles_clustered")
    time, source = times.effective_time(F.col("published_at"), F.col("first_seen_at"))
    return rows.select("article_id", source.alias("time_source"), times.iso_text(time).alias("event_time"), F.round(times.days(time), 6).alias("event_day"))


@query(
    """select case when try_cast(published_at as timestamptz) is not null then 'published_at' when try_cast(first_seen_at as timestamptz) is not null then 'first_seen_at' else 'missing' end as time_source,
              count(*) as rows from articles_master group by 1"""
)
def time_source_counts(spark, d):
    _, source = times.effective_time(F.col("published_at"), F.col("first_seen_at"))
    return read(spark, d, "articles_master").groupBy(source.alias("time_source")).agg(F.count("*").alias("rows"))


def _pattern_sql(name: str) -> str:
    """A pattern for an engine whose word boundary and blanks know ASCII only."""
    p = PATTERNS[name].replace("'", "''").replace(r"\s", r"[\s\p{Z}]").replace(r"\d", "[0-9]")
    out, at = "", 0
    while (k := p.find(r"\b", at)) >= 0:
        before = p[k + 2 : k + 3] not in ("", "|", ")") and (k == 0 or p[k - 1] in "|(+")
        out += p[at:k] + (r"(?:^|[^\p{L}\p{N}_])" if before else r"(?:[^\p{L}\p{N}_]|$)")
        at = k + 2
    return "(?i)" + out + p[at:]


def _rule_sql() -> str:
    cases = []
    for r in RULES:
        has = [f"regexp_matches({r.where}, '{_pattern_sql(p)}')" for p in r.has] + [f"not regexp_matches({r.where}, '{_pattern_sql(p)}')" for p in r.lacks]
        cases.append(f"when {' and '.join(has)} then {r.number}")
    return "case when title = '' then 0 " + " ".join(cases) + " else 18 end"


@query(
    f"""with s as (select distinct article_id, coalesce(title, '') as title, coalesce(description, '') as description, coalesce(url, '') as url from articles_master),
        t as (select *, title || ' ' || description as text from s)
        select article_id, title, description, {_rule_sql()} as rule, {_rule_sql()} not in (0, 9, 13, 14, 15, 16, 17) as relevant from t"""
)
def relevance_cascade(spark, d):
    text_of = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = read(spark, d, "articles_master").select("article_id", text_of("title"), text_of("description"), text_of("url"))
    ruled = with_deciding_rule(spread(rows, *rows.columns).distinct(), "title", "description", "url", "rule")
    return ruled.select("article_id", "title", "description", "rule", domestic_relevance(F.col("rule")).alias("relevant"))


_TERMS = " or ".join(f"contains(t, '{x}')" for x in INTERNATIONAL_TERMS)


@query(f"select doc_id, {_TERMS} as relevant from (select doc_id, lower(coalesce(text, '')) as t from documents)")
def relevance_terms(spark, d):
    return read(spark, d, "documents").select("doc_id", international_relevance(F.lit(None).cast("string"), F.col("text")).alias("relevant"))


@query(
    """select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.none') as missing, props is null or not json_valid(props) as invalid from events"""
)
def json_props(spark, d):
    rows = read(spark, d, "events")
    parsed = F.expr("try_parse_json(props)")
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return rows.select("event_id", get("k").alias("k"), get("none").alias("missing"), parsed.isNull().alias("invalid"))


@query(
    """select run_id, source_locator as feed_url, cast(count(*) as integer) as n_entries, cast(count(*) filter (is_new) as integer) as n_new from sightings
       join (select raw_record_id, min(source_locator) as source_locator from payloads group by 1) p on p.raw_record_id = split_part(payload_ref, '=', -1) group by all"""
)
def feed_result_lines(spark, d):
    """The feed results of each run carried through one printed line and read back."""
    from ..operators.health import feed_result, result_line, results_of

    locators = read(spark, d, "payloads").groupBy("raw_record_id").agg(F.min("source_locator").alias("feed_url"))
    polled = read(spark, d, "sightings").withColumn("raw_record_id", F.substring_index("payload_ref", "=", -1)).join(locators, "raw_record_id")
    feeds = polled.groupBy("run_id", "feed_url").agg(F.count("*").alias("all"), F.count_if("is_new").alias("new"))
    none = F.lit(None).cast("string")
    one = feed_result(F.col("feed_url"), F.col("feed_url"), F.lit(200), none, F.col("all"), F.col("new"), none)
    runs = feeds.groupBy("run_id").agg(F.collect_list(one).alias("results"))  # a run polls a fixed list of feeds
    printed = runs.select("run_id", F.concat(F.lit("start\nFEED_RESULTS []\n"), result_line(F.col("results")), F.lit("\ndone")).alias("stdout"))
    return printed.select("run_id", F.explode(results_of(F.col("stdout"))).alias("r")).select("run_id", "r.feed_url", "r.n_entries", "r.n_new")


@query(
    r"""with m as (select 'New payloads archived : ' || format('{:,}', count(*) filter (is_new)) || chr(10) || 'Entries seen this run : ' || format('{:,}', count(*)) as o, run_id from sightings group by run_id)
        select run_id, cast(replace(regexp_extract(o, 'New payloads archived : ([0-9,]+)', 1), ',', '') as bigint) as new_payloads, cast(replace(regexp_extract(o, 'Entries seen this run : ([0-9,]+)', 1), ',', '') as bigint) as entries_seen from m"""
)
def reported_counts(spark, d):
    from ..operators.health import reported_counts as parse

    n = lambda c: F.format_number(c, 0)
    runs = read(spark, d, "sightings").groupBy("run_id").agg(F.count_if("is_new").alias("new"), F.count("*").alias("all"))
    printed = F.concat(F.lit("New payloads archived : "), n("new"), F.lit("\nEntries seen this run : "), n("all"))
    new, seen = parse(printed)
    return runs.select("run_id", new.alias("new_payloads"), seen.alias("entries_seen"))
