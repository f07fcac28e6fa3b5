"""SQL that computes the rows of pN_ queries by plain comparison of everything with everything.

Left out where SQL cannot say it: consensus (p7), languages (p10), the packing and the mix themselves.
"""

from __future__ import annotations

# What the publishers' systems write for plain letters, as found in the tables; kept apart from the library's own list.
_WIDE = "".join(chr(0xFF01 + k) for k in range(94))
_FROM = "АВЕЅІЈКМНОРСТХаеѕіјорсухһԛԝԁӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονÐƉ\u2010\u2011" + _WIDE
_TO = ("ABESIJKMHOPCTXaesijopcyxhqwdlABEZHIKMNOPTYXovĐĐ--" + "".join(chr(0x21 + k) for k in range(94))).replace("'", "''")
_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"


def seen_as(column: str) -> str:
    """What a reader sees, for texts of letters, spaces, invisible characters and joined emoji."""
    x = f"replace(replace(translate({column}, '{_FROM}', '{_TO}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    x = rf"regexp_replace({x}, '({_EMOJI})\x{{200D}}({_EMOJI})', '\1' || chr(57344) || '\2', 'g')"
    x = rf"regexp_replace({x}, '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{2064}}\x{{FEFF}}]', '', 'g')"
    x = f"nfc_normalize(replace({x}, chr(57344), chr(8205)))"
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))"


def _pairs(title: str, body: str) -> str:
    bare = lambda c: rf"regexp_replace(coalesce({c}, ''), '<[^<>]*>', ' ', 'g')"
    text = f"lower({seen_as(bare(title))} || ' ' || {seen_as(bare(body))})"
    return rf"regexp_extract_all({text}, '[\p{{L}}\p{{N}}]+')"


_SETS = "sets as (select *, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) as p from worded where len(w) > 1)"
_OVER = """held as (select k, len(p) as n, unnest(p) as x from sets),
met as (select a.k as a, b.k as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from held a join held b on a.x = b.x and a.k < b.k group by 1, 2),
near as (select a, b from met where c >= 0.6 * (na + nb - c) - 1e-9)"""
_GROUPS = """both_ways as (select x as a, y as b from links union select y, x from links),
reach as (select a as id, b as other from both_ways union select r.id, w.b from reach r join both_ways w on w.a = r.other),
grouped as (select id, least(id, min(other)) as g from reach group by id)"""
_LINKS = r"""listed as (select row_number() over () as r, list_filter(list_transform(string_split(article_ids, ';'), lambda x: trim(x)), lambda x: x <> '') as ids from dedup_family_summary_independent),
member as (select r, unnest(ids) as id from listed),
links as (
  select a.id as x, b.id as y from member a join member b using (r) where a.id < b.id
  union select trim(left_article_id), trim(right_article_id) from table5_qc_manual_labels
  where regexp_replace(upper(trim(manual_label)), '[\s_-]+', '_', 'g') = 'SAME_EVENT' and trim(left_article_id) <> '' and trim(right_article_id) <> '' and trim(left_article_id) <> trim(right_article_id))"""
_HOST = "nullif(regexp_replace(lower(trim({c})), '^www\\.', ''), '')"
_MET = f"""e as (select distinct {_HOST.format(c='publisher_domain')} as p, event_cluster_id as ev from articles_clustered where event_cluster_id is not null),
total as (select count(distinct ev) as n from e), alone as (select p, count(*) as c from e where p is not null group by p),
pairs as (select x.p as publisher_a, y.p as publisher_b, count(*) as k from e x join e y on x.ev = y.ev and x.p < y.p group by 1, 2),
met as (select publisher_a, publisher_b, k, a.c as a, b.c as b, n from pairs join alone a on a.p = publisher_a join alone b on b.p = publisher_b, total)"""
_UNIT = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
_CLUSTERS = f"""raw as (select article_id, cast(embedding as double[]) as v from article_vectors where embedding is not null),
u as (select article_id, {_UNIT} as v from raw),
links as (select a.article_id as x, b.article_id as y from u a join u b on a.article_id < b.article_id where list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) >= 0.8),
{_GROUPS}"""
_SIZES = f"""d as (select {_HOST.format(c='source')} as source, coalesce(octet_length(encode(text)), 0) as size from documents),
t as (select {_HOST.format(c='source')} as source, target_share, max_repeats, coalesce((select sum(size) from d where d.source = {_HOST.format(c='mix_targets.source')}), 0) as available from mix_targets)"""

_MIX = """sized as (select doc_id, {host} as source, coalesce(octet_length(encode(text)), 0) as size from documents),
repeated as (select doc_id, source, size, target_share, unnest(generate_series(1, max_repeats)) as copy_no from sized join w using (source) where target_share > 0),
copies as (select *, md5(concat_ws('|', doc_id, '0', copy_no)) as h from repeated),
served as (select *, sum(size) over (partition by source order by copy_no, h, doc_id rows unbounded preceding) / target_share as finish from copies),
cut as (select *, sum(size) over (order by finish, source, h, copy_no, doc_id rows unbounded preceding) as running from served),
u as (select source, sum(size) as used, count(*) as copies from cut where running <= {limit} group by source)
select w.source, target_share, max_repeats, available, coalesce(used, 0) as used, coalesce(copies, 0) as copies,
  round(coalesce(used, 0)::double / (select sum(used) from u), 6) as actual_share, max_repeats * available >= target_share * (select sum(available) from w) as reachable from w left join u on u.source = w.source"""
_MIX = _MIX.replace("{host}", _HOST.format(c="source"))

ORACLE: dict[str, str] = {
    "p1_found": f"""with f as (select distinct 'title' as field_name, article_id as id, title as s from articles_master where title is not null
      union select distinct 'description', article_id, description from articles_master where description is not null),
      g as (select *, {seen_as('s')} as form from f)
      select distinct a.field_name, a.id as left_article_id, b.id as right_article_id from g a join g b on a.field_name = b.field_name and a.form = b.form and a.s <> b.s and a.id < b.id""",
    "p1_forms": f"select article_id, {seen_as('title')} as title, {seen_as('description')} as description from articles_master",
    "p2_found": f"""with rec as (select -row_number() over () as k, payload.title as t, coalesce(payload.summary, payload.description) as d from payloads
      union all select item_no, payload.title, coalesce(payload.summary, payload.description) from incoming_records),
      worded as (select k, {_pairs('t', 'd')} as w from rec), {_SETS}, {_OVER} select distinct b as item_no from near where b > 0""",
    "p2_decisions": f"""with rec as (select -row_number() over () as k, payload.title as t, coalesce(payload.summary, payload.description) as d from payloads
      union all select item_no, payload.title, coalesce(payload.summary, payload.description) from incoming_records),
      worded as (select k, {_pairs('t', 'd')} as w from rec), {_SETS}, {_OVER.replace('select a, b from', 'select a, b, c = na and c = nb as same from')},
      best as (select b, bool_or(same) as same from near group by b)
      select item_no, case when same then 'copy' when b is not null then 'near_copy' else 'new' end as decision from (select distinct item_no from incoming_records) left join best on b = item_no""",
    "p3_found": f"with recursive {_LINKS}, {_GROUPS} select id as article_id, g as group_id from grouped",
    "p3_group_sizes": f"with recursive {_LINKS}, {_GROUPS}, s as (select g, count(*) as members from grouped group by g) select members, count(*) as groups from s group by members",
    "p4_found": f"""with worded as (select row_number() over () as k, article_id, w from (select distinct article_id, {_pairs('title', 'description')} as w from articles_master where description is not null)), {_SETS}, {_OVER}
      select distinct least(x.article_id, y.article_id) as left_article_id, greatest(x.article_id, y.article_id) as right_article_id from near join sets x on x.k = a join sets y on y.k = b where x.article_id <> y.article_id""",
    "p4_groups": f"""with recursive worded as (select row_number() over () as k, article_id, w from (select distinct article_id, {_pairs('title', 'description')} as w from articles_master where description is not null)), {_SETS}, {_OVER},
      links as (select distinct x.article_id as x, y.article_id as y from near join sets x on x.k = a join sets y on y.k = b where x.article_id <> y.article_id), {_GROUPS}
      select id as article_id, g as group_id from grouped""",
    "p5_found": f"with recursive {_CLUSTERS} select id as article_id, g as first_article_id from grouped",
    "p6_found": f"with {_MET} select publisher_a, publisher_b from met where k >= 2 and 1000 * k >= n and k * n >= 4 * a * b",
    "p6_pairs": f"with {_MET} select publisher_a, publisher_b, k, a, b, n, round(k * n / (a * b), 6) as lift, round(log2(k * n / (a * b)), 6) as pmi from met",
    "p8_bounds": f"""with x as (select pack_name, capacity_tokens::bigint as c, doc_id, octet_length(encode(text))::bigint as total from documents, pack_sizes where text is not null),
      p as (select pack_name, c, doc_id, least(c, total - c * k) as x from (select *, unnest(generate_series(0, greatest((total + c - 1) // c, 1) - 1)) as k from x)),
      f as (select pack_name, j, any_value(c) as c, sum(case when x > c - c * j // 64 and x >= c * j // 64 then c when x >= c * j // 64 then x else 0 end) as v from p, range(1, 33) r(j) group by all
        union all select pack_name, 0, any_value(c) * k, sum(case when (k + 1) * x % c = 0 then k * x else ((k + 1) * x) // c * c end) from p, range(1, 21) r(k) group by pack_name, k),
      b as (select pack_name, max(ceil(v / c)) as b from f group by pack_name)
      select pack_name, count(distinct doc_id) as documents, sum(x) as size, ceil(sum(x) / any_value(c))::bigint as least_by_size, greatest(ceil(sum(x) / any_value(c)), any_value(b))::bigint as least_containers
      from p join b using (pack_name) group by pack_name""",
    "p8_found": "select pack_name, doc_id from documents, pack_sizes where octet_length(encode(text)) > capacity_tokens",
    "p9_shares": f"with {_SIZES}, w as (select * from t), {_MIX.replace('{limit}', '(select sum(available) from w)')}",
    "p9_held_shares": f"""with {_SIZES}, w as (select * from t where available > 0),
      {_MIX.replace('{limit}', '(select least(max(total), floor(min(max_repeats * available / target_share))) from (select *, sum(available) over () as total from w) where target_share > 0)')}""",
    "p9_found": f"with {_SIZES} select source from t where max_repeats * available < target_share * (select sum(available) from t)",
}
