"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

OP3 = """
with recursive bits(i, v, k) as (
  select r.i, r.i::bigint, 0 from range(256) r(i)
  union all
  select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8),
crc as (select list(v order by i) as tb from bits where k = 8),
d as (
  select doc_id, coalesce(text, '') as t,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::bigint),
      lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as text_crc32, strlen(coalesce(text, '')) + 1 as size,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::bigint as k1,
    ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as k2
  from documents, crc),
total as (select sum(size)::bigint as b from d),
targets as (select i, (i * b) // 8 as t, cast(floor(b * 0.01 / 8) as bigint) as slack from total, range(1, 8) r(i)),
groups as (select k1, s, sum(s) over (order by k1) - s as low from (select k1, sum(size)::bigint as s from d group by k1)),
units as (
  select k1, k2, s, g.low + sum(s) over (partition by k1 order by k2) - s as low
  from (select k1, k2, sum(size)::bigint as s from d group by k1, k2) join (select k1, low from groups) g using (k1)),
outer_cut as (
  select i, t, k1, t - low as before, low + s - t as after, slack
  from targets join groups on low <= t and t < low + s),
cuts as (
  select i, case when before <= after then k1 else k1 + 1 end as c1, 0::bigint as c2
  from outer_cut where least(before, after) <= slack
  union all
  select i, u.k1, case when o.t - low <= low + s - o.t then k2 else k2 + 1 end
  from outer_cut o join units u on u.k1 = o.k1 and low <= o.t and o.t < low + s
  where least(before, after) > slack),
dealt as (
  select d.*, (select count(*) from cuts where d.k1 > c1 or (d.k1 = c1 and d.k2 >= c2)) as shard from d)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard::int as shard,
  (row_number() over (partition by shard order by k1, k2, doc_id) - 1)::bigint as slot, cast(null as int) as grown_shard
from dealt
"""

OP4 = """
with s as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
each as (select source, sum(size)::bigint as source_size from s group by source),
ranked as (
  select *, 2.0::double * source_size as cap,
    ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight from each),
sums as (
  select *, 1.5::double * sum(source_size) over ()::double as total,
    sum(cap) over w - cap as capped, sum(weight) over () - sum(weight) over w + weight as open
  from ranked window w as (order by cap / weight, source nulls last rows unbounded preceding)),
levels as (select *, case when (total - capped) / open * weight <= cap then (total - capped) / open end as level from sums),
targets as (
  select source, source_size, least(cap, coalesce(max(level) over () * weight, cap)) as target from levels),
rates as (select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from targets),
planned as (
  select s.doc_id, s.size, r.source_size, r.target,
    floor(rate) + case when ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint::double / 281474976710656.0::double < rate - floor(rate) then 1 else 0 end as copies
  from s join rates r on s.source is not distinct from r.source)
select doc_id, size, source_size, target, (copies * size)::bigint as taken from planned
"""

OP7 = r"""
with recursive found as (
  select url, replace(unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)]), '&amp;', '&') as link
  from pages where url is not null and html is not null),
parts as (
  select url, link, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as root, regexp_extract(url, '(?s)^(.*?:)//', 1) as scheme,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) as folder, regexp_extract(url, '(?s)^([^?#]*)', 1) as page
  from found where link <> ''),
absolute as (
  select url as u, case
    when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
    when starts_with(link, '//') then scheme || link
    when starts_with(link, '/') then root || link
    when link[1] in ('?', '#') then page || link
    when ends_with(folder, '/') and folder <> scheme || '//' then folder || link
    else folder || '/' || link end as v
  from parts),
urls as (select u as url from absolute union select v from absolute union select url from pages),
bare as (select url, regexp_replace(url, '(?s)#.*$', '') as b from urls),
heads as (select url, b, regexp_extract(b, '(?s)^(.*?://[^/?]*)', 1) as head from bare),
nodes as (select url, translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(b, length(head) + 1) as node from heads),
edges as (
  select x.node as a, y.node as b from absolute join nodes x on x.url = u join nodes y on y.url = v
  union
  select y.node, x.node from absolute join nodes x on x.url = u join nodes y on y.url = v),
reach as (select a as node, a as other from edges union select r.node, e.b from reach r join edges e on e.a = r.other),
judged as (
  select distinct url from pages where url is not null union select distinct other from reach),
p as (
  select url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from judged),
rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (
  select url, arg_max(verdict, length(rhost || rpath)) as verdict, arg_max(rhost || rpath, length(rhost || rpath)) as rule
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by url),
voted as (select node, min(verdict) as verdict from reach join best on best.url = other group by node)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(best.verdict, voted.verdict, 'allow') as verdict
from pages left join p using (url) left join best using (url) left join nodes using (url) left join voted using (node)
"""

OP8 = """
with w as (
  select 'd' as kind, doc_id::varchar as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
  union all
  select 'i', coalesce(item_id::varchar, 'null'), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
i as (select id, words, least(10, len(words)) as n from w where kind = 'i' and len(words) > 0),
wins as (select distinct id, n, array_to_string(words[st:st + n - 1], ' ') as win from (select *, unnest(range(1, len(words) - n + 2)) as st from i)),
d as (select id, words from w where kind = 'd'),
cand as (select id, n, st, array_to_string(words[st:st + n - 1], ' ') as win from (select id, words, n, unnest(range(1, len(words) - n + 2)) as st from d, (select distinct n from i) where len(words) >= n)),
met as (select cand.id, cand.st, cand.n, wins.id as item from cand join wins using (n, win)),
hit as (select id, count(distinct pos) as n_hit from (select id, unnest(range(st, st + n)) as pos from met) group by id),
its as (select id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from met group by id)
select d.id::bigint as doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (id) left join its using (id)
"""

OP11 = """
with recursive bits(i, v, k) as (
  select r.i, r.i::bigint, 0 from range(256) r(i)
  union all
  select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8),
crc as (select list(v order by i) as tb from bits where k = 8),
d as (
  select doc_id, source, coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-')
      || coalesce(strlen(lang)::varchar || ':' || lang, '-') || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') as head,
    coalesce(strlen(text)::varchar || ':' || text, '-') as body,
    coalesce(strlen(text)::varchar || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') as changed,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda p: ('0x' || p)::bigint),
      lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 5 = 0 as tampered
  from documents, crc),
leaves as (
  select doc_id, source, sha256(head || body) as leaf, case when tampered then sha256(head || changed) else sha256(head || body) end as now,
    dense_rank() over (order by source nulls first) as tree,
    row_number() over (partition by source order by doc_id nulls first) - 1 as pos, count(*) over (partition by source) as n from d),
up(tree, level, pos, h, n) as (
  select tree, 0, pos, leaf, n from leaves
  union all
  select tree, level + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (n + 15) // 16 from up where n > 1 group by tree, level, pos // 16, n),
roots as (select tree, h as subroot from up where n = 1),
top(level, pos, h, n) as (
  select 0, row_number() over (order by tree) - 1, subroot, count(*) over () from roots
  union all
  select level + 1, pos // 16, sha256(string_agg(h, '' order by pos)), (n + 15) // 16 from top where n > 1 group by level, pos // 16, n),
top_leaves as (select tree, subroot, row_number() over (order by tree) - 1 as pos from roots),
root as (select h as root from top where n = 1),
asked as (
  select doc_id, l.tree, level, pos // (16 ** level)::bigint as own from leaves l join (select distinct tree, level from up where n > 1) using (tree)),
low as (
  select doc_id, level, coalesce(string_agg(h, '' order by pos) filter (pos < own), '') as le, coalesce(string_agg(h, '' order by pos) filter (pos > own), '') as ri
  from asked join up using (tree, level) where pos // 16 = own // 16 group by doc_id, level),
high as (
  select tree, 100 + level as level, coalesce(string_agg(x.h, '' order by x.pos) filter (x.pos < own), '') as le, coalesce(string_agg(x.h, '' order by x.pos) filter (x.pos > own), '') as ri
  from (select tree, level, pos // (16 ** level)::bigint as own from top_leaves, (select distinct level from top where n > 1)) join top x using (level)
  where x.pos // 16 = own // 16 group by tree, level),
steps as (select doc_id, level, le, ri from low union all select doc_id, level, le, ri from leaves join high using (tree)),
paths as (select doc_id, list(le order by level) as le, list(ri order by level) as ri, string_agg(le || ri, '' order by level) as proof from steps group by doc_id),
fold(doc_id, h, le, ri) as (
  select doc_id, now, coalesce(le, []), coalesce(ri, []) from leaves left join paths using (doc_id)
  union all
  select doc_id, sha256(le[1] || h || ri[1]), le[2:], ri[2:] from fold where len(le) > 0)
select doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) as proof_sha256, h as folded_root, h = root as verified
from leaves join roots using (tree) left join paths using (doc_id) join (select doc_id, h from fold where len(le) = 0) using (doc_id), root
"""

OP12 = """
with words as (
  select coalesce(lang, 'und') as lang, d, p, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as w
  from (
    select lang, d, generate_subscripts(pieces, 1) as p, unnest(pieces) as piece
    from (select lang, row_number() over () as d, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') as pieces from documents))),
runs as (select lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])) as ph from words, range(1, 4) r(k)),
f as (select lang, k, array_to_string(ph, ' ') as phrase, ph, count(*) as f from runs group by all),
total as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and f >= 10),
kept as (
  select c.* from c where not exists (
    select 1 from c x where x.lang = c.lang and x.k > c.k and 100 * x.f >= 50 * c.f and (x.ph[1:c.k] = c.ph or x.ph[2:c.k + 1] = c.ph))),
cuts as (
  select kept.lang, kept.phrase, kept.f as a, cut, l.f as l, r.f as r, ((1000000::hugeint * kept.f * kept.f) // (l.f::hugeint * r.f))::bigint as score
  from kept, range(1, 3) t(cut) join f l on l.lang = kept.lang and l.ph = kept.ph[1:cut] join f r on r.lang = kept.lang and r.ph = kept.ph[cut + 1:]
  where cut < kept.k),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
"""

OP13 = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents) window g as (partition by text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_histogram_shards": OP3,
        "op4_source_mix": OP4,
        "op7_url_filter": OP7,
        "op8_decontaminate": OP8,
        "op11_merkle_manifest": OP11,
        "op12_collocations": OP12,
        "op13_exact_dedup": OP13,
    }
