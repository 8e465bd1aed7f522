"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

LINE_DEDUP = """
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select doc_id, generate_subscripts(ls, 1) as pos, unnest(ls) as line from s),
k as (select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
f as (select key, max(doc_id) as keep from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select k.doc_id, count(*) as n_lines, count(*) filter (where f.keep is not null and f.keep <> k.doc_id) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.keep is null or f.keep = k.doc_id), '')) as kept_sha256
from k left join f on k.key = f.key group by k.doc_id
"""

REVISITS = """
with p as (select page_id, url, '"' || md5(html) || '"' as tag, octet_length(encode(html))::varchar as size, length(html) % 4 as kind,
        strftime(make_timestamp((1600000000 + page_id * 60) * 1000000), '%Y-%m-%d %H:%M:%S') as d from pages),
a as (select *, case kind when 0 then tag when 1 then 'W/' || tag when 3 then '"' || md5(tag) || '"' end as asked from p),
u as (select *, regexp_replace(trim(url), '#.*$', '') as w from a),
v as (select *, lower(regexp_extract(w, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme,
        lower(regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) as host,
        regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) as path,
        string_split(regexp_extract(w, '\\?(.*)$', 1), '&') as q from u),
x as (select *, case scheme when 'http' then regexp_replace(host, ':80$', '') when 'https' then regexp_replace(host, ':443$', '') else host end as h,
        case when path = '' then '/' when path = '/' then path else regexp_replace(path, '/+$', '') end as pa,
        array_to_string(list_sort(list_filter(q, lambda s: s <> '' and not regexp_matches(s, '^(utm_[a-z]+|ref|sessionid|fbclid|gclid)='))), '&') as qs from v),
c as (select *, case when scheme = '' then w else scheme || '://' || h || pa || case when qs = '' then '' else '?' || qs end end as url_key from x),
full_ as (select url_key, page_id * 10 as t, max_by(struct_pack(id := 'full-' || page_id, tag := tag, d := d, size := size), 'full-' || page_id) as r
        from c group by url_key, page_id * 10),
asks as (select 'early-' || page_id as record_id, url_key, page_id * 10 - 5 as t, tag as etag, null::varchar as d, false as late from c
        union all select 'late-' || page_id, url_key, page_id * 10 + 5, asked, d, true from c),
m as (select asks.*, full_.r from asks asof left join full_ on asks.url_key = full_.url_key and asks.t > full_.t),
o as (select *, case when r is null then 'unmatched'
        when coalesce(regexp_replace(etag, '^W/', '') <> r.tag, d <> r.d, false) then 'mismatch' else 'resolved' end as outcome from m)
select record_id, url_key, t as fetched_at, outcome, r.id as refers_to, case when outcome = 'resolved' then r.tag end as digest,
    case when outcome = 'resolved' then case when late then 'cache-control: max-age=60; ' else '' end
        || 'content-length: ' || r.size || '; content-type: text/html; date: ' || r.d || '; etag: ' || coalesce(etag, r.tag) || '; server: edge' end as headers
from o
"""


TOP_K = """
with c as (select vec_id, list_transform(embedding, lambda x: (x > 0)::int) as b from embeddings),
p as (select q.vec_id as query_id, r.vec_id as neighbour_id,
        list_sum(list_transform(list_zip(q.b, r.b), lambda z: (z[1] <> z[2])::int))::int as distance
    from c q, c r where q.vec_id % 100 = 0 and q.vec_id <> r.vec_id)
select query_id, (row_number() over (partition by query_id order by distance, neighbour_id))::int as rank, neighbour_id, distance
from p qualify row_number() over (partition by query_id order by distance, neighbour_id) <= 10
"""

#: CRC-32 of a blob's hex digits, byte by byte with a table of its own rule.
_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1, 2), lambda i: ('0x' || substr({0}, i, 2))::bigint)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"""
RESAMPLE = f"""
with recursive bits as (select i, i as v, 0 as step from range(256) t(i)
    union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from bits where step < 8),
crc_table as (select list(v order by i) as tab from bits where step = 8),
texts as (select 'd' as part, doc_id, text from documents union all select 't', null, text from benchmark),
ws as (select part, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as words from texts),
f as (select part, doc_id, unnest(words) as w from ws),
h as (select w, hex(encode(w)) as x from (select distinct w from f)),
b as (select w, xor({_CRC.format("x")}, 4294967295) % 10000 as bucket from h, crc_table),
n as (select bucket, count(*) filter (where part = 'd') as s, count(*) filter (where part = 't') as t from f join b using (w) group by bucket),
g as (select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ()) + 10000)::double / ((s + 1)::double * ((sum(t) over ()) + 10000)::double)))::bigint as gain from n),
weights as (select doc_id, sum(gain)::bigint as weight from f join b using (w) join g using (bucket) where part = 'd' group by doc_id),
scored as (select doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
    from ws left join weights using (doc_id) where part = 'd'),
drawn as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as total from scored where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when place <= 10 * total // 100 then place end as rank
from scored left join drawn using (doc_id)
"""

NEAR_SETS = """
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as shingles from t),
v as (select min(doc_id) as v, shingles, len(shingles) as n from s where len(shingles) > 0 group by shingles),
e as (select v, n, unnest(shingles) as shingle from v),
ranked as (select v, n, shingle, row_number() over (partition by v order by f, shingle) as place from e join (select shingle, count(*) as f from e group by shingle) using (shingle)),
prefix as (select v, n, shingle from ranked where place <= n - (80 * n + 99) // 100 + 1),
pairs as (select distinct a.v as a, b.v as b from prefix a join prefix b on a.shingle = b.shingle and a.v < b.v and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links as (select a, b from pairs join v x on x.v = a join v y on y.v = b
    where 100 * len(list_intersect(x.shingles, y.shingles)) >= 80 * (x.n + y.n - len(list_intersect(x.shingles, y.shingles)))),
sides as (select a, b from links union select b, a from links),
reach as (select v as a, v as b from v union select reach.a, sides.b from reach join sides on reach.b = sides.a),
least_ as (select a, min(b) as component_id from reach group by a)
select s.doc_id, len(s.shingles) as n_shingles, coalesce(component_id, s.doc_id) as component_id, s.doc_id = coalesce(component_id, s.doc_id) as kept
from s left join v on s.shingles = v.shingles left join least_ on v.v = least_.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP, "op2_warc_revisits": REVISITS, "op6_hamming_topk": TOP_K, "op11_hyperminhash_near_dedup": NEAR_SETS, "op13_importance_resampling": RESAMPLE}
