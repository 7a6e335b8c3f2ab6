"""The SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
with p as (select row_number() over () r, page_id, url, regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', ''), '\.$', '') host,
    '/' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1) path,
    to_timestamp(1704067200 + (('0x' || substr(md5('t' || page_id::varchar), 1, 6))::bigint * (366 * 86400 // 16777216 + 1)) % (366 * 86400))::timestamp ft from pages),
nm as (select distinct kind, value, every from (
    select 'host' kind, host value, 3 every from p union all
    select 'prefix', host || '/' || string_split(path, '/')[2] || '/', 7 from p union all
    select 'domain', regexp_extract(host, '[^.]+\.(.+)', 1), 5 from p) where value is not null and value not in ('', '/', '//')),
nb as (select kind, value, ('0x' || substr(md5('d' || value), 1, 6))::bigint % 366 d, ('0x' || substr(md5('r' || value), 1, 6))::bigint % 120 rm, ('0x' || substr(md5('a' || value), 1, 6))::bigint % 2 ag
    from nm where ('0x' || substr(md5('s' || value), 1, 6))::bigint % every = 0),
ev as (select kind, value, 'add' a, d from nb union all select kind, value, 'remove', d + 1 + rm from nb union all select kind, value, 'add', d + 150 from nb where ag = 0),
iv as (select kind, value, a, to_timestamp(1704067200 + d * 86400)::timestamp since, lead(to_timestamp(1704067200 + d * 86400)::timestamp) over (partition by kind, value order by d) until from (select kind, value, d, max(a) a from ev group by all)),
m as (select r, kind, value, since from p join iv on a = 'add' and host <> '' and ft >= since and (until is null or ft < until)
    and case kind when 'host' then host = value when 'domain' then host = value or ends_with(host, '.' || value) else starts_with(host || path, value) end),
b as (select r, count(*) n, first(kind order by -length(value), kind, value) k, first(value order by -length(value), kind, value) v, first(since order by -length(value), kind, value) s from m group by r)
select page_id, url, ft fetched_at, host, coalesce(n, 0)::bigint n_entries, k entry_kind, v entry, s listed_since, n is not null blocked from p left join b using (r)
"""

OP5 = r"""
with recursive v as (select row_number() over () r, vec_id, embedding::double[] e from embeddings),
g as (select r, e, sqrt(list_dot_product(e, e)) n from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
lk as (select a.r x, b.r y from g a join g b on a.r <> b.r and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(r, t) as (select r, r from v union select reach.r, lk.y from reach join lk on lk.x = reach.t),
comp as (select reach.r, min(v.vec_id) component_id from reach join v on v.r = reach.t group by reach.r),
n as (select x r, count(*) n from lk group by x)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id is not distinct from component_id kept
from v left join n using (r) join comp using (r)
"""

OP6 = r"""
with recursive d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::varchar[]) w from documents),
sh as (select distinct r, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i+4], ' ') end s
  from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select r, count(*) c from sh group by r),
pr as (select a.r x, b.r y, count(*) k from sh a join sh b on a.s = b.s and a.r <> b.r group by all),
lk as (select x, y from pr join n a on a.r = x join n b on b.r = y where 100 * k >= 75 * (a.c + b.c - k)),
reach(r, t) as (select r, r from d union select reach.r, lk.y from reach join lk on lk.x = reach.t),
comp as (select reach.r, min(d.doc_id) component_id from reach join d on d.r = reach.t group by reach.r)
select doc_id, coalesce(c, 0)::bigint n_shingles, component_id, doc_id is not distinct from component_id kept
from d left join n using (r) join comp using (r)
"""

OP8 = r"""
with d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::varchar[]) w from documents),
win as (select r, i, array_to_string(w[i:i+34], ' ') g from (select r, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
rep as (select g from win group by g having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + 35)) j from win join rep using (g)),
wd as (select d.r, j, w[j] t from (select r, w, unnest(range(1, len(w) + 1)) j from d) d),
kept as (select wd.r, string_agg(t, ' ' order by wd.j) s from wd left join gone on gone.r = wd.r and gone.j = wd.j where gone.j is null group by wd.r),
n as (select r, count(*) n from gone group by r)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(s, '')) kept_sha256
from d left join n using (r) left join kept using (r)
"""

OP9 = r"""
with d as (select doc_id, row_number() over () r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) w from documents),
b as (select item_id::varchar item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
bw as (select distinct item_id, k, array_to_string(w[i:i+k-1], ' ') g from (select item_id, w, least(13, len(w)) k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select r, i, k, array_to_string(w[i:i+k-1], ' ') g from (select r, w, k, unnest(range(1, len(w) - k + 2)) i from d, ks where len(w) >= k)),
hits as (select r, i, dw.k, item_id from dw join bw on dw.k = bw.k and dw.g = bw.g),
n as (select r, count(distinct j) n_hit from (select r, unnest(range(i, i + k)) j from (select distinct r, i, k from hits)) group by r),
it as (select r, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct r, item_id from hits) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join n using (r) left join it using (r)
"""

OP10 = r"""
with d as (select row_number() over () r, doc_id, case when source is null then '1' else '0' || source end s,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, md5('mix' || coalesce(doc_id::varchar, '')) k from documents),
src as (select s, sum(size)::bigint source_size, ([5.0, 2.0, 1.0]::double[])[(row_number() over (order by s) - 1) % 3 + 1] w, row_number() over (order by s) n from d group by s),
cap as (select *, 2.0::double * source_size cap, 2.0::double * source_size / w ratio, 1.5::double * sum(source_size) over () budget from src),
lev as (select *, (budget - coalesce(sum(cap) over (order by ratio, n rows between unbounded preceding and 1 preceding), 0.0))
    / (sum(w) over () - coalesce(sum(w) over (order by ratio, n rows between unbounded preceding and 1 preceding), 0.0)) level from cap),
tgt as (select s, source_size, budget, least(cap, w * max(level) over ()) target from lev),
q as (select d.*, source_size, budget, target, sum(size) over (partition by d.s order by k, doc_id, size rows unbounded preceding)::bigint c from d join tgt on d.s = tgt.s),
e as (select *, (c + p * source_size)::double / target f from q, (select unnest([0, 1]) p) where size > 0),
g as (select r, sum(size) over (order by f, k, s, doc_id, size, p rows unbounded preceding) - size began, budget from e),
t as (select r, count(*) n from g where began < budget group by r)
select doc_id, q.size, q.source_size::bigint source_size, q.target, (q.size * coalesce(t.n, 0))::bigint taken from q left join t using (r)
"""

OP11 = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents where text is not null),
s as (select count(*) n, sum(len(t)) l from d where len(t) > 0),
i as (select row_number() over () k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from benchmark where text is not null),
it as (select distinct k, item_id, unnest(t) w from i),
tf as (select r, w, count(*) tf from (select r, unnest(t) w from d) where w in (select w from it) group by all),
df as (select w, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::bigint weight from tf, s group by w, n),
sc as (select k, item_id, tf.r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.t) * s.n) // s.l))))::bigint score
  from it join tf using (w) join df using (w) join d on d.r = tf.r, s group by all)
select item_id, row_number() over (partition by k order by score desc, doc_id asc nulls last)::int "rank", doc_id, score
from sc join d using (r) where score > 0 qualify "rank" <= 50
"""

OP13 = r"""
with d as (select row_number() over () r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::varchar[]) w from documents),
crc as (select i, (select list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) v from (select unnest(range(256))::bigint i)),
tab as (select list(v order by i) t from crc),
h as (select d.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) h from d, tab),
g as (select *, (h // 10) % greatest(len(w), 1) a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) p from h),
x as (select r, doc_id, case when h % 10 = 0 and len(w) > 0 then list_concat(w[1:a], list_transform(range(0, len(w) - a), lambda i: w[a + i % p + 1])) else w end w from g),
n9 as (select r, i, array_to_string(w[i+1:i+9], ' ') s from (select r, w, unnest(range(0, len(w) - 8)) i from x where len(w) >= 24)),
pr as (select a.r, a.i, b.i - a.i q from n9 a join n9 b on a.r = b.r and a.s = b.s and a.i < b.i),
st as (select r, q, min(i) start, count(*) + 8 + q length from (select *, i - row_number() over (partition by r, q order by i) isle from pr) group by r, q, isle),
run as (select r, start, length::bigint length, min(q) q from st where length >= greatest(24, 3 * q) group by all),
gone as (select distinct r, unnest(range(start + q, start + length)) j from run),
wd as (select r, unnest(range(0, len(w))) j, unnest(w) t from x),
kept as (select r, string_agg(t, ' ' order by j) c from wd anti join gone using (r, j) group by r),
agg as (select r, count(*) n, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) l from run group by r),
best as (select r, start, length, q from run qualify row_number() over (partition by r order by length::double / q desc, start, q) = 1)
select doc_id, coalesce(n, 0)::bigint n_runs, start::bigint start, length, q::bigint "period", ((1000 * length) // q)::bigint exponent_milli,
  sha256(coalesce(l, '')) runs_sha256, sha256(coalesce(c, '')) collapsed_sha256
from x left join agg using (r) left join best using (r) left join kept using (r)
"""

ORACLE = {"op4_url_filter": OP4, "op5_embedding_dedup": OP5, "op6_minhash_dedup": OP6, "op8_substring_dedup": OP8, "op9_decontamination": OP9, "op10_source_mixing": OP10,
          "op11_ranked_search": OP11, "op13_periodic_runs": OP13}
