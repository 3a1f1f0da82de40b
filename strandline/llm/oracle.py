"""SQL that gives the rows of those queries that SQL can express, over the same tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
with iw as (select item_id, {_WORDS.format("text")} as w from benchmark where text is not null),
it as (select item_id, w, least(10, len(w)) as l, unnest(range(1, greatest(1, len(w) - 9) + 1)) as k from iw where len(w) > 0),
win as (select distinct item_id, l, array_to_string(w[k:k + l - 1], ' ') as phrase from it),
dw as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
dp as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k from dw),
run as (select doc_id, k, list(word) over (partition by doc_id order by k rows between current row and 9 following) as w from dp),
occ as (select distinct r.doc_id, r.k, r.l, win.item_id from (select doc_id, k, l, array_to_string(w[1:l], ' ') as phrase from run, (select distinct l from win) where len(w) >= l) r join win on win.l = r.l and win.phrase = r.phrase),
hit as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + l)) as pos from (select distinct doc_id, k, l from occ)) group by 1),
item as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, item_id::varchar as i from occ) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join hit on hit.doc_id = d.doc_id left join item on item.doc_id = d.doc_id"""

SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, k, substr(h, 2 * k + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as k from d)),
f as (select s, min(doc_id) as first from w group by 1),
m as (select w.doc_id, w.k, w.k - lag(w.k) over (partition by w.doc_id order by w.k) as gap from w join f on f.s = w.s and f.first < w.doc_id),
n as (select doc_id, k, sum(case when gap <= 50 then 0 else 1 end) over (partition by doc_id order by k) as run from m),
r as (select doc_id, run, min(k) as a, max(k) + 50 as b from n group by 1, 2),
p as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from r),
g as (select p.doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from p join d on d.doc_id = p.doc_id group by 1)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join g on g.doc_id = d.doc_id"""

NEAR_DUP = f"""
with recursive t as (select doc_id, {_TOKENS.format("coalesce(text, '')")} as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + 1], ' ') as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 1) + 1)) as k from t where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
e as (select x, y from l union select y, x from l),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
q as (select x, least(x, min(y)) as component from r group by 1)
select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(q.component, t.doc_id) as component_id, coalesce(q.component, t.doc_id) = t.doc_id as kept
from t left join n on n.doc_id = t.doc_id left join q on q.x = t.doc_id"""

WARC = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as x, min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (5 * (i // 4) + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), '') as payload_digest,
case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to from p"""

#: crc32 by its table, for each distinct word of a document; of words one edit apart one is the other
#: without a letter, or both are the same without the letter at one place.
SPELLING = r"""
with recursive tab as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(0, 256) r(i))),
run as (select doc_id, word, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as word from documents where text is not null) group by 1, 2),
key as (select doc_id, word, n, hex(encode(doc_id::varchar || ':' || word)) as x from run where length(word) >= 5),
crc as (select word, n, case when doc_id is null then 1 else xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(x) // 2), lambda k: ('0x' || substr(x, (2 * k + 1)::int, 2))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) end as h from key, tab),
word as (select case when h % 97 = 0 then substr(word, 1, (h % length(word))::int) || substr(word, (h % length(word))::int + 2) else word end as word, n from crc),
v as (select word, sum(n)::bigint as n from word group by 1 having sum(n) >= 3 and length(word) >= 5),
cut as (select word, n, word as k, 0 as i from v union all select word, n, substr(word, 1, i::int - 1) || substr(word, i::int + 1), i from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
near as (select distinct a.word, a.n, b.word as b, b.n as nb from cut a join cut b on a.k = b.k and a.word <> b.word where a.i = b.i or a.i = 0 or b.i = 0),
best as (select word, count(*) as n_near, max(nb) as nb, arg_min(b, (-nb, b)) as b from near group by 1),
f as (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when nb >= 2 * v.n then b end as form, case when nb >= 2 * v.n then nb end as form_n from v left join best on best.word = v.word),
walk as (select word, word as reached, 0 as d from f union all select w.word, f.form, d + 1 from walk w join f on f.word = w.reached where f.form is not null),
root as (select word, arg_max(reached, d) as root from walk group by 1)
select f.word, form, root, n, n_near, form_n from f join root on root.word = f.word"""

ORACLE_SQL = {"op4_decontaminate": DECONTAMINATE, "op5_suffix_dedup": SUFFIX_DEDUP, "op6_near_dup": NEAR_DUP, "op8_warc": WARC, "op12_spelling": SPELLING}
