"""DuckDB SQL for corpus queries that a plain way can express: windows joined as texts, all pairs that share a shingle."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAM = f"""
with recursive sizes as (select distinct least(10, len(ws)) as size from (select regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as ws from benchmark) where len(ws) > 0),
b as (select item_id::varchar as item, regexp_extract_all(translate(text, '{UP}', '{LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as ws from benchmark),
bw as (select item, j, least(10, len(ws)) as size, array_to_string(ws[j + 1:j + least(10, len(ws))], ' ') as k from (select item, ws, unnest(range(greatest(len(ws) - 9, 1))) as j from b where len(ws) > 0)),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as ws from documents),
dw as (select doc_id, i, size, array_to_string(ws[i + 1:i + size], ' ') as k from (select doc_id, ws, size, unnest(range(len(ws) - size + 1)) as i from d, sizes where len(ws) >= size)),
h as (select doc_id, i, dw.size, item, j from dw join bw on dw.k = bw.k and dw.size = bw.size),
pos as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + size)) as p from h) group by 1),
run as (select doc_id, max(i) - min(i) + max(size) as n from (select *, i - row_number() over (partition by doc_id, item, i - j order by i) as r from h) group by doc_id, item, i - j, r),
per as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from h group by 1),
far as (select doc_id, max(n) as longest from run group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest, 0)::bigint as longest_match
from d left join pos using (doc_id) left join per using (doc_id) left join far using (doc_id)
"""
NEARDUP = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, case when len(ws) = 1 then ws[1] else ws[i] || ' ' || ws[i + 1] end as g from (select doc_id, ws, unnest(range(1, greatest(len(ws), 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as size, md5(string_agg(g, chr(10) order by g)) as fp from s group by 1),
c as (select fp, size, min(doc_id) as rep from n group by 1, 2),
r as (select s.doc_id, g, size from s join c on s.doc_id = c.rep),
l as (select a.doc_id as x, b.doc_id as y from r a join r b on a.g = b.g and a.doc_id < b.doc_id and 100 * a.size >= 80 * b.size and 100 * b.size >= 80 * a.size
  group by a.doc_id, b.doc_id, a.size, b.size having 100 * count(*) >= 80 * (a.size + b.size - count(*))),
e as (select x, y from l union all select y, x from l),
t as (select rep as x, rep as y from c union select t.x, e.y from t join e on t.y = e.x),
m as (select x as rep, min(y) as root from t group by 1)
select w.doc_id, coalesce(n.size, 0) as n_shingles, coalesce(m.root, w.doc_id) as component_id, coalesce(m.root, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join c on c.fp = n.fp and c.size = n.size left join m on m.rep = c.rep
"""
