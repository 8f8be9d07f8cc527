"""DuckDB SQL for queries of this subpackage: the definitions, by plain joins over whole tables."""

from __future__ import annotations

from cairn.llm import maglev

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{pattern}')"


#: Every pair of documents that share a shingle, by counting; components as the closure of the links.
NEAR_DOCUMENTS = rf"""with recursive t as (select doc_id, {_words(r"[^\x20\x09-\x0D]+")} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from t),
x as (select doc_id, unnest(g) as g from s), n as (select doc_id, len(g) as n from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 75 * (p.n + q.n - k)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from s union select r.a, e.b from r join e on e.a = r.b),
m as (select a, min(b) as component_id from r group by a)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join m on m.a = n.doc_id"""

#: Every pair of vectors.
NEAR_VECTORS = """with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id < b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
e as (select a, b from l union all select b, a from l), n as (select a, count(*) as n from e group by a),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, e.b from r join e on e.a = r.b),
m as (select a, min(b) as component_id from r group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join m on m.a = vec_id left join n on n.a = vec_id"""

#: Every string of 100 bytes, as hexadecimal digits (cut from parts of texts, as cutting a long string is slow).
REPEATS = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, j, n, substr(h, 2 * j + 1, 798) as h from (select doc_id, h, len(h) // 2 - 99 as n, unnest(range(0, len(h) // 2 - 99, 300)) as j from d)),
w as (select doc_id, j + i as i, md5(substr(h, 2 * i + 1, 200)) as k from (select *, unnest(range(0, least(300, n - j))) as i from c)),
f as (select doc_id, i, row_number() over (partition by k order by doc_id, i) as rn from w),
g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as fresh from f where rn > 1),
s as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from g),
spans as (select doc_id, min(i) as a, max(i) + 100 as b from s group by doc_id, run),
p as (select doc_id, lag(b, 1, 0) over (partition by doc_id order by a) as a, a as b from spans union all select doc_id, max(b), 1000000000 from spans group by doc_id),
k as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as kept from p join d using (doc_id) group by doc_id),
n as (select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join n using (doc_id) left join k using (doc_id)"""

#: Every window of items joined with every window of that many words of documents.
LEAKS = rf"""with t as (select doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} as w from documents),
b as (select item_id, w, least(10, len(w)) as n from (select item_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} as w from benchmark) where len(w) > 0),
q as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as k from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
x as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from t, (select distinct n from q))),
h as (select doc_id, n, i, item_id from x join q using (n, k)),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from t left join c using (doc_id) left join m using (doc_id)"""

ORACLES = {"op2_minhash_dedup": NEAR_DOCUMENTS, "op3_embedding_dedup": NEAR_VECTORS, "op4_sharding": maglev.oracle(), "op5_substring_dedup": REPEATS, "op9_decontamination": LEAKS}
