"""DuckDB twins of the text queries that SQL can express."""

from __future__ import annotations

from seriesmill.llm import quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


DECONTAMINATE = f"""with d as (select doc_id, {_words(_ALNUM)} as w from documents),
b as (select item_id, {_words(_ALNUM)} as w from benchmark),
win as (select distinct item_id, least(len(w), 13) as size, w[k : k + 12] as g from b, lateral (select unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k) where len(w) > 0),
sizes as (select distinct size from win),
spot as (select doc_id, k, size, w[k : k + size - 1] as g from d, sizes, lateral (select unnest(range(1, len(w) - size + 2)) as k)),
occ as (select a.doc_id, a.k, a.size, item_id from spot a join win using (size, g)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from (select distinct doc_id, k, size from occ)) group by 1),
own as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from occ) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join own using (doc_id)"""

NGRAM_JOIN = f"""with recursive d as (select doc_id, {_words(_SPACED)} as w from documents),
s as (select distinct doc_id, w[k : k + 4] as g from d, lateral (select unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
c as (select x.doc_id as a, y.doc_id as b, count(*) as m from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * m >= 75 * (p.n + q.n - m)),
r as (select doc_id, doc_id as top from n union select r.doc_id, e.b from r join e on e.a = r.top)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce((select min(top) from r where r.doc_id = d.doc_id), d.doc_id) as component_id from d left join n using (doc_id)"""

QUALITY = f"""with t as (select doc_id, source, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents),
g as (select doc_id, k, w[k : k + 2] as tri from t, lateral (select unnest(range(1, len(w) - 1)) as k)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + 3)) as p from g where (doc_id, tri) in (select (doc_id, tri) from (select doc_id, tri from g group by 1, 2 having count(*) > 1))) group by 1),
m as (select doc_id, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
  cast(len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) as bigint) as n_dup_lines,
  len(string_split(x, chr(10))) as n_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from t left join rep using (doc_id)),
f as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, n_symbols > {quality.SYMBOL_SHARE}::double * word_chars or n_dup_lines > {quality.DUP_LINE_SHARE}::double * n_lines as soft_failed from m),
h as (select source, count(*) as n, sum(case when base_failed or soft_failed then 1 else 0 end)::double as bad from f group by 1),
p as (select sum(bad) / sum(n) as m, sum(n * (bad / n) * (bad / n)) / sum(n) as second from h),
q as (select m, case when second - m * m > 1e-12 then greatest(m * (1 - m) / (second - m * m) - 1, 0) else 0 end as weight from p),
r as (select source, (bad + q.m * weight) / (n + weight) as rate from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (soft_failed and rate >= {quality.HOST_RATE}) as kept from f left join r on f.source is not distinct from r.source"""

WARC = """with p as (select page_id, sha1(coalesce(html, '')) as payload_digest, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages),
o as (select payload_digest, max(page_id) as owner from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, payload_digest, case when owner is null or owner = page_id then 'response' else 'revisit' end as record_type, case when owner <> page_id then owner end as refers_to from p left join o using (payload_digest)"""

ORACLES = {"op1_decontaminate": DECONTAMINATE, "op3_ngram_join": NGRAM_JOIN, "op6_quality_rules": QUALITY, "op8_warc": WARC}
