"""SQL of the checking engine for the operators that SQL can express, written without their methods."""

from __future__ import annotations

from .hostrules import HOST_LIMIT, RULES

_WORDS = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: Exact links of all pairs that share a shingle, and what is reachable over them.
NEAR_DUPLICATES = f"""with recursive d as (select doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0) group by all),
n as (select doc_id, count(*) as n from s group by 1),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 85 * (nx.n + ny.n - k)),
edges as (select x, y from links union all select y, x from links),
reach as (select doc_id as v, doc_id as r from n union select b.x, reach.r from edges b join reach on reach.v = b.y)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.r, d.doc_id) as component_id, coalesce(c.r, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join (select v, min(r) as r from reach group by 1) c on c.v = d.doc_id"""

_ANY = " or ".join(f"({r})" for r in RULES.values())
_BASE = f"(({RULES['few_words']}) or ({RULES['repeated']}))"

HOST_RULES = f"""with d as (select doc_id, source as host, coalesce(text, '') as t from documents),
w as (select doc_id, host, t, {_WORDS.format(t='t')} as ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as ls from d),
g as (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
twice as (select doc_id, i from g qualify count(*) over (partition by doc_id, a, b, c) > 1),
rep as (select doc_id, count(distinct i + k) as n from twice cross join (values (0), (1), (2)) o(k) group by 1),
counts as (select w.doc_id, host, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, len(ls) as n_lines from w left join rep on rep.doc_id = w.doc_id),
hosts as (select host, count(*) as k, sum(case when {_ANY} then 1 else 0 end) as x from counts group by 1),
total as (select sum(k)::double as n, sum(x)::double as x, count(*) as h, sum(k * k)::double as n2, sum(x * x / k::double) as r2 from hosts),
prior as (select x / n as mean, (r2 - x * (x / n) - (h - 1) * (x / n) * (1 - x / n)) / nullif(n - n2 / n, 0) as var from total),
beta as (select mean, greatest(1, least(1000, coalesce(mean * (1 - mean) / nullif(greatest(var, 0), 0) - 1, 1000))) as strength from prior),
rates as (select host, round((x + mean * strength) / (k + strength), 9) as host_rate from hosts cross join beta)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE} as base_failed, not {_BASE} and (host_rate < {HOST_LIMIT} or not ({_ANY})) as kept, host_rate
from counts c join rates r on r.host is not distinct from c.host"""
