"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_P1 = """
with t as (select count(distinct g) as graphs from triples),
c as (select p, count(*) as occurrences, count(distinct g) as records from triples where p is not null and g is not null group by p)
select p, occurrences, records, case when records <= 2 then 'rare' when records > 0.3 * graphs then 'common' end as mark from c, t
"""
_P4 = """
with v as (
  select op, workload, 'runtime' as field_name, runtime as v from run_metrics where workload is not null and runtime >= 0
  union all select op, workload, 'bnodes', bnodes from run_metrics where workload is not null and bnodes >= 0),
r as (select *, row_number() over (partition by op, workload, field_name order by v) as i, count(*) over (partition by op, workload, field_name) as n from v)
"""
# Characters that separate words, and those that end a sentence.
_BLANKS = r"\x09-\x0d\x1c-\x20\x{a0}"
_STOPS = r"[.!?…。！？．।॥؟۔։።၊။]"
_P8 = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
l as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\r\n]'), lambda x: regexp_matches(x, '[^{_BLANKS}]')) as l, regexp_replace(text, '[{_BLANKS}]', '', 'g') as signs from t),
c as (select doc_id, len(l) as lines, len(regexp_extract_all(text, '[^{_BLANKS}]+')) as words, length(signs) as chars,
  length(regexp_replace(signs, '\P{{L}}', '', 'g')) as letters, length(regexp_replace(signs, '[\p{{L}}\p{{N}}]', '', 'g')) as symbols,
  len(list_filter(l, lambda x: regexp_matches(x, '{_STOPS}[”"''»’)*_」』]*[\x{{200b}}\x{{feff}}]*[{_BLANKS}]*$'))) as stops from l)
select doc_id, lines, words, chars::double / nullif(words, 0) as mean_word_length, letters::double / nullif(chars, 0) as letter_ratio,
  symbols::double / nullif(chars, 0) as symbol_ratio, stops::double / nullif(lines, 0) as punctuated_share from c
"""

SQL: dict[str, str] = {
    "p1_found": f"select p, mark from ({_P1}) where mark is not null",
    "p1_counts": _P1,
    "p2_found": "select o from triples where o is not null and not starts_with(o, '_:') group by o having count(*) >= 0.005 * (select count(*) from triples)",
    "p2_top": "select o, count(*) as n from triples where o is not null group by o order by n desc, o limit 100",
    "p3_found": """
with recursive rows_ as (select distinct g, s, o from triples where g is not null and s is not null and p is not null and o is not null and (starts_with(s, '_:') or starts_with(o, '_:'))),
nodes as (select g, s as node from rows_ where starts_with(s, '_:') union select g, o from rows_ where starts_with(o, '_:')),
links as (select g, s as a, o as b from rows_ where starts_with(s, '_:') and starts_with(o, '_:') and s <> o
  union select g, o, s from rows_ where starts_with(s, '_:') and starts_with(o, '_:') and s <> o),
least(g, node, m) using key (g, node) as (
  select g, node, node from nodes
  union
  select links.g, links.a, min(f.m) from least f join links on links.g = f.g and links.b = f.node join recurring.least r on r.g = links.g and r.node = links.a
  group by links.g, links.a having min(f.m) < any_value(r.m))
select g, m as group_node, node from least""",
    "p8_counts": _P8,
    "p4_found": f"{_P4} select op, workload, field_name, pct::int as pct from r, (values (50), (95), (99)) q(pct) "
    "where n >= 50 and i = (pct * n + 99) // 100 and v >= 1000",
    "p4_sketch": f"{_P4}, b as (select *, ceil(ln(v) / {{ln_gamma}})::int as b from r where v > 0) "
    "select op, workload, field_name, 1 as sign, b as bucket, count(*) as n from b group by op, workload, field_name, b "
    "union all select op, workload, field_name, 0, 0, count(*) from r where v = 0 group by op, workload, field_name",
}
SQL["p4_sketch"] = SQL["p4_sketch"].replace("{ln_gamma}", "ln((1 + 0.005::double) / (1 - 0.005::double))")
