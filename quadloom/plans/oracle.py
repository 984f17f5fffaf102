"""DuckDB SQL of the core queries, formulated apart from the engine."""

from __future__ import annotations

from quadloom.operators.metrics import BINS
from quadloom.plans import fixtures

_ESC = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_IRI = r'<[A-Za-z][A-Za-z0-9+.\-]*:(?:[^\x00-\x20<>"{}|^`\\]|' + _ESC + ")*>"
_BNODE = r"_:[A-Za-z0-9_](?:[A-Za-z0-9_.\-]*[A-Za-z0-9_\-])?"
_LIT = r'"(?:[^"\\\r\n]|\\[tbnrf"' + r"''\\]|" + _ESC + r')*"'
_XS = "http://types.example/xs#"
_TAIL = r"[ \t]*\.[ \t]*(?:#(?s:.*))?"
_OBJ = f"(?:{_IRI}|{_BNODE}|{_LIT}(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\\^\\^{_IRI})?)"
_S, _W = f"(?:{_IRI}|{_BNODE})", r"[ \t]*"
_NT = f"{_S}{_W}{_IRI}{_W}({_OBJ}){_TAIL}"
_NQ = f"{_S}{_W}{_IRI}{_W}({_OBJ}){_W}{_S}{_TAIL}"
_P5 = f"""
with l as (select line_id, fmt, line, trim(line, ' ' || chr(9) || chr(13)) as t from raw_lines),
m as (select *, case fmt when 'nt' then regexp_full_match(t, '{_NT}') when 'nq' then regexp_full_match(t, '{_NQ}') else false end as fits,
  case fmt when 'nt' then regexp_extract(t, '^{_NT}$', 1) when 'nq' then regexp_extract(t, '^{_NQ}$', 1) end as obj from l),
v as (select *, regexp_extract(obj, '^"((?s:.*))"\\^\\^<{_XS}([a-z]+)>$', 1) as val, regexp_extract(obj, '^"((?s:.*))"\\^\\^<{_XS}([a-z]+)>$', 2) as typ from m),
bad as (select line_id from v where line is null or not (t = '' or starts_with(t, '#') or (fits and case typ
  when 'integer' then regexp_full_match(val, '[+-]?[0-9]+')
  when 'decimal' then regexp_full_match(val, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')
  when 'boolean' then val in ('true', 'false', '1', '0')
  when 'date' then regexp_full_match(val, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(val as date) is not null
  else true end)))
"""

_CRAWL = "select distinct g, s, p, o from triples where g is not null and s is not null and p is not null and o is not null"
_GROUND = f"select * from ({_CRAWL}) where not starts_with(s, '_:') and not starts_with(o, '_:')"
_ORDERS = """
select '<orders>' as g, '<cust/' || o_custkey || '>' as s, '<placed>' as p, '_:o' || o_orderkey as o from orders
union all select '<orders>', '_:o' || o_orderkey, '<status>', '"' || o_orderstatus || '"' from orders
union all select '<orders>', '_:o' || o_orderkey, '<priority>', '"' || o_orderpriority || '"' from orders
"""
_KINDS = """select distinct l_orderkey as k, l_returnflag as f, l_linestatus as t, (l_discount > 0.05)::int as d,
  '_:l' || l_orderkey || 'x' || l_returnflag || 'x' || l_linestatus || 'x' || (l_discount > 0.05)::int as b from lineitem"""
_LINES = """
select '<lines>' as g, '<order/' || k || '>' as s, '<has>' as p, b as o from {0}
union all select '<lines>', b, '<flag>', '"' || f || '"' from {0}
union all select '<lines>', b, '<lstatus>', '"' || t || '"' from {0}
union all select '<lines>', b, '<discounted>', '"true"' from {0} where d = 1
"""
_SEGMENTS = """
with n as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events),
x as (select *, i // 4 as seg, lead(event_id) over (partition by user_id, i // 4 order by i) as nxt from n),
w as (select user_id, seg, string_agg(event_type, ' ' order by i) as word, count(*) as len, min('_:e' || event_id) as comp from x group by user_id, seg)
"""
_BYTE = lambda h, i: f"(('0x' || substr({h}, {2 * i + 1}, 2))::int)"
_LANE = lambda i: f"xor(((xor((({_BYTE('hs', i)} * 37) % 256), {_BYTE('hp', i)})) * 37) % 256, {_BYTE('ho', i)})"
_HASHED = f"(select *, md5(s) as hs, md5(p) as hp, md5(o) as ho from ({_GROUND}))"
_HEX = lambda x: f"lpad(lower(to_hex({x})), 2, '0')"
_BLANK = "d41d8cd98f00b204e9800998ecf8427e"
_REMOVED = """(select a.b, c.b as x from ({0}) a left join ({0}) c on a.d = 0 and c.d = 1 and a.k = c.k and a.f = c.f and a.t = c.t)""".format(_KINDS)
_EDGES = f"""(select g, s as node, '+' as sign, p, o as far from ({_CRAWL}) where starts_with(s, '_:')
  union all select g, o, '-', p, s from ({_CRAWL}) where starts_with(o, '_:'))"""


def _round(colours: str) -> str:
    """One round of the digest colours over the crawl, from a relation of (g, node, h)."""
    words = ", ".join(f"sum(('0x' || substr(eh, {8 * i + 1}, 8))::bigint)" for i in range(4))
    return f"""select k.g, k.node, md5(k.h || ',' || concat_ws(',', n, w[1], w[2], w[3], w[4])) as h from {colours} k join (
  select g, node, count(*) as n, [{words}] as w from (
    select e.g, e.node, md5(sign || p || chr(1) || coalesce(c.h, md5(far))) as eh from {_EDGES} e left join {colours} c on c.g = e.g and c.node = e.far)
  group by g, node) using (g, node)"""


_START = f"(select distinct g, node, md5('') as h from {_EDGES})"
_OK = "status is not null and status not in ('OK', 'NOBNODES')"


def _top(metric: str, value: str) -> str:
    return f"select op, '{metric}' as metric, ({value})::bigint as value, doc, status from run_metrics where ({value}) is not null qualify row_number() over (partition by op order by ({value}) desc, row_id) = 1"


_LOGGED = """select op, doc, triples, bnodes, runtime as ms, status, out_triples, out_bnodes, coalesce(joins, 0) as joins, coalesce(search_depth, 0)::bigint as depth, coalesce(solutions, 0) as solutions
from run_metrics where op = 'LEAN' and status = 'OK' and runtime >= 0 and doc is not null and triples is not null and bnodes is not null and out_triples is not null and out_bnodes is not null"""

_LOGGED_ALL = """select op, doc, triples, case when op = 'NOBNODES' then 0 else bnodes end as bnodes, runtime as ms, case when op = 'NOBNODES' then 'OK' else status end as status,
out_triples, out_bnodes, joins, search_depth::bigint as depth, solutions, rounds::bigint as rounds, leaves::bigint as leaves from run_metrics"""

SQL: dict[str, str] = {
    "p5_found": _P5 + "select line_id from bad",
    "rdf_direct_map_orders": _ORDERS,
    "rdf_direct_map_lines": _LINES.format(f"({_KINDS})"),
    "rdf_direct_map_nations": """select '<nations>' as g, '<nation/' || n_nationkey || '>' as s, '<inRegion>' as p, '<region/' || n_regionkey || '>' as o from nation
union all select '<nations>', '<nation/' || n_nationkey || '>', '<name>', '"' || n_name || '"' from nation""",
    "rdf_direct_map_paths": _SEGMENTS + """select '<paths/' || user_id || '/' || seg || '>' as g, '_:e' || event_id as s, '<type>' as p, '"' || event_type || '"' as o from x
union all select '<paths/' || user_id || '/' || seg || '>', '_:e' || event_id, '<next>', '_:e' || nxt from x where nxt is not null""",
    "statement_lines": f"select s || ' ' || p || ' ' || o || ' ' || g || ' .' as value from ({_CRAWL})",
    "scanned_statements": _CRAWL,
    "bench_cases": r"""select file_path, split_part(file_path, '/', -2) as family, try_cast(split_part(regexp_replace(split_part(file_path, '/', -1), '\.[A-Za-z]+$', ''), '-', -1) as int) as k
from bench_files where contains(split_part(file_path, '/', -1), '-') and not ends_with(file_path, '.zip')
and try_cast(split_part(regexp_replace(split_part(file_path, '/', -1), '\.[A-Za-z]+$', ''), '-', -1) as int) is not null""".replace("\\\\", "\\"),
    "run_log_round_trip": _LOGGED,
    "run_log_round_trip_all": _LOGGED_ALL,
    "ground_split": _GROUND,
    "bnode_link_rows": f"select * from ({_CRAWL}) where starts_with(s, '_:') and starts_with(o, '_:') and s <> o",
    "skolem_iris": "select g, " + ", ".join(f"case when starts_with({c}, '_:') then '<urn:bn:' || substr({c}, 3) || '>' else {c} end as {c}" for c in "so") + f", p from ({_CRAWL})",
    "term_parts": r"""with k as (select o, case left(o, 1) when '<' then 'iri' when '_' then 'bnode' when '"' then 'literal' end as kind, regexp_extract(o, '"(@[A-Za-z0-9-]+|\^\^<[^>]*>)$', 1) as suffix from triples where o is not null)
select kind, case when kind = 'literal' and left(suffix, 1) = '@' then substr(suffix, 2) end as lang, case when kind = 'literal' and left(suffix, 1) = '^' then substr(suffix, 4, length(suffix) - 4) end as datatype, count(*) as n from k group by all""".replace("\\\\", "\\"),
    "symmetrise_edges": "select user_id::varchar as a, event_type as b from events union select event_type, user_id::varchar from events",
    "triple_difference": " union all ".join(
        f"select *, '{side}' as side from (select g, s, p, o from triples where stmt_id % 2 = {a} except select g, s, p, o from triples where stmt_id % 2 = {1 - a})" for side, a in (("odd", 1), ("even", 0))
    ),
    "graphs_without_bnodes": f"select g, count(*) as n from ({_CRAWL}) group by g having not bool_or(starts_with(s, '_:') or starts_with(o, '_:'))",
    **{f"term_hash_{n}": f"select distinct o, {n}(o) as h from triples where o is not null" for n in ("md5", "sha1", "sha256")},
    "combine_ordered_triples": f"select g, s, p, o, {' || '.join(_HEX(_LANE(i)) for i in range(16))} as h from {_HASHED}",
    "ground_hash": f"select g, {' || '.join(_HEX(f'(sum({_LANE(i)}) + {int(_BLANK[2 * i : 2 * i + 2], 16)})::bigint % 256') for i in range(16))} as h from {_HASHED} group by g",
    "graph_term_stats": f"select g, p, count(*) as triples, count(distinct s) as subjects, count(distinct o) as objects from ({_CRAWL}) group by g, p",
    "bnode_counts": f"select g, count(distinct case when starts_with(t, '_:') then t end) as bnodes from (select g, s as t from ({_CRAWL}) union all select g, o from ({_CRAWL})) group by g",
    "control_counts": "select g, count(*) as statements from triples group by g",
    "control_runs": """with a as (select g, stmt_id, case when lag(stmt_id) over (order by stmt_id) is null or g is distinct from lag(g) over (order by stmt_id) then 1 else 0 end as new from triples),
b as (select g, sum(new) over (order by stmt_id) as run from a) select g, count(*) as statements from b group by g, run""",
    "crawl_components": f"""with recursive rows_ as ({_CRAWL}), nodes as (select g, s as node from rows_ where starts_with(s, '_:') union select g, o from rows_ where starts_with(o, '_:')),
links as (select g, s as a, o as b from rows_ where starts_with(s, '_:') and starts_with(o, '_:') union select g, o, s from rows_ where starts_with(s, '_:') and starts_with(o, '_:')),
least(g, node, m) using key (g, node) as (select g, node, node from nodes union
  select links.g, links.a, min(f.m) from least f join links on links.g = f.g and links.b = f.node join recurring.least r on r.g = links.g and r.node = links.a group by links.g, links.a having min(f.m) < any_value(r.m))
select g, node, m as comp from least""",
    "path_components": _SEGMENTS + "select '_:e' || event_id as node, comp from x join w using (user_id, seg)",
    "component_sizes": _SEGMENTS + "select comp, len as n from w",
    "colour_round_1": _round(_START),
    "colour_round_2": f"with one as ({_round(_START)}) {_round('one')}",
    "colour_classes_final": _SEGMENTS + "select '_:e' || event_id as node, min('_:e' || event_id) over (partition by word, i % 4) as least from x join w using (user_id, seg)",
    "iso_classes": _SEGMENTS + "select min('<paths/' || user_id || '/' || seg || '>') as g, count(*) as n from w group by word having count(*) > 1",
    "iso_dedup_graph": _SEGMENTS + ", u as (select word, any_value(len) as len from w group by word) select '<type>' as p, sum(len)::bigint as n from u union all select '<next>', sum(len - 1)::bigint from u",
    "iso_rank": _SEGMENTS + ", r as (select row_number() over (partition by word) as copy from w) select copy, count(*) as n from r group by copy",
    "label_orders_compat": "select '<orders>' as g, count(*) as bnodes, count(*) as parts, count(*) as labels, 'OK' as status from orders",
    "label_golden": "select * from (values " + ", ".join(f"('{a}', '<p>', '{b}')" for a, b in fixtures.GOLDEN_LABELLED) + ") t(s, p, o)",
    "lean_orders": f"with k as (select o_custkey, o_orderstatus, o_orderpriority, min('_:o' || o_orderkey) as b from orders group by all) select g, s, p, o from ({_ORDERS}) where s in (select b from k) or o in (select b from k)",
    "lean_apply_map": f"with k as (select o_custkey, o_orderstatus, o_orderpriority, min('_:o' || o_orderkey) as b from orders group by all) select g, s, p, o from ({_ORDERS}) where s in (select b from k) or o in (select b from k)",
    "lean_witness": "select '<orders>' as g, '_:o' || o_orderkey as bnode, min('_:o' || o_orderkey) over (partition by o_custkey, o_orderstatus, o_orderpriority) as term from orders",
    "lean_lines_superset": f"with gone as (select b from {_REMOVED} where x is not null) select * from ({_LINES.format(f'({_KINDS})')}) where s not in (from gone) and o not in (from gone)",
    "lean_paths": _SEGMENTS + "select '<paths/' || user_id || '/' || seg || '>' as g, 2 * len - 1 as triples, len as bnodes, 2 * len - 1 as out_triples, len as out_bnodes, 'OK' as status from w",
    "ground_candidates": f"select '<lines>' as g, b as bnode, b as term from ({_KINDS}) union select '<lines>', b, x from {_REMOVED} where x is not null",
    "fixed_bnodes": f"select '<lines>' as g, b as bnode from {_REMOVED} where x is null",
    **{name: "select * from (values " + ", ".join(f"('{k}', {v[2]}::bigint, {v[1]}::bigint, {v[4]}::bigint, {v[3]}::bigint)" for k, v in fixtures.FAMILIES.items()) + ") t(g, triples, bnodes, out_triples, out_bnodes)" for name in ("core_synthetic", "core_synthetic_bfs")},
    "runtime_bins": "select op, workload, case when runtime is null or runtime < 0 then 'none' " + " ".join(f"when runtime between {a} and {b} then '{a}-{b}'" for a, b in BINS) + " else 'over' end as bin, count(*) as n from run_metrics group by all",
    "run_totals": "select op, coalesce(status not in ('OK', 'NOBNODES'), false) as failed, coalesce(op = 'LEAN' and out_bnodes < bnodes, false) as leaned, count(*) as n, sum(triples)::bigint as sum_triples, sum(bnodes)::bigint as sum_bnodes, sum(runtime)::bigint as sum_runtime from run_metrics group by all",
    "argmax_stats": " union all ".join(f"({_top(m, v)})" for m, v in (("triples", "triples"), ("bnodes", "bnodes"), ("runtime", "runtime"), ("removed", "bnodes - out_bnodes"))),
    "exception_counts": f"select op, status, count(*) as n from run_metrics where {_OK} group by op, status",
    "both_times": """select doc, (coalesce(sum(greatest(runtime, 0)) filter (op = 'LEAN'), 0) + coalesce(sum(greatest(runtime, 0)) filter (op = 'LABEL'), 0))::bigint as ms from run_metrics where op in ('LEAN', 'LABEL') group by doc having count(*) filter (op = 'LEAN') > 0 and count(*) filter (op = 'LABEL') > 0""",
}
