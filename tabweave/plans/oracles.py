"""DuckDB SQL for the registered queries of the engine: ``ORACLES``."""

from __future__ import annotations

from tabweave.functions.text import ISO_DATE, KEY_NAME, MONTHS, NUMERIC, SHORT_MONTHS, SLASH_DATE, STOP_WORDS
from tabweave.plans.queries import GRIDS

ORACLES: dict[str, str] = {}
_B = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_TEMPORAL = r"(?i)(?:^|\b)(?:Q[1-4]|" + "|".join((*SHORT_MONTHS, *MONTHS)) + r"|\d{4}[-/]\d{1,2}|\d{4}|FY\s?\d{2,4}|H[12]|CY\s?\d{2,4})(?:\b|$)"
_TYPES = {"INT": ("r_regionkey", "n_nationkey", "n_regionkey", "s_suppkey", "s_nationkey", "c_custkey", "c_nationkey", "p_partkey", "p_size", "o_orderkey", "o_custkey", "event_id", "user_id", "doc_id", "quality", "toxic"), "FLOAT": ("s_acctbal", "c_acctbal", "p_retailprice", "o_totalprice", "value")}


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g')"


def _tokens(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-zA-Z0-9]+'), lambda t: length(t) >= 2 and t not in ({stop}))"


def _rx(java: str) -> str:
    return java.replace("(?U)", "").replace("'", "''")


def _cells(names: list[str] | None = None) -> str:
    """CTE bodies: c(table_id, row_idx, col_idx, v, t) and h(table_id, col_idx, name)."""
    cells, heads = [], []
    for name in names or GRIDS:
        table_id, order, columns = GRIDS[name]
        kinds = ["int" if c in _TYPES["INT"] else "float" if c in _TYPES["FLOAT"] else "str" for c in columns]
        cells.append(f"select {table_id} as table_id, row_idx, unnest(range({len(columns)})) as col_idx, unnest([{', '.join(f'{c}::varchar' for c in columns)}]) as v, unnest({kinds}) as t from (select *, row_number() over (order by {', '.join(order)}) - 1 as row_idx from {name})")
        heads += [f"({table_id}, {i}, '{c}')" for i, c in enumerate(columns)]
    return f"c as ({' union all '.join(cells)}), h(table_id, col_idx, name) as (values {', '.join(heads)})"


_DATA_TYPE = f"""case when v is null then 'empty' when t in ('int', 'float', 'bool') then 'numeric' when {_strip('v')} = '' then 'empty' when regexp_matches({_strip('v')}, '{_rx(NUMERIC)}') then 'numeric'
  when regexp_matches({_strip('v')}, '{_rx(ISO_DATE)}') or regexp_matches({_strip('v')}, '{_rx(SLASH_DATE)}') then 'date' else 'text' end"""

ORACLES["whitespace_normalize"] = f"select doc_id, {_strip(f'''regexp_replace(text, '{_B}+', ' ', 'g')''')} as text from documents"
ORACLES["merged_cell_fill"] = """
select user_id, event_id, coalesce(last_value(nullif(v, '') ignore nulls) over w, first_value(v) over w) as filled
from (select user_id, event_id, case event_type when 'click' then null when 'error' then '' else value::varchar end as v from events)
window w as (partition by user_id order by event_id rows between unbounded preceding and current row)"""
ORACLES["detect_types"] = f"with {_cells()} select table_id::bigint as table_id, col_idx::int as col_idx, {_DATA_TYPE} as data_type, count(*) as n from c group by 1, 2, 3"
ORACLES["header_similarity"] = f"""
with {_cells()}, p as (select distinct table_id, lower(unnest(string_split(name, '_'))) as x from h), k as (select table_id, count(*) as n from p group by 1),
m as (select x.table_id as a, y.table_id as b, count(*) as c from p x join p y on x.x = y.x and x.table_id < y.table_id group by 1, 2)
select a::bigint as a, b::bigint as b, c / (ka.n + kb.n - c) as similarity from m join k ka on ka.table_id = a join k kb on kb.table_id = b"""
ORACLES["merged_cells_table"] = """
with e as (
  select row_number() over (order by event_id) - 1 as row_idx, event_id::varchar as event_id, case event_type when 'click' then null when 'error' then '' else event_type end as kind, case when event_id % 3 = 1 then value::varchar end as value from events)
select row_idx, event_id, coalesce(last_value(nullif(kind, '') ignore nulls) over w, first_value(kind) over w) as kind, coalesce(last_value(value ignore nulls) over w, first_value(value) over w) as value
from e window w as (order by row_idx rows between unbounded preceding and current row)"""
ORACLES["stitched_tables"] = """
with recursive t as (select n_regionkey as d, n_nationkey as id, n_name as name, row_number() over (partition by n_regionkey order by n_nationkey) as p from nation),
f(d, p, head, first, other, name, nth) as (
  select d, p, id, p, p % 3 = 0, name, 0 from t where p = 1
  union all
  select t.d, t.p, case when (t.p % 3 = 0) = f.other then f.head else t.id end, case when (t.p % 3 = 0) = f.other then f.first else t.p end, t.p % 3 = 0, t.name, case when (t.p % 3 = 0) = f.other then f.nth + 1 else 0 end
  from f join t on t.d = f.d and t.p = f.p + 1)
select head::bigint as table_id, first::int as page_number, nth::bigint as row_idx, name from f"""

_PROFILE = f"""{_cells()},
s as (select *, {_strip("coalesce(v, '')")} as s from c),
f as (select *, regexp_matches(s, '{_rx(NUMERIC)}') as is_num, s = '' as is_empty from s),
pr as (
  select table_id, col_idx, count(*) as visited, count(*) filter (is_num) as n_numeric, count(*) filter (not is_num and not is_empty and regexp_matches(s, '{_rx(_TEMPORAL)}')) as n_temporal,
    count(*) filter (is_empty) as n_empty, count(distinct s) filter (not is_empty) as n_distinct from f group by 1, 2)"""
ORACLES["column_profile"] = f"with {_PROFILE} select table_id::bigint as table_id, col_idx::int as col_idx, visited::bigint as visited, n_numeric::bigint as n_numeric, n_temporal::bigint as n_temporal, n_empty::bigint as n_empty, n_distinct::bigint as n_distinct from pr"
_FEATURES = f"""{_PROFILE},
rr as (select table_id, count(*) as num_rows, count(*) filter (v like '%:') as labels, count(*) filter (regexp_matches(v, '^\\s')) as indented, count(*) filter (regexp_matches(v, '^\\s*\\d+[.\\-]')) as numbered,
  list(distinct lower({_strip('v')})) as starts from c where col_idx = 0 group by 1),
hh as (select table_id, count(*) as num_cols, count(*) filter (regexp_matches(name, '{_rx(_TEMPORAL)}')) as temporal_headers, count(*) filter (regexp_matches(name, '{_rx(KEY_NAME)}')) as key_columns, list(lower(name)) as names,
  first(name order by col_idx) as corner from h group by 1),
ct as (
  select table_id, string_agg(type, ',' order by col_idx) as col_types, count(distinct type) filter (col_idx > 0) as rest_types, max(u) as max_uniqueness, sum(n_numeric) / sum(visited) as density
  from (select pr.*, case when num_rows - n_empty = 0 then 'empty' when n_numeric / (num_rows - n_empty) >= 0.6 then 'numeric' when n_temporal / (num_rows - n_empty) >= 0.4 then 'date' else 'text' end as type,
    case when num_rows - n_empty = 0 then 0.0::double else n_distinct / (num_rows - n_empty) end as u from pr join rr using (table_id)) group by 1),
ft as (
  select table_id, num_rows, num_cols, num_rows / num_cols as ratio, col_types, rest_types, max_uniqueness, density, labels / num_rows as label_ratio, indented / num_rows as indent_ratio, numbered / num_rows as numbered_ratio,
    temporal_headers, key_columns, corner, case when num_rows >= 2 then len(list_intersect(starts, names)) / (len(starts) + len(names) - len(list_intersect(starts, names))) else 0.0::double end as overlap
  from rr join hh using (table_id) join ct using (table_id))"""
ORACLES["table_features"] = f"""with {_FEATURES}
select table_id::bigint as table_id, num_rows, num_cols, 1 as header_levels, ratio as row_col_ratio, ratio >= 0.7::double and ratio <= 1.3::double and num_rows >= 2 as is_square, col_types, max_uniqueness, density as numeric_density,
  label_ratio as col0_label_ratio, indent_ratio, numbered_ratio, temporal_headers::int as temporal_headers, key_columns::int as key_columns, overlap as header_overlap from ft"""


def _d(x: float) -> str:
    return f"{x}::double"


ORACLES["classify_tables"] = f"""with {_FEATURES},
sc as (
  select table_id,
    least(greatest(case num_cols when 2 then {_d(0.4)} when 3 then {_d(0.2)} else {_d(0.0)} end + label_ratio * {_d(0.3)} + {_d(0.1)} + case when density < {_d(0.8)} then {_d(0.2)} else {_d(0.0)} end, 0.0), 1.0) as key_value,
    case when num_rows >= 2 and num_cols >= 3 then {_d(0.3)} + case when length(corner) < 15 then {_d(0.1)} else {_d(0.0)} end + case when rest_types = 1 then {_d(0.4)} else {_d(0.0)} end else {_d(0.0)} end as comparison,
    case when num_cols >= 2 then case when temporal_headers / num_cols > {_d(0.5)} then {_d(0.6)} when temporal_headers / num_cols > {_d(0.2)} then {_d(0.3)} else {_d(0.0)} end + case when density > {_d(0.5)} then {_d(0.2)} else {_d(0.0)} end + {_d(0.2)} else {_d(0.0)} end as time_series,
    case when indent_ratio > {_d(0.3)} then {_d(0.7)} when indent_ratio > {_d(0.1)} then {_d(0.5)} else {_d(0.0)} end + case when numbered_ratio > {_d(0.5)} then {_d(0.3)} else {_d(0.0)} end as hierarchical,
    case when num_rows >= 2 and num_cols >= 2 then case when ratio >= {_d(0.7)} and ratio <= {_d(1.3)} then {_d(0.4)} else {_d(0.0)} end + case when overlap > {_d(0.5)} then {_d(0.3)} when overlap > {_d(0.2)} then {_d(0.1)} else {_d(0.0)} end + case when density > {_d(0.7)} then {_d(0.3)} else {_d(0.0)} end else {_d(0.0)} end as matrix,
    case when key_columns > 0 then {_d(0.4)} else {_d(0.0)} end + case when max_uniqueness > {_d(0.9)} then {_d(0.3)} else {_d(0.0)} end + case when ratio > {_d(2.0)} then {_d(0.3)} else {_d(0.0)} end as relational,
    case when num_cols >= 3 and density > {_d(0.6)} then {_d(0.2)} else {_d(0.0)} end as pv from ft),
r as (select table_id, unnest(['key_value', 'comparison', 'time_series', 'hierarchical', 'matrix', 'relational', 'pivot']) as name, unnest(range(7)) as nth, unnest([key_value, comparison, time_series, hierarchical, matrix, relational, pv]) as s from sc),
o as (select *, row_number() over (partition by table_id order by s desc, nth) as rank from r)
select sc.table_id::bigint as table_id, case when max(o.s) > 0 then first(o.name order by rank) else 'unknown' end as table_type, max(o.s) as confidence,
  coalesce(string_agg(o.name, ',' order by rank) filter (rank > 1 and o.s >= {_d(0.3)}), '') as secondary, key_value, comparison, time_series, hierarchical, matrix, relational, pv as "pivot"
from sc join o using (table_id) group by all"""

_KV = """n as (select *, row_number() over (order by n_nationkey) - 1 as r from nation)"""
ORACLES["kv_graph_nodes"] = f"""with {_KV}
select 1::bigint as graph_id, 'entity_0' as node_id, 0::bigint as node_ord, 'Entity' as label, 'name=Nation' as props
union all select 1, 'prop_' || r, r + 1, 'Property', 'key=' || n_name || '|value=' || n_regionkey from n"""
ORACLES["kv_graph_edges"] = f"with {_KV} select 1::bigint as graph_id, 'entity_0' as src, 'prop_' || r as dst, 0::bigint as src_ord, r::bigint as seq, 'HAS_PROPERTY' as label, 'key=' || n_name || '|value=' || n_regionkey as props from n"


def _grid(rows: str, cols: str, counted: str) -> str:
    return f"""a as ({counted}), rw as (select r, row_number() over (order by r) - 1 as i from (select distinct {rows} as r from a)), cl as (select c, row_number() over (order by c) as j from (select distinct {cols} as c from a)),
g as (select rw.r, i, cl.c, j, coalesce(n::varchar, 'None') as v from rw cross join cl left join a on a.r = rw.r and a.c = cl.c), k as (select count(*) as k from cl)"""


_BRANDS = _grid("r", "c", "select p_brand as r, p_type as c, count(*) as n from part group by 1, 2")
ORACLES["comparison_graph_edges"] = f"with {_BRANDS} select 0::bigint as graph_id, 'entity_' || j as src, 'attr_' || i as dst, (j - 1)::bigint as src_ord, i::bigint as seq, 'HAS_ATTRIBUTE' as label, 'value=' || v as props from g"
_YEARS = _grid("r", "c", "select o_orderpriority as r, year(o_orderdate)::varchar as c, count(*) as n from orders group by 1, 2")
ORACLES["timeseries_graph_edges"] = f"""with {_YEARS}
select 0::bigint as graph_id, 'time_' || j as src, 'time_' || (j + 1) as dst, (j - 1)::bigint as src_ord, 0::bigint as seq, 'NEXT' as label, '' as props from cl, k where j < k
union all select 0, 'metric_' || i, 'time_' || j, k + i, j, 'AT_TIME', 'value=' || v || '|metric=' || r || '|period=' || c from g, k"""
ORACLES["timeseries_graph_nodes"] = f"""with {_YEARS}
select 0::bigint as graph_id, 'time_' || j as node_id, (j - 1)::bigint as node_ord, 'TimePoint' as label, 'period=' || c as props from cl union all select 0, 'metric_' || i, k + i, 'Metric', 'name=' || r from rw, k"""
ORACLES["edge_labels_text"] = f"""with {_YEARS}
select 'time_' || j as src, 'time_' || (j + 1) as dst, '[NEXT]' as relation from cl, k where j < k
union all select 'metric_' || i, 'time_' || j, '[AT_TIME (value=' || v || ', metric=' || r || ', period=' || c || ')]' from g"""
ORACLES["comparison_graph_nodes"] = f"""with {_BRANDS}
select 0::bigint as graph_id, 'entity_' || j as node_id, (j - 1)::bigint as node_ord, 'Entity' as label, 'name=' || c as props from cl union all select 0, 'attr_' || i, k + i, 'Attribute', 'name=' || r from rw, k"""
ORACLES["graphml_text"] = f"""with {_YEARS},
n as (select 'time_' || j as id, j - 1 as o, 'TimePoint' as label, 'period' as k, c as v from cl union all select 'metric_' || i, k + i, 'Metric', 'name', r from rw, k),
nl as (
  select string_agg('    <node id="' || id || '">' || chr(10) || '      <data key="node_label">' || label || '</data>' || chr(10) || '      <data key="node_' || n.k || '">' || v || '</data>' || chr(10)
    || '      <data key="node__source_file">orders</data>' || chr(10) || '      <data key="node__table_index">0</data>' || chr(10) || '    </node>', chr(10) order by o) as t from n),
e as (
  select 'time_' || j as a, 'time_' || (j + 1) as b, j - 1 as o, 0 as q, '' as more, 'NEXT' as label from cl, k where j < k
  union all select 'metric_' || i, 'time_' || j, k + i, j, chr(10) || '      <data key="edge_value">' || v || '</data>' || chr(10) || '      <data key="edge_metric">' || r || '</data>' || chr(10) || '      <data key="edge_period">' || c || '</data>', 'AT_TIME' from g, k),
el as (select string_agg('    <edge source="' || a || '" target="' || b || '">' || chr(10) || '      <data key="edge_label">' || label || '</data>' || more || chr(10) || '    </edge>', chr(10) order by o, q) as t from e),
kl as (
  select string_agg('  <key id="' || f || '_' || k || '" for="' || f || '" attr.name="' || k || '" attr.type="string"/>', chr(10) order by f, k) as t
  from (values ('edge', 'label'), ('edge', 'metric'), ('edge', 'period'), ('edge', 'value'), ('node', '_source_file'), ('node', '_table_index'), ('node', 'label'), ('node', 'name'), ('node', 'period')) x(f, k))
select 0::bigint as graph_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' || chr(10) || kl.t || chr(10) || '  <graph edgedefault="directed">' || chr(10)
  || nl.t || chr(10) || el.t || chr(10) || '  </graph>' || chr(10) || '</graphml>' as text from kl, nl, el"""
ORACLES["wide_table_cells"] = f"""with {_YEARS} select r as "Priority", c as "year", v as "orders" from g"""

_PLACES = """pl as (
  select r_regionkey as k0, -1 as k1, -1 as k2, 0 as level, r_name as name, '' as balance from region
  union all select n_regionkey, n_nationkey, -1, 1, n_name, '' from nation
  union all select n_regionkey, n_nationkey, s_suppkey, 2, s_name, s_acctbal::varchar from supplier join nation on s_nationkey = n_nationkey),
p as (select *, row_number() over (order by k0, k1, k2) - 1 as r from pl),
e as (
  select b.r, a.r as a, b.level - a.level as up from p a join p b on a.k0 = b.k0 and a.level < b.level and (a.level = 0 or a.k1 = b.k1)
  union all select r, -1, level + 1 from p),
nodes as (select 'root' as id, 0 as o, 'Place' as name, null::varchar as balance union all select 'cat_' || r, r + 1, name, balance from p),
edges as (select case when a < 0 then 'root' else 'cat_' || a end as src, 'cat_' || r as dst, a + 1 as src_ord, r as seq, case when up = 1 then 'PARENT_OF' else 'ANCESTOR_OF' end as label from e)"""
ORACLES["hier_graph_edges"] = f"with {_PLACES} select 0::bigint as graph_id, src, dst, src_ord::bigint as src_ord, seq::bigint as seq, label, '' as props from edges"
ORACLES["hier_graph_nodes"] = f"with {_PLACES} select 0::bigint as graph_id, id as node_id, o::bigint as node_ord, 'Category' as label, 'name=' || name || case when id = 'root' then '' else '|Balance=' || balance end as props from nodes"
ORACLES["node_label_counts"] = f"""with {_YEARS}, x as (select count(*) as n from nation), y as (select (select count(*) from region) + (select count(*) from nation) + (select count(*) from supplier) + 1 as n)
select 'Entity' as label, 1::bigint as n union all select 'Property', n from x union all select 'TimePoint', k from k union all select 'Metric', count(*) from rw union all select 'Category', n from y"""

_TRADE = _grid("r", "c", "select ca.n_name as r, cb.n_name as c, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation ca on c_nationkey = ca.n_nationkey join nation cb on s_nationkey = cb.n_nationkey group by 1, 2")
ORACLES["matrix_graph_edges"] = f"""with {_TRADE},
o as (select id, min(o) as o from (select r as id, i as o from rw union all select c, j + {1 << 40} from cl) group by 1),
x as (select least(r, c) as a, greatest(r, c) as b, arg_min(v, i * {1 << 20} + j) as v, min(i * {1 << 20} + j) as seq from g where r <> c and v <> 'None' and v <> '0' group by 1, 2)
select 0::bigint as graph_id, case when oa.o < ob.o then a else b end as src, case when oa.o < ob.o then b else a end as dst, least(oa.o, ob.o)::bigint as src_ord, seq::bigint as seq, 'CONNECTED' as label, 'weight=' || v || '.0|value=' || v as props
from x join o oa on oa.id = a join o ob on ob.id = b"""
ORACLES["matrix_graph_nodes"] = f"""with {_TRADE}, o as (select id, min(o) as o from (select r as id, i as o from rw union all select c, j + {1 << 40} from cl) group by 1)
select 0::bigint as graph_id, id as node_id, o::bigint as node_ord, 'Node' as label, 'name=' || id as props from o"""
ORACLES["relational_graph_nodes"] = """
select 0::bigint as graph_id, 'entity_' || r as node_id, r::bigint as node_ord, 'Entity' as label, 'conv_id=' || conv_id || '|turn=' || turn || '|role=' || role || '|_entity_type=conv_id' as props
from (select *, row_number() over (order by conv_id, turn) - 1 as r from conversations)"""
ORACLES["relational_graph_edges"] = """
with c as (select conv_id, row_number() over (order by conv_id, turn) - 1 as r from conversations), l as (select conv_id, max(r) as t from c group by 1)
select 0::bigint as graph_id, 'entity_' || r as src, 'entity_' || t as dst, r::bigint as src_ord, 0::bigint as seq, 'REFERENCES' as label, 'via_column=conv_id' as props from c join l using (conv_id) where r <> t"""
ORACLES["relational_event_edges"] = """
with e as (select *, row_number() over (order by event_id) - 1 as r from events), k as (select event_id, max(r) as t from e group by 1)
select 6::bigint as graph_id, 'entity_' || r as src, 'entity_' || t as dst, r::bigint as src_ord, 2::bigint as seq, 'REFERENCES' as label, 'via_column=user_id' as props from e join k on e.user_id = k.event_id where r <> t"""

_QUANTITY = """q as (select l_returnflag as f, year(l_shipdate)::varchar as y, l_linestatus as s, sum(l_quantity)::varchar as v from lineitem group by all),
ys as (select y, row_number() over (order by y) - 1 as i from (select distinct y from q)), ss as (select s, row_number() over (order by s) - 1 as j from (select distinct s from q)),
ns as (select count(*) as ns from ss), nc as (select 1 + (select count(*) from ys) * (select count(*) from ss) as w),
cols as (select 1 + i * ns + j as c, y, s from ys, ss, ns),
h as (select c, 0 as level, y as name from cols union all select c, 1, s from cols),
d as (select level, name, row_number() over (order by min(c * 2 + level)) - 1 as n from h group by 1, 2), nd as (select count(*) as nd from d),
rs as (select f, row_number() over (order by f) - 1 as r from (select distinct f from q)), nr as (select count(*) as nr from rs),
m as (select *, row_number() over (order by r, c) - 1 as m from rs join q using (f) join cols using (y, s))"""
ORACLES["pivot_graph_nodes"] = f"""with {_QUANTITY}
select 0::bigint as graph_id, 'dim_' || n as node_id, n::bigint as node_ord, 'Dimension' as label, 'name=' || name || '|level=' || level as props from d
union all select 0, 'rowdim_' || r || '_0', nd + r, 'Dimension', 'name=' || f || '|level=-1|axis=row|category=Flag' from rs, nd
union all select 0, 'measure_' || m, nd + nr + m, 'Measure', 'value=' || v || '|row_context=' || f || '|col_context=' || y || ' | ' || s || '|row_from=' || f || '|col_dim_0=' || y || '|col_dim_1=' || s from m, nd, nr"""
ORACLES["pivot_graph_edges"] = f"""with {_QUANTITY}
select 0::bigint as graph_id, 'dim_' || a.n as src, 'dim_' || b.n as dst, a.n::bigint as src_ord, min(c * 2 + 1)::bigint as seq, 'HAS_SUBDIMENSION' as label, '' as props from cols join d a on a.level = 0 and a.name = y join d b on b.level = 1 and b.name = s group by 2, 3, 4
union all select 0, 'rowdim_' || r || '_0', 'measure_' || m, nd + r, 1 + m, 'AGGREGATED_BY', 'value=' || v from m, nd
union all select 0, 'dim_' || n, 'measure_' || m, n, w * 2 + m, 'AGGREGATED_BY', 'value=' || v from m join d on (level = 0 and name = y) or (level = 1 and name = s), nc"""

ORACLES["token_df"] = f"select token, count(*) as df from (select doc_id, unnest(list_distinct({_tokens('text')})) as token from documents) group by 1"
_POSTINGS = f"""{_PLACES},
nt as (
  select id as node_id, unnest(list_distinct(list_concat({_tokens('id')}, ['label', 'category', 'name'], {_tokens('name')}, case when id = 'root' then []::varchar[] else list_concat(['balance'], {_tokens('balance')}) end))) as token, 0 as kind, o::bigint as ord, 0::bigint as seq, 0 as endpoint from nodes),
et as (select src, dst, unnest({_tokens('label')}) as token, src_ord::bigint as ord, seq::bigint as seq from edges),
px as (select token, node_id, min({{'kind': kind, 'ord': ord, 'seq': seq, 'endpoint': endpoint}}) as place from (
  select token, node_id, kind, ord, seq, endpoint from nt union all select token, src, 1, ord, seq, 0 from et union all select token, dst, 1, ord, seq, 1 from et) group by 1, 2)"""
ORACLES["postings"] = f"with {_POSTINGS} select token, 0::bigint as graph_id, node_id, 1.0::double as weight, place.kind as kind, place.ord as ord, place.seq as seq, place.endpoint as endpoint from px"


ORACLES["context_weights"] = f"""with {_KV},
own as (
  select 'entity_0' as node_id, unnest(list_concat({_tokens("'entity_0'")}, ['label', 'entity', 'name', 'nation', 'has', 'property', 'key', 'value'])) as token
  union select 'entity_0', unnest({_tokens("n_name || ' ' || n_regionkey")}) from n
  union select 'prop_' || r, unnest(list_concat({_tokens("'prop_' || r || ' ' || n_name || ' ' || n_regionkey")}, ['label', 'property', 'has', 'key', 'value'])) from n),
said as (select unnest(list_distinct({_tokens("'Every nation with its region, as of 1997: FRANCE, GERMANY'")})) as token), ids as (select 'entity_0' as node_id union all select 'prop_' || r from n)
select token, node_id, 1.0::double as weight from own union all select token, node_id, 0.5::double from said, ids where not exists (select 1 from own where own.token = said.token and own.node_id = ids.node_id)"""


def _search(k: int) -> str:
    return f"""{_POSTINGS},
qt as (select s_suppkey as query_id, {_tokens("'What is the balance of ' || s_name")} as ts from supplier),
qq as (select query_id, token, min(pos) as pos, any_value(len(ts)) as n from (select query_id, ts, unnest(ts) as token, unnest(range(len(ts))) as pos from qt) group by 1, 2),
sc as (select query_id, node_id, count(*) / any_value(n) as score, min({{'pos': pos, 'place': place}}) as first from px join qq using (token) group by 1, 2),
seeds as (select * from (select query_id, node_id, score, row_number() over (partition by query_id order by score desc, first) as rank from sc) where rank <= {k})"""


ORACLES["keyword_search_topk"] = f"with {_search(5)} select query_id, rank::int as rank, 0::bigint as graph_id, node_id, score from seeds"
ORACLES["document_search_topk"] = f"""
with p as (select doc_id, unnest(list_distinct({_tokens('text')})) as token from documents),
qt as (select item_id as query_id, {_tokens('text')} as ts from benchmark),
qq as (select query_id, token, min(pos) as pos, any_value(len(ts)) as n from (select query_id, ts, unnest(ts) as token, unnest(range(len(ts))) as pos from qt) group by 1, 2),
sc as (select query_id, doc_id, count(*) / any_value(n) as score, min(pos) as pos from p join qq using (token) group by 1, 2)
select query_id, rank::int as rank, 0::bigint as graph_id, doc_id::varchar as node_id, score from (select *, row_number() over (partition by query_id order by score desc, pos, doc_id) as rank from sc) where rank <= 10"""

ORACLES["stored_search"] = f"""
with p as (
  select doc_id % 4 as g, doc_id, unnest(list_distinct(list_concat({_tokens('doc_id::varchar')}, ['label', 'document', 'text'], {_tokens("coalesce(text, '')")}))) as token from documents where doc_id % 4 <> 3),
qt as (select item_id as query_id, {_tokens('text')} as ts from benchmark),
qq as (select query_id, token, min(pos) as pos, any_value(len(ts)) as n from (select query_id, ts, unnest(ts) as token, unnest(range(len(ts))) as pos from qt) group by 1, 2),
sc as (select query_id, g, doc_id, count(*) / any_value(n) as score, min(pos) as pos from p join qq using (token) group by 1, 2, 3)
select query_id, rank::int as rank, g as graph_id, doc_id::varchar as node_id, score from (select *, row_number() over (partition by query_id order by score desc, pos, g, doc_id) as rank from sc) where rank <= 10"""


def _reach(k: int, edges: str) -> str:
    """Recursive CTE members: both(u, v) and reached sets by (start), up to k hops."""
    return f"both_ as (select src as u, dst as v from {edges} union all select dst, src from {edges})"


def _hops(k: int) -> str:
    return f"""with recursive {_PLACES}, t as (select src, dst from edges where label = 'PARENT_OF'), {_reach(k, 't')},
w(start, node, depth) as (select id, id, 0 from nodes where id <> 'root' union select w.start, b.v, w.depth + 1 from w join both_ b on b.u = w.node where w.depth < {k}),
m as (select start, node, min(depth) as depth from w group by 1, 2)
select start, depth, count(*) as n from m group by 1, 2"""


ORACLES["khop_1"] = _hops(1)
ORACLES["khop_2"] = _hops(2)


def _found(top_k: int, hops: int) -> str:
    return f"""with recursive {_search(top_k)}, {_reach(hops, 'edges')},
w(query_id, rank, node, depth) as (select query_id, rank, node_id, 0 from seeds union select w.query_id, w.rank, b.v, w.depth + 1 from w join both_ b on b.u = w.node where w.depth < {hops}),
m as (select distinct query_id, rank, node from w), fn as (select distinct query_id, node from m),
fe as (select distinct a.query_id, e.src, e.dst, e.label, e.src_ord, e.seq from edges e join m a on a.node = e.src join m b on b.node = e.dst and b.query_id = a.query_id and b.rank = a.rank)"""


ORACLES["retrieved_nodes"] = f"{_found(3, 1)} select query_id, node as node_id from fn"
ORACLES["induced_subgraph"] = f"{_found(3, 1)} select query_id, src, dst, label from fe"
ORACLES["remaining_nodes"] = f"""{_found(2, 2)}
select query_id, node as node_id from fn where not exists (select 1 from seeds s where s.query_id = fn.query_id and (s.node_id = fn.node or exists (
  select 1 from fe where fe.query_id = fn.query_id and ((fe.src = s.node_id and fe.dst = fn.node) or (fe.dst = s.node_id and fe.src = fn.node)))))"""
ORACLES["shortest_path_len"] = f"""with {_PLACES}, x as (select 'cat_' || r as id, level, k0, k1, k2 from p), s as (select id as start, k0 from x where level = 0)
select start, id as node, (case when s.k0 = x.k0 then level else level + 2 end)::int as hops from s, x union all select start, 'root', 1 from s"""

_SHOW = """dn as (select id, 'Category ''' || name || '''' || case when coalesce(balance, '') <> '' then ' (Balance=' || balance || ')' else '' end as sh from nodes)"""
_EDGE_LINES = f"""{_found(3, 1)}, {_SHOW},
ln as (select query_id, src_ord, seq, '- ' || a.sh || ' —[' || label || ']→ ' || b.sh as line from fe join dn a on a.id = src join dn b on b.id = dst)"""
ORACLES["edge_context_lines"] = f"{_EDGE_LINES} select query_id, line from ln"
_HEAD = """'## Graph Context (query: "What is the balance of ' || s_name || '")' || chr(10) || 'Strategy: {} | Nodes: ' || (select count(*) from fn where fn.query_id = s_suppkey) || ' | Edges: ' || (select count(*) from fe where fe.query_id = s_suppkey) || chr(10) || chr(10)"""
ORACLES["edge_centric_context"] = f"""{_EDGE_LINES}
select s_suppkey as query_id, {_HEAD.format('edge-centric')} || coalesce((select string_agg(line, chr(10) order by src_ord, seq) from ln where ln.query_id = s_suppkey) || chr(10), '') as context from supplier"""
_NODE_TEXT = f"""{_found(3, 1)}, {_SHOW},
ends as (select query_id, src as id, dst as nbr, label, '' as way from fe union all select query_id, dst, src, label, ' (inbound)' from fe),
cn as (select s.query_id, rank, string_agg('    - Category: ' || sh || ' via [' || e.label || ']' || way, chr(10) order by nbr) as t from seeds s join ends e on e.query_id = s.query_id and e.id = s.node_id join dn on dn.id = nbr group by 1, 2),
blocks as (
  select s.query_id, string_agg('### Category: ' || sh || ' (relevance: ' || printf('%.2f', score) || ')' || coalesce(chr(10) || '  Connected to:' || chr(10) || t, '') || chr(10), chr(10) order by s.rank) as text
  from seeds s join dn on dn.id = s.node_id left join cn on cn.query_id = s.query_id and cn.rank = s.rank group by 1)"""
ORACLES["node_centric_context"] = f"{_NODE_TEXT} select s_suppkey as query_id, {_HEAD.format('node-centric')} || text as context from supplier join blocks on blocks.query_id = s_suppkey"
ORACLES["path_centric_context"] = f"""{_found(3, 1)}, {_SHOW},
both_ways as (select query_id, src as u, dst as v, label, 0 as way from fe union all select query_id, dst, src, label, 1 from fe),
rel as (select query_id, u, v, arg_min(label, way) as label from both_ways group by 1, 2, 3),
pr as (select a.query_id, a.rank as i, b.rank as j, a.node_id as a, b.node_id as z from seeds a join seeds b on a.query_id = b.query_id and a.rank < b.rank),
md as (select pr.query_id, i, j, min(x.v) as m from pr join rel x on x.query_id = pr.query_id and x.u = a join rel y on y.query_id = pr.query_id and y.u = x.v and y.v = z group by 1, 2, 3),
st as (select pr.query_id, pr.i, pr.j, a, z, case when d.label is not null then null else m end as m, d.label as direct from pr left join rel d on d.query_id = pr.query_id and d.u = a and d.v = z left join md on md.query_id = pr.query_id and md.i = pr.i and md.j = pr.j),
pl2 as (
  select st.query_id, i, j, 'Path: ' || da.sh || ' —[' || case when direct is not null then direct else x.label || ']→ ' || dm.sh || ' —[' || y.label end || ']→ ' || dz.sh as line
  from st join dn da on da.id = a join dn dz on dz.id = z left join dn dm on dm.id = m left join rel x on x.query_id = st.query_id and x.u = a and x.v = m left join rel y on y.query_id = st.query_id and y.u = m and y.v = z
  where direct is not null or m is not null)
select s_suppkey as query_id, {_HEAD.format('path-centric')} || (select string_agg(line, chr(10) order by i, j) from pl2 where pl2.query_id = s_suppkey) || chr(10) as context from supplier"""
ORACLES["hit_rate"] = f"""{_NODE_TEXT},
x as (select s_nationkey, contains(lower(text), 'balance=' || s_acctbal::varchar) as hit from supplier join blocks on blocks.query_id = s_suppkey)
select s_nationkey, count(*) as asked, sum(hit::int)::bigint as hits from x group by rollup (s_nationkey)"""

_CHUNKS = " union all ".join(
    f"select {t} as t, row_number() over (order by {', '.join(order)}) - 1 as i, '{name}' as name, '{' | '.join(columns)}' as h, concat_ws(' | ', {', '.join(f"coalesce({c}::varchar, 'None')" for c in columns)}) as cells from {name}"
    for name, (t, order, columns) in GRIDS.items()
)
ORACLES["flat_chunk_best"] = f"""
with ch as ({_CHUNKS}),
c as (select t, i, '[' || name || ' Row ' || i || '] ' || h || ' => ' || cells as chunk from ch),
x as (select s_suppkey as query_id, t, i, chunk, len(list_filter(list_distinct(string_split(lower('What is the balance of ' || s_name), ' ')), lambda w: contains(lower(chunk), w)))::bigint as score from supplier, c)
select query_id, score, chunk from x where score > 0 qualify row_number() over (partition by query_id order by score desc, t, i) = 1"""
ORACLES["latency_stats"] = """
with e as (select event_type, 0 as is_total, value from events union all select null, 1, value from events), g as (select event_type, is_total, list(value order by value) as v from e group by 1, 2)
select event_type, is_total, len(v)::bigint as n, round(list_avg(v), 6) as mean, v[floor(len(v) / 2)::int + 1] as median, v[floor(len(v) * 0.95::double)::int + 1] as p95 from g"""
ORACLES["token_budget"] = r"""
select doc_id, case when length(text) > 400 then regexp_replace(text[:400], '\n[^\n]*\z', '') || chr(10) || '... (truncated)' else text end as text from documents"""

ORACLES["cypher_lines"] = f"""with {_KV}
select 1::bigint as graph_id, 0 as section, 0::bigint as a, 0::bigint as b, '// Cypher generated from tables' || chr(10) as line union all select 1, 2, 0, 0, '' union all select 1, 4, 0, 0, ''
union all select 1, 1, 0, 0, 'MERGE (entity_0:Entity {{name: ''Nation'', _id: ''entity_0''}})'
union all select 1, 1, r + 1, 0, 'MERGE (prop_' || r || ':Property {{key: ''' || n_name || ''', value: ''' || n_regionkey || ''', _id: ''prop_' || r || '''}})' from n
union all select 1, 3, 0, r, 'MERGE (entity_0)-[:HAS_PROPERTY {{key: ''' || n_name || ''', value: ''' || n_regionkey || '''}}]->(prop_' || r || ')' from n"""
ORACLES["markdown_lines"] = f"""with {_KV}
select 1::bigint as graph_id, 0 as section, 0::bigint as a, 0::bigint as b, '## Table Graph (from nation)' || chr(10) as line union all select 1, 1, 0, 0, '**Type:** key_value (confidence: 1.00)' || chr(10)
union all select 1, 2, 0, 0, '### Nodes' || chr(10) union all select 1, 3, 0, 0, '  - **Entity** `entity_0`: name: Nation' union all select 1, 3, r + 1, 0, '  - **Property** `prop_' || r || '`: key: ' || n_name || ', value: ' || n_regionkey from n where r + 1 < 10
union all select 1, 4, 0, 0, '  - ... (' || (count(*) + 1 - 10) || ' more nodes)' from n union all select 1, 5, 0, 0, chr(10) || '### Relationships' || chr(10)
union all select 1, 6, 0, r, '  - `entity_0` —[HAS_PROPERTY]→ `prop_' || r || '`: key: ' || n_name || ', value: ' || n_regionkey from n where r < 10 union all select 1, 7, 0, 0, '  - ... (' || (count(*) - 10) || ' more relationships)' from n union all select 1, 8, 0, 0, ''"""
ORACLES["json_text"] = f"""with {_KV},
x as (
  select string_agg('{{"id":"prop_' || r || '","label":"Property","key":"' || n_name || '","value":"' || n_regionkey || '"}}', ',' order by r) as nodes, count(*) as c,
    string_agg('{{"source":"entity_0","target":"prop_' || r || '","label":"HAS_PROPERTY","key":"' || n_name || '","value":"' || n_regionkey || '"}}', ',' order by r) as edges from n)
select 1::bigint as graph_id, '{{"metadata":{{"source_file":"nation","table_index":0,"table_type":"key_value","confidence":1.0,"node_count":' || (c + 1) || ',"edge_count":' || c || ',"graph_type":"digraph"}},"nodes":[{{"id":"entity_0","label":"Entity","name":"Nation"}},'
  || nodes || '],"edges":[' || edges || ']}}' as text from x"""
ORACLES["graph_summary"] = """
select 1::bigint as graph_id, 'TableGraph: ' || (count(*) + 1) || ' nodes, ' || count(*) || ' edges' || chr(10) || '  Type: digraph' || chr(10) || '  Classification: key_value (confidence=1.00)' || chr(10) || '  Source: nation pNone' || chr(10)
  || '  Node types: Entity, Property' || chr(10) || '  Edge types: HAS_PROPERTY' as text from nation"""

ORACLES["markdown_parse"] = rf"""
with n as (
  select (-1 - n_regionkey)::bigint as doc_id, 'Nations' || chr(10) || '| key | name |' || chr(10) || '|---|:-:|' || chr(10) || string_agg('|' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) || chr(10) || 'end' as text from nation group by 1),
d as (select doc_id, text from documents union all select * from n),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from d),
g as (select *, sum(case when contains(line, '|') then 0 else 1 end) over (partition by doc_id order by i) as block from l),
r as (select doc_id, block, i, list_transform(string_split(line, '|')[2:-2], lambda c: {_strip('c')}) as cells from g where contains(line, '|')),
k as (select * from r where len(list_filter(cells, lambda c: not regexp_matches(c, '^[-:]*$'))) > 0),
t as (select *, dense_rank() over (partition by doc_id order by block) - 1 as tbl, row_number() over (partition by doc_id, block order by i) - 2 as row_idx from k)
select doc_id * 1048576 + tbl as table_id, row_idx, array_to_string(cells, '¦') as cells from t"""
ORACLES["html_table_parse"] = """
with s as (select *, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as r from supplier)
select s_nationkey::bigint as doc_id, r as row_idx, unnest(range(3))::int as col_idx, unnest([s_suppkey::varchar, s_name, s_acctbal::varchar]) as v, unnest(['int', 'str', 'float']) as t from s"""
ORACLES["html_pages"] = """
select page_id, unnest([0, 0, 1, 1])::bigint as row_idx, unnest([0, 1, 0, 1])::int as col_idx, unnest(['id', page_id::varchar, 'url', regexp_replace(url, '\\s+', ' ', 'g')]) as v, 'str' as t from pages where contains(html, '</body>')"""
ORACLES["header_rows"] = """
select n_regionkey::bigint as doc_id, (case when n_regionkey % 2 = 0 then 2 else 3 end)::int as n_headers, count(*)::int as n_rows, n_regionkey % 2 = 1 as staggered from nation group by n_regionkey"""
ORACLES["continuation_merge"] = """
with recursive t as (
  select n_regionkey as d, row_number() over (partition by n_regionkey order by n_nationkey) as p, case when row_number() over (partition by n_regionkey order by n_nationkey) % 3 = 0 then 'other¦names' else 'key¦name' end as h,
    n_nationkey % 2 = 0 as cut, n_nationkey || '¦' || n_name as row from nation),
f(d, p, head, chain, cut, cells) as (
  select d, p, h, p, cut, row from t where p = 1
  union all
  select t.d, t.p, case when t.h = f.head or f.cut then f.head else t.h end, case when t.h = f.head or f.cut then f.chain else t.p end, t.cut,
    case when t.h = f.head then f.cells || '¦' || t.row when f.cut then f.cells || '¦' || t.h || '¦' || t.row else t.row end
  from f join t on t.d = f.d and t.p = f.p + 1)
select d::bigint as doc_id, max(p)::int as page_number, any_value(head) as headers, arg_max(cells, p) as cells from f group by d, chain"""
ORACLES["context_window_words"] = """
with w as (select l_orderkey as d, 'p' || l_partkey as text, l_linenumber * 1000000 + l_partkey as o, l_quantity as top from lineitem where l_orderkey in (select o_orderkey from orders)),
a as (select *, row_number() over (partition by d order by o desc) as n from w where top + 1 <= 20), b as (select *, row_number() over (partition by d order by o) as n from w where top >= 30),
x as (select d, 0 as side, string_agg(text, ' ' order by o, text) as s from a where n <= 3 group by 1 union all select d, 1, string_agg(text, ' ' order by o, text) from b where n <= 3 group by 1)
select d as doc_id, string_agg(s, ' | ' order by side) as context from x group by 1"""
ORACLES["spatial_word_cell"] = """
with w as (select l_orderkey as d, l_linenumber * 1000000 + l_partkey as o, l_partkey::varchar as text, l_discount * 100 as x, l_quantity as y from lineitem),
r(r, y0, y1) as (values (0, 0.0::double, 16.5::double), (1, 16.5, 33.5), (2, 33.5, 51.0)), c(c, x0, x1) as (values (0, 0.0::double, 4.5::double), (1, 4.5, 10.0)),
k as (select o_orderkey as d, r, c, coalesce(string_agg(text, ' ' order by o, text), '') as s from orders cross join r cross join c left join w on w.d = o_orderkey and y between y0 and y1 and x between x0 and x1 group by 1, 2, 3),
l as (select d, r, string_agg(s, '¦' order by c) as s from k group by 1, 2)
select d as table_id, first(s order by r) as headers, string_agg(s, '/' order by r) filter (r > 0) as rows from l group by 1"""
ORACLES["row_numbers"] = "select row_number() over (order by o_totalprice desc, o_orderkey) - 1 as row_idx, o_orderkey::varchar as o_orderkey from orders"
ORACLES["ruled_tables"] = """
with l as (select l_orderkey as d, l_linenumber as ln, l_partkey as pk, l_returnflag as m, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as n from lineitem),
g as (select *, case when lag(m) over (partition by d order by n) = m then 0 else 1 end as first from l),
r as (select *, sum(first) over (partition by d order by n) as run from g),
t as (select d, n, case when first = 1 then string_agg(m, '/') over (partition by d, run) else '-' end || '|' || ln || '|' || pk as cells from r)
select d as doc_id, 0 as table_index, 0 as row, 'flag|line and part|-' as cells from (select distinct d from t) union all select d, 0, n::int, cells from t"""
ORACLES["as_of_orders"] = """
with e as (select event_id, user_id, date '1992-01-01' + (event_id % 2500)::int as at from events),
o as (select o_custkey, o_orderdate::date as day, max(o_orderkey) as k from orders group by 1, 2), d as (select day, max(k) as k from o group by 1)
select event_id, o.k::varchar as own_order, o.day::varchar as own_day, d.k::varchar as last_order
from e asof left join o on e.user_id = o.o_custkey and e.at >= o.day asof left join d on e.at >= d.day"""
