"""Graphs from tables: one builder per archetype, each for all tables of its type at once.

Nodes carry ``node_ord``, the order in which a node is made within its graph; edges carry (``src_ord``, ``seq``): the order
of the source node and of insertion within it. All three come from row and column numbers, so no builder sorts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.props import last_wins, prop, props
from tabweave.functions.text import float_repr, is_key_name, lstrip, python_float, strip
from tabweave.operators.normalize import PART_ROWS
from tabweave.plans.shared import hold
from tabweave.schema import PROPS, GraphSet, TableSet

NODE_COLUMNS = ("graph_id", "node_id", "node_ord", "label", "props")
EDGE_COLUMNS = ("graph_id", "src", "dst", "src_ord", "seq", "label", "props")
Built = tuple[DataFrame, DataFrame]


def cell(i: Column | int, none: str, missing: str = "") -> Column:
    """The printed cell i of ``cells``: ``none`` for a null, ``missing`` beyond the row's end."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when(i < F.size("cells"), F.coalesce(F.get("cells", i)["v"], F.lit(none))).otherwise(F.lit(missing))


def node(node_id: Column, node_ord: Column, label: str | Column, *items: Column) -> list[Column]:
    label = F.lit(label) if isinstance(label, str) else label
    return [F.col("table_id").alias("graph_id"), node_id.alias("node_id"), node_ord.cast("long").alias("node_ord"), label.alias("label"), props(*items).alias("props")]


def edge(src: Column, dst: Column, src_ord: Column, seq: Column, label: str | Column, *items: Column) -> list[Column]:
    label = F.lit(label) if isinstance(label, str) else label
    return [F.col("table_id").alias("graph_id"), src.alias("src"), dst.alias("dst"), src_ord.cast("long").alias("src_ord"), seq.cast("long").alias("seq"), label.alias("label"), props(*items).alias("props")]


def numbered(prefix: str, i: Column) -> Column:
    return F.concat(F.lit(prefix), i.cast("string"))


def _split(ts: TableSet) -> tuple[DataFrame, DataFrame]:
    """Tables with their first header row h0, and rows joined to it."""
    t = ts.tables.withColumn("h0", F.coalesce(F.get("headers", F.lit(0)), F.array().cast("array<string>")))
    return t, ts.rows.join(t.select("table_id", "headers", "h0"), "table_id")


def key_value(ts: TableSet) -> Built:
    """A row is a property of the one entity that the first header names."""
    t, rows = _split(ts)
    r = F.col("row_idx")
    key, value = cell(0, "None"), cell(1, "None")
    nodes = t.select(*node(F.lit("entity_0"), F.lit(0), "Entity", prop("name", F.when(F.size("h0") > 0, F.get("h0", F.lit(0))).otherwise("Entity"))))
    nodes = nodes.unionByName(rows.select(*node(numbered("prop_", r), r + 1, "Property", prop("key", key), prop("value", value))))
    return nodes, rows.select(*edge(F.lit("entity_0"), numbered("prop_", r), F.lit(0), r, "HAS_PROPERTY", prop("key", key), prop("value", value)))


def _header_nodes(t: DataFrame, prefix: str, label: str, key: str) -> DataFrame:
    return t.select("table_id", F.posexplode("h0").alias("c", "h")).where("c >= 1").select(*node(numbered(prefix, F.col("c")), F.col("c") - 1, label, prop(key, F.col("h"))))


def _row_by_header(rows: DataFrame) -> DataFrame:
    """Each row once per header column but the first."""
    return rows.select("table_id", "row_idx", "cells", "h0", F.posexplode("h0").alias("c", "h")).where("c >= 1")


def _first_cell(prefix: str) -> Column:
    return F.when(F.size("cells") > 0, cell(0, "None")).otherwise(numbered(prefix, F.col("row_idx")))


def comparison(ts: TableSet) -> Built:
    """Columns are entities, rows attributes, cells the edges between them."""
    t, rows = _split(ts)
    r, c = F.col("row_idx"), F.col("c")
    entities = F.greatest(F.size("h0") - 1, F.lit(0))
    nodes = _header_nodes(t, "entity_", "Entity", "name").unionByName(rows.select(*node(numbered("attr_", r), entities + r, "Attribute", prop("name", _first_cell("row_")))))
    return nodes, _row_by_header(rows).select(*edge(numbered("entity_", c), numbered("attr_", r), c - 1, r, "HAS_ATTRIBUTE", prop("value", cell(c, "None"))))


def time_series(ts: TableSet) -> Built:
    """Columns are points in time, in a chain; rows are metrics with a value at each."""
    t, rows = _split(ts)
    r, c = F.col("row_idx"), F.col("c")
    times = F.greatest(F.size("h0") - 1, F.lit(0))
    metric = _first_cell("metric_")
    nodes = _header_nodes(t, "time_", "TimePoint", "period").unionByName(rows.select(*node(numbered("metric_", r), times + r, "Metric", prop("name", metric))))
    chain = t.select("table_id", "h0", F.posexplode("h0").alias("c", "h")).where((c >= 1) & (c < F.size("h0") - 1))
    edges = chain.select(*edge(numbered("time_", c), numbered("time_", c + 1), c - 1, F.lit(0), "NEXT"))
    at = _row_by_header(rows).select(*edge(numbered("metric_", r), numbered("time_", c), F.size("h0") - 1 + r, c, "AT_TIME", prop("value", cell(c, "None")), prop("metric", metric), prop("period", F.col("h"))))
    return nodes, edges.unionByName(at)


def ancestors(levels: DataFrame, depth: Column | str = "depth", part_rows: int = PART_ROWS) -> DataFrame:
    """table_id, row_idx, ancestor, above of an indented list with columns table_id, row_idx and a depth: every ancestor of a row (its row
    number, -1 for the root) with how many rows of the chain lie between (0: the parent).

    A row's ancestor at level L is the last row before it whose level is at most L, if that level is L. So for each smaller level
    one running maximum gives it, and the pairs number rows times depth of the tree. A table is cut into parts of ``part_rows`` rows: each
    part's maximum of every level is carried over the parts that follow, and within a part the maximum runs on its own."""
    d = levels.withColumn("_d", F.col(depth) if isinstance(depth, str) else depth)
    by_depth = d.select("table_id", "_d").distinct().withColumn("_level", F.dense_rank().over(Window.partitionBy("table_id").orderBy("_d")) - 1)
    most = by_depth.groupBy("table_id").agg(F.max("_level").alias("_most"))
    lev = d.join(by_depth, ["table_id", "_d"]).join(most, "table_id").select("table_id", "row_idx", F.floor(F.col("row_idx") / part_rows).alias("_part"), F.col("_level").alias("level"), "_most")
    lev = hold(lev)
    # each row asks at the levels below its own, and is seen at its own level and deeper ones
    own = F.when(F.col("level") <= F.col("at"), F.struct("row_idx", "level"))
    laid = lambda df: df.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("_most"))))
    ends = laid(lev).groupBy("table_id", "_part", "at").agg(F.max(own).alias("s"))
    over = Window.partitionBy("table_id", "at").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("s", F.max("s").over(over)).where("s is not null").groupBy("table_id", "_part").agg(F.map_from_entries(F.collect_list(F.struct("at", "s"))).alias("_up"))
    each = laid(lev.repartition("table_id", "_part").join(carried, ["table_id", "_part"], "left"))
    before = Window.partitionBy("table_id", "_part", "at").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(own).over(before), F.try_element_at("_up", F.col("at")))
    found = each.withColumn("s", seen).where((F.col("at") < F.col("level")) & (F.col("s.level") == F.col("at"))).select("table_id", "row_idx", F.col("s.row_idx").alias("ancestor"))
    roots = lev.select("table_id", "row_idx", F.lit(-1).cast("long").alias("ancestor"))
    up = Window.partitionBy("table_id", "row_idx").orderBy(F.desc("ancestor"))
    return found.unionByName(roots).withColumn("above", F.row_number().over(up) - 1)


def hierarchical(ts: TableSet) -> Built:
    """Rows are categories under the last row above with a smaller indent, and under all its ancestors and the root."""
    t, rows = _split(ts)
    r = F.col("row_idx")
    raw = F.when(F.size("cells") > 0, F.coalesce(F.get("cells", F.lit(0))["v"], F.lit(""))).otherwise("")
    named = rows.withColumn("raw", raw).withColumns({"name": lstrip(F.col("raw")), "depth": F.length("raw") - F.length(lstrip(F.col("raw")))})
    others = F.transform(
        F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))),
        lambda c, i: F.struct(F.coalesce(F.get("h0", i + 1), numbered("col_", i + 1)).alias("k"), F.coalesce(c["v"], F.lit("")).alias("v"), F.lit("str").alias("t")),
    )
    category = node(numbered("cat_", r), r + 1, "Category")
    category[4] = last_wins(F.concat(props(prop("name", F.col("name"))), others)).cast(PROPS).alias("props")
    nodes = t.select(*node(F.lit("root"), F.lit(0), "Category", prop("name", F.when(F.size("h0") > 0, F.get("h0", F.lit(0))).otherwise("Root")))).unionByName(named.select(*category))
    tree = ancestors(named.select("table_id", "row_idx", "depth"))
    a = F.col("ancestor")
    kind = F.when(F.col("above") == 0, "PARENT_OF").otherwise("ANCESTOR_OF")
    return nodes, tree.select(*edge(F.when(a < 0, "root").otherwise(numbered("cat_", a)), numbered("cat_", r), a + 1, r, kind))


def matrix(ts: TableSet) -> Built:
    """Row and column labels are nodes; a cell with a number other than 0 connects two of them, the first of both triangles."""
    t, rows = _split(ts)
    r, c = F.col("row_idx"), F.col("c")
    label = F.when((F.size("cells") > 0) & F.get("cells", F.lit(0))["v"].isNotNull(), F.get("cells", F.lit(0))["v"]).otherwise(numbered("row_", r))
    big = 1 << 40  # column labels come after all row labels
    seen = rows.select("table_id", label.alias("node_id"), r.alias("o")).unionByName(t.select("table_id", F.posexplode("h0").alias("c", "node_id")).where("c >= 1").select("table_id", "node_id", (c + big).alias("o")))
    places = seen.groupBy("table_id", "node_id").agg(F.min("o").alias("o"))
    nodes = places.select(*node(F.col("node_id"), F.col("o"), "Node", prop("name", F.col("node_id"))))
    cells = rows.select("table_id", "row_idx", label.alias("a"), F.posexplode("h0").alias("c", "b"), "cells").where((c >= 1) & (c < F.size("cells")) & (F.col("a") != F.col("b")))
    value = F.coalesce(F.get("cells", c)["v"], F.lit(""))
    valued = cells.select("table_id", "a", "b", (r * (1 << 20) + c).alias("seq"), strip(value).alias("value"), python_float(F.replace(value, F.lit(","), F.lit(""))).alias("weight")).where("weight is not null and weight <> 0")
    pairs = valued.groupBy("table_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min_by(F.struct("seq", "value", "weight"), "seq").alias("e"))
    # an undirected edge is listed at the end that was made first
    oa, ob = places.select("table_id", F.col("node_id").alias("a"), F.col("o").alias("oa")), places.select("table_id", F.col("node_id").alias("b"), F.col("o").alias("ob"))
    both = pairs.join(oa, ["table_id", "a"]).join(ob, ["table_id", "b"])
    forward = F.col("oa") < F.col("ob")
    edges = both.select(*edge(F.when(forward, F.col("a")).otherwise(F.col("b")), F.when(forward, F.col("b")).otherwise(F.col("a")), F.least("oa", "ob"), F.col("e.seq"), "CONNECTED", prop("weight", float_repr(F.col("e.weight")), "float"), prop("value", F.col("e.value"))))
    return nodes, edges


def relational(ts: TableSet) -> Built:
    """Rows are entities; a value in a key column refers to the last row that has it in column 0."""
    t, rows = _split(ts)
    first_width = rows.groupBy("table_id").agg(F.min_by(F.size("cells"), "row_idx").alias("w"))
    headless = F.when(F.size("headers") > 0, F.col("h0")).otherwise(F.transform(F.when(F.col("w") > 0, F.sequence(F.lit(0), F.col("w") - 1)).otherwise(F.array().cast("array<int>")), lambda i: numbered("col_", i)))
    rows = rows.join(first_width, "table_id").withColumn("h0", headless)
    r = F.col("row_idx")
    value = lambda i: F.coalesce(F.get("cells", i)["v"], F.lit(""))
    listed = F.transform("h0", lambda h, i: F.struct(h.alias("k"), value(i).alias("v"), F.lit("str").alias("t")))
    kind = F.when(F.size("h0") > 0, F.get("h0", F.lit(0))).otherwise("Entity")
    all_props = last_wins(F.concat(listed, props(prop("_entity_type", kind))))
    made = node(numbered("entity_", r), r, F.lit("Entity"))
    made[4] = all_props.cast(PROPS).alias("props")
    nodes = rows.select(*made)
    # a header named label replaces the node's label
    relabel = F.get(F.filter("props", lambda p: p["k"] == "label"), F.lit(0))["v"]
    nodes = nodes.withColumn("label", F.coalesce(relabel, F.col("label")))
    keys = rows.select("table_id", "row_idx", "cells", "h0", F.posexplode("h0").alias("c", "h")).where(is_key_name(F.col("h"))).select("table_id", "row_idx", "c", "h", value(F.col("c")).alias("key")).where("key <> ''")
    targets = rows.select("table_id", "row_idx", value(F.lit(0)).alias("key")).where("key <> ''").groupBy("table_id", "key").agg(F.max("row_idx").alias("target"))
    met = keys.join(targets, ["table_id", "key"]).where("target <> row_idx")
    once = met.groupBy("table_id", "row_idx", "target").agg(F.min("c").alias("seq"), F.max_by("h", "c").alias("via"))
    return nodes, once.select(*edge(numbered("entity_", r), numbered("entity_", F.col("target")), r, F.col("seq"), "REFERENCES", prop("via_column", F.col("via"))))


def row_dimensions(headers: Column) -> Column:
    """How many leading columns name rows: the first, and those after it, without a gap, whose deepest header is blank."""
    deepest = F.element_at(headers, -1)
    width = F.size(F.get(headers, F.lit(0)))
    blank = F.transform(F.sequence(F.lit(1), F.greatest(width - 1, F.lit(1))), lambda i: (i < width) & (strip(F.coalesce(F.get(deepest, i), F.lit(""))) == ""))
    stop = F.array_position(blank, F.lit(False))
    more = F.when(stop > 0, stop - 1).otherwise(F.size(blank))
    return F.when(F.size(headers) > 1, 1 + more).otherwise(1).cast("int")


def pivot(ts: TableSet) -> Built:
    """Header values are dimensions, chained from level to level; leading columns name rows; every other cell with a value is a measure
    of its row and of its column's dimensions at all levels."""
    t = ts.tables.withColumns({"nd": F.coalesce(row_dimensions(F.col("headers")), F.lit(1)), "width": F.when(F.size("headers") > 0, F.size(F.get("headers", F.lit(0)))).otherwise(0), "levels": F.size("headers")})
    flat = t.select("table_id", "nd", "width", "levels", F.posexplode("headers").alias("level", "h")).select("table_id", "nd", "width", "levels", "level", F.posexplode("h").alias("c", "name"))
    data = flat.where((F.col("c") >= F.col("nd")) & (F.col("c") < F.col("width")) & (strip(F.coalesce("name", F.lit(""))) != ""))
    place = F.col("c") * F.col("levels") + F.col("level")
    dims = data.groupBy("table_id", "level", "name").agg(F.min(place).alias("first"))
    dims = dims.withColumn("n", F.row_number().over(Window.partitionBy("table_id").orderBy("first")) - 1)
    n_dims = dims.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_dims"))
    dim_nodes = dims.select(*node(numbered("dim_", F.col("n")), F.col("n"), "Dimension", prop("name", F.col("name")), prop("level", F.col("level"), "int")))
    # a column's dimensions from the top down, and the links between neighbours
    by_column = data.join(dims, ["table_id", "level", "name"]).select("table_id", "c", "level", "levels", "width", "name", "n")
    down = Window.partitionBy("table_id", "c").orderBy("level")
    sub = by_column.withColumn("next", F.lead("n").over(down)).withColumn("next_level", F.lead("level").over(down)).where("next is not null and next <> n")
    sub = sub.groupBy("table_id", "n", "next").agg(F.min(F.col("c") * F.col("levels") + F.col("next_level")).alias("seq"))
    sub_edges = sub.select(*edge(numbered("dim_", F.col("n")), numbered("dim_", F.col("next")), F.col("n"), F.col("seq"), "HAS_SUBDIMENSION"))
    of_columns = by_column.groupBy("table_id", "c").agg(F.array_sort(F.collect_list(F.struct("level", "name", "n"))).alias("d")).groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "d"))).alias("col_dims"))
    rows = ts.rows.join(t.select("table_id", "headers", "nd", "width", "levels").join(n_dims, "table_id", "left").join(of_columns, "table_id", "left"), "table_id")
    rows = rows.fillna(0, ["n_dims"])
    r, nd = F.col("row_idx"), F.col("nd")
    rowdim = lambda k: F.concat(F.lit("rowdim_"), r.cast("string"), F.lit("_"), k.cast("string"))
    k = F.col("k")
    titles = lambda k: F.filter(F.transform("headers", lambda h: strip(F.coalesce(F.get(h, k), F.lit("")))), lambda x: x != "")
    category = lambda k: F.coalesce(F.try_element_at(titles(k), F.lit(-1)), F.lit(""))
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0), nd - 1)))
    named = F.when((k < F.size("cells")) & F.get("cells", k)["v"].isNotNull(), F.get("cells", k)["v"]).otherwise(F.concat(F.lit("row_"), r.cast("string"), F.lit("_"), k.cast("string")))
    row_ord = lambda k: F.col("n_dims") + r * nd + k
    row_nodes = each.select(*node(rowdim(k), row_ord(k), "Dimension", prop("name", named), prop("level", F.lit(-1), "int"), prop("axis", F.lit("row")), prop("category", category(k))))
    row_edges = each.where(k < nd - 1).select(*edge(rowdim(k), rowdim(k + 1), row_ord(k), F.lit(0), "HAS_SUBDIMENSION"))
    # measures are numbered by row and column: a running sum over the rows' counts, then the place in the row
    span = F.when(F.least(F.size("cells"), F.col("width")) > nd, F.sequence(nd, F.least(F.size("cells"), F.col("width")) - 1)).otherwise(F.array().cast("array<int>"))
    filled = F.filter(span, lambda i: strip(F.coalesce(F.get("cells", i)["v"], F.lit(""))) != "")
    counted = rows.withColumn("filled", filled)
    counts = counted.select("table_id", "row_idx", F.size("filled").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("table_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("table_id", "row_idx", "before")
    n_rows = counts.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n_rows"))
    m = counted.join(before, ["table_id", "row_idx"]).join(n_rows, "table_id").select("*", F.posexplode("filled").alias("at", "c")).withColumn("m", F.col("before") + F.col("at"))
    value = F.get("cells", F.col("c"))["v"]
    row_names = F.filter(F.transform(F.slice("cells", F.lit(1), nd), lambda x: x["v"]), lambda x: x.isNotNull())
    m = m.withColumns({"value": value, "row_names": row_names, "d": F.coalesce(F.try_element_at("col_dims", F.col("c")), F.array().cast("array<struct<level:int,name:string,n:int>>"))})
    optional = lambda name, i: F.when(F.size("row_names") > i, F.array(prop(name, F.get("row_names", F.lit(i))))).otherwise(F.array()).cast(PROPS)
    base = props(prop("value", F.col("value")), prop("row_context", F.array_join("row_names", " | ")), prop("col_context", F.array_join(F.transform("d", lambda x: x["name"]), " | ")))
    dim_props = F.transform("d", lambda x, i: F.struct(numbered("col_dim_", i).alias("k"), x["name"].alias("v"), F.lit("str").alias("t"))).cast(PROPS)
    mid = numbered("measure_", F.col("m"))
    measure = node(mid, F.col("n_dims") + F.col("n_rows") * nd + F.col("m"), "Measure")
    measure[4] = F.concat(base, optional("row_from", 0), optional("row_to", 1), dim_props).alias("props")
    from_row = m.select(*edge(rowdim(nd - 1), mid, row_ord(nd - 1), 1 + F.col("m"), "AGGREGATED_BY", prop("value", F.col("value"))))
    from_col = m.select("table_id", "m", "value", "width", "levels", F.explode("d").alias("x")).select(*edge(numbered("dim_", F.col("x.n")), mid, F.col("x.n"), F.col("width") * F.col("levels") + F.col("m"), "AGGREGATED_BY", prop("value", F.col("value"))))
    nodes = dim_nodes.unionByName(row_nodes).unionByName(m.select(*measure))
    return nodes, sub_edges.unionByName(row_edges).unionByName(from_row).unionByName(from_col)


BUILDERS: dict[str, Callable[[TableSet], Built]] = {"key_value": key_value, "comparison": comparison, "time_series": time_series, "hierarchical": hierarchical, "matrix": matrix, "relational": relational, "pivot": pivot}

#: Node labels of each archetype, in order (a description, not enforced).
NODE_TYPES = {"key_value": ("Entity", "Property"), "comparison": ("Entity", "Attribute"), "time_series": ("Metric", "TimePoint"), "hierarchical": ("Category",), "matrix": ("Node",), "relational": ("Entity",), "pivot": ("Dimension", "Measure")}
EDGE_TYPES = {"key_value": ("HAS_PROPERTY",), "comparison": ("HAS_ATTRIBUTE",), "time_series": ("AT_TIME", "NEXT"), "hierarchical": ("PARENT_OF",), "matrix": ("CONNECTED",), "relational": ("REFERENCES",), "pivot": ("AGGREGATED_BY", "HAS_SUBDIMENSION")}


def build(ts: TableSet, types: DataFrame, only: list[str] | None = None, builders: dict[str, Callable[[TableSet], Built]] | None = None) -> GraphSet:
    """Graphs of all tables whose type has a builder. ``types``: table_id, table_type, confidence (as from classify). Tables of other
    types, such as unknown, make no graph. ``only`` names the types to plan for, which keeps the plan small if they are known."""
    known = builders or BUILDERS
    typed = ts.tables.join(types.select("table_id", "table_type", "confidence"), "table_id").where(F.col("table_type").isin(*known))
    graphs = typed.select(F.col("table_id").alias("graph_id"), F.coalesce("source_file", F.lit("unknown")).alias("source_file"), "page_number", "table_index", F.coalesce("context", F.lit("")).alias("context"), "table_type", "confidence", (F.col("table_type") != "matrix").alias("directed"))
    nodes = edges = None
    for name in only or list(known):
        of = typed.where(F.col("table_type") == name).drop("table_type", "confidence")
        n, e = known[name](TableSet(of, ts.rows.join(of.select("table_id"), "table_id", "left_semi")))
        n, e = n.select(*NODE_COLUMNS), e.select(*EDGE_COLUMNS)
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return GraphSet(graphs, nodes, edges)
