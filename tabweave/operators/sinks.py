"""Exports of a GraphSet. Each format is first a DataFrame of lines (graph_id, section, ord, line) that can be written in parallel; a graph's text is
its lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.props import listed, public
from tabweave.functions.text import two_places
from tabweave.operators.build import EDGE_TYPES, NODE_TYPES
from tabweave.schema import GraphSet

SEPARATOR = "\n---\n\n"


def _ranked(gs: GraphSet, depth: int | None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; with a depth, numbered from 0 (nth) and only so many."""
    if depth is None:
        return gs.nodes, gs.edges
    n = gs.nodes.withColumn("nth", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_ord")) - 1).where(F.col("nth") < depth)
    e = gs.edges.withColumn("nth", F.row_number().over(Window.partitionBy("graph_id").orderBy("src_ord", "seq")) - 1).where(F.col("nth") < depth)
    return n.drop("nth"), e.drop("nth")


def _line(section: int, order: Column, line: Column) -> list[Column]:
    return [F.col("graph_id"), F.lit(section).alias("section"), order.alias("ord"), line.alias("line")]


def _order(*c: str) -> Column:
    cols = [F.col(x).cast("long") for x in c] + [F.lit(0).cast("long")] * (2 - len(c))
    return F.struct(cols[0].alias("a"), cols[1].alias("b"))


def _fixed(section: int, rows: DataFrame, line: Column | str) -> DataFrame:
    return rows.select(*_line(section, F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), F.lit(line) if isinstance(line, str) else line))


def markdown_node(node_id: Column) -> Column:
    shown = public(F.col("props"))
    return F.concat(F.lit("  - **"), "label", F.lit("** `"), node_id, F.lit("`"), F.when(F.size(shown) > 0, F.concat(F.lit(": "), listed(shown, ": "))).otherwise(""))


def markdown_edge() -> Column:
    shown = public(F.col("props"))
    return F.concat(F.lit("  - `"), "src", F.lit("` —["), "label", F.lit("]→ `"), "dst", F.lit("`"), F.when(F.size(shown) > 0, F.concat(F.lit(": "), listed(shown, ": "))).otherwise(""))


def markdown_lines(gs: GraphSet, depth: int | None = None) -> DataFrame:
    nodes, edges = _ranked(gs, depth)
    said = F.when(F.col("context") != "", F.concat(F.lit("\n**Context:** "), "context")).otherwise("")
    head = _fixed(0, gs.graphs, F.concat(F.lit("## Table Graph (from "), "source_file", F.lit(")"), said, F.lit("\n")))
    kind = _fixed(1, gs.graphs, F.concat(F.lit("**Type:** "), "table_type", F.lit(" (confidence: "), two_places(F.col("confidence")), F.lit(")\n")))
    parts = [head, kind, _fixed(2, gs.graphs, "### Nodes\n"), nodes.select(*_line(3, _order("node_ord"), markdown_node(F.col("node_id")))), _fixed(5, gs.graphs, "\n### Relationships\n"), edges.select(*_line(6, _order("src_ord", "seq"), markdown_edge())), _fixed(8, gs.graphs, "")]
    if depth is not None:
        counts = gs.counts()
        parts.append(_fixed(4, counts.where(F.col("node_count") > depth), F.concat(F.lit("  - ... ("), (F.col("node_count") - depth).cast("string"), F.lit(" more nodes)"))))
        parts.append(_fixed(7, counts.where(F.col("edge_count") > depth), F.concat(F.lit("  - ... ("), (F.col("edge_count") - depth).cast("string"), F.lit(" more relationships)"))))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cypher_text(c: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("'", "\\'"), ('"', '\\"')):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.concat(F.lit("'"), c, F.lit("'"))


def cypher_name(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))


def cypher_props(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda p: F.concat(p["k"], F.lit(": "), F.when(p["t"] == "str", cypher_text(p["v"])).otherwise(p["v"]))), ", ")


def cypher_node(verb: str = "MERGE") -> Column:
    shown = cypher_props(public(F.col("props")))
    own = F.concat(F.lit("_id: "), cypher_text(F.col("node_id")))
    return F.concat(F.lit(f"{verb} ("), cypher_name(F.col("node_id")), F.lit(":"), "label", F.lit(" {"), F.concat_ws(", ", F.when(shown != "", shown), own), F.lit("})"))


def cypher_edge(verb: str = "MERGE") -> Column:
    shown = cypher_props(public(F.col("props")))
    return F.concat(F.lit(f"{verb} ("), cypher_name(F.col("src")), F.lit(")-[:"), "label", F.when(shown != "", F.concat(F.lit(" {"), shown, F.lit("}"))).otherwise(""), F.lit("]->("), cypher_name(F.col("dst")), F.lit(")"))


def cypher_lines(gs: GraphSet, depth: int | None = None, merge: bool = True) -> DataFrame:
    nodes, edges = _ranked(gs, depth)
    verb = "MERGE" if merge else "CREATE"
    return _union([_fixed(0, gs.graphs, "// Cypher generated from tables\n"), nodes.select(*_line(1, _order("node_ord"), cypher_node(verb))), _fixed(2, gs.graphs, ""), edges.select(*_line(3, _order("src_ord", "seq"), cypher_edge(verb))), _fixed(4, gs.graphs, "")])


def xml_text(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def graphml_lines(gs: GraphSet, depth: int | None = None) -> DataFrame:
    """GraphML with every attribute a string. With a depth, the subgraph of the first nodes."""
    nodes, edges = gs.nodes, gs.edges
    if depth is not None:
        nodes, _ = _ranked(gs, depth)
        kept = nodes.select("graph_id", F.col("node_id"))
        edges = edges.join(kept.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(kept.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")
    own = gs.graphs.select("graph_id", "source_file", "page_number", "table_index")
    one = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    plain = lambda a: F.transform(F.filter(a, lambda p: p["k"] != "label"), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    n = nodes.join(own, "graph_id").withColumn("a", F.filter(F.concat(F.array(one("label", F.col("label"))), plain("props"), F.array(one("_source_file", F.col("source_file")), one("_page_number", F.col("page_number")), one("_table_index", F.col("table_index")))), lambda p: p["v"].isNotNull()))
    e = edges.withColumn("a", F.concat(F.array(one("label", F.col("label"))), plain("props")))
    keys = n.select("graph_id", F.lit("node").alias("for"), F.explode("a.k").alias("k")).unionByName(e.select("graph_id", F.lit("edge").alias("for"), F.explode("a.k").alias("k"))).distinct()
    named = lambda kind: F.transform("a", lambda p: F.concat(F.lit(f'      <data key="{kind}_'), xml_text(p["k"]), F.lit('">'), xml_text(p["v"]), F.lit("</data>")))
    key_line = F.concat(F.lit('  <key id="'), "for", F.lit("_"), xml_text(F.col("k")), F.lit('" for="'), "for", F.lit('" attr.name="'), xml_text(F.col("k")), F.lit('" attr.type="string"/>'))
    key_rows = keys.withColumn("nth", F.row_number().over(Window.partitionBy("graph_id").orderBy("for", "k")))
    node_line = F.concat(F.lit('    <node id="'), xml_text(F.col("node_id")), F.lit('">\n'), F.array_join(named("node"), "\n"), F.lit("\n    </node>"))
    edge_line = F.concat(F.lit('    <edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('">\n'), F.array_join(named("edge"), "\n"), F.lit("\n    </edge>"))
    return _union(
        [
            _fixed(0, gs.graphs, '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'),
            key_rows.select(*_line(1, _order("nth"), key_line)),
            _fixed(2, gs.graphs, F.concat(F.lit('  <graph edgedefault="'), F.when(F.col("directed"), "directed").otherwise("undirected"), F.lit('">'))),
            n.select(*_line(3, _order("node_ord"), node_line)),
            e.select(*_line(4, _order("src_ord", "seq"), edge_line)),
            _fixed(5, gs.graphs, "  </graph>\n</graphml>"),
        ]
    )


def json_graphs(gs: GraphSet) -> DataFrame:
    """graph_id, text: each graph as a JSON object of metadata, nodes and edges."""
    as_map = lambda *extra: F.map_from_entries(F.concat(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in extra]), F.transform(F.filter("props", lambda p: ~p["k"].isin(*[k for k, _ in extra])), lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))))
    n = gs.nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_ord", F.to_json(as_map(("id", "node_id"), ("label", "label"))).alias("x")))).alias("n"))
    e = gs.edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src_ord", "seq", F.to_json(as_map(("source", "src"), ("target", "dst"), ("label", "label"))).alias("x")))).alias("e"))
    joined = gs.graphs.join(n, "graph_id", "left").join(e, "graph_id", "left")
    listing = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x["x"]), ","), F.lit("]"))
    meta = F.to_json(F.struct("source_file", "page_number", "table_index", "table_type", "confidence", F.coalesce(F.size("n"), F.lit(0)).alias("node_count"), F.coalesce(F.size("e"), F.lit(0)).alias("edge_count"), F.when(F.col("directed"), "digraph").otherwise("graph").alias("graph_type")))
    return joined.select("graph_id", F.concat(F.lit('{"metadata":'), meta, F.lit(',"nodes":'), F.when(F.col("n").isNull(), "[]").otherwise(listing("n")), F.lit(',"edges":'), F.when(F.col("e").isNull(), "[]").otherwise(listing("e")), F.lit("}")).alias("text"))


def summaries(gs: GraphSet) -> DataFrame:
    """graph_id, text: a few lines about each graph."""
    types = F.create_map(*[x for k, v in NODE_TYPES.items() for x in (F.lit(k), F.lit(", ".join(v)))])
    rels = F.create_map(*[x for k, v in EDGE_TYPES.items() for x in (F.lit(k), F.lit(", ".join(v)))])
    page = F.coalesce(F.col("page_number").cast("string"), F.lit("None"))
    text = F.concat(
        F.lit("TableGraph: "), F.col("node_count").cast("string"), F.lit(" nodes, "), F.col("edge_count").cast("string"), F.lit(" edges\n  Type: "), F.when(F.col("directed"), "digraph").otherwise("graph"),
        F.lit("\n  Classification: "), "table_type", F.lit(" (confidence="), two_places(F.col("confidence")), F.lit(")\n  Source: "), "source_file", F.lit(" p"), page,
        F.lit("\n  Node types: "), types[F.col("table_type")], F.lit("\n  Edge types: "), rels[F.col("table_type")],
    )
    return gs.graphs.join(gs.counts(), "graph_id").select("graph_id", text.alias("text"))


def texts(lines: DataFrame) -> DataFrame:
    """graph_id, text: the lines of each graph together."""
    return lines.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))), lambda x: x["line"]), "\n").alias("text"))


def export(gs: GraphSet, fmt: str = "markdown", depth: int | None = None) -> DataFrame:
    """graph_id, text of every graph in a format: markdown, cypher, graphml, json or summary."""
    made = {"markdown": lambda: texts(markdown_lines(gs, depth)), "cypher": lambda: texts(cypher_lines(gs, depth)), "graphml": lambda: texts(graphml_lines(gs, depth)), "json": lambda: json_graphs(gs), "summary": lambda: summaries(gs)}
    if fmt not in made:
        raise KeyError(f"unknown format {fmt!r}; there are {', '.join(sorted(made))}")
    return made[fmt]()
