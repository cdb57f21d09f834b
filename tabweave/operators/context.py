"""Text of retrieved subgraphs, by seeds (node-centric), by edges or by paths; one text per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.props import display, in_brackets
from tabweave.functions.text import two_places
from tabweave.operators.retrieve import Retrieved, pair_paths
from tabweave.plans.shared import hold

STRATEGIES = ("node-centric", "edge-centric", "path-centric")
#: Edges shown with a node that no seed is connected to.
SHOWN_EDGES = 5


def _key(r: Retrieved, node: Column, graph: Column) -> Column:
    """A node's name in the composed graph: with its graph's id in front if there are several graphs."""
    return F.concat(F.lit("g"), graph.cast("string"), F.lit("_"), node) if r.multi_graph else node


def _composed(r: Retrieved) -> tuple[DataFrame, DataFrame]:
    """Nodes (query_id, id, label, show) and edges (query_id, u, v, label, brackets, place) under their composed names."""
    node_id = _key(r, F.col("node_id"), F.col("graph_id"))
    nodes = r.nodes.select("query_id", node_id.alias("id"), "label", display(node_id, F.col("label"), F.col("props")).alias("show"))
    edges = r.edges.select("query_id", _key(r, F.col("src"), F.col("graph_id")).alias("u"), _key(r, F.col("dst"), F.col("graph_id")).alias("v"), "label", in_brackets(F.col("props")).alias("brackets"), F.struct("graph_id", "src_ord", "seq").alias("place"))
    return nodes, edges


def _head(r: Retrieved, nodes: DataFrame, edges: DataFrame, strategy: str) -> DataFrame:
    n = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("e"))
    both = r.queries.join(n, "query_id").join(e, "query_id", "left")
    text = F.concat(F.lit('## Graph Context (query: "'), F.col("query"), F.lit(f'")\nStrategy: {strategy} | Nodes: '), F.col("n").cast("string"), F.lit(" | Edges: "), F.coalesce("e", F.lit(0)).cast("string"), F.lit("\n"))
    return both.select("query_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), text.alias("text"))


def _joined(parts: DataFrame) -> DataFrame:
    """query_id, context from parts (query_id, part, at, text) in order, one per line."""
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "text"))), lambda p: p["text"]), "\n").alias("context"))


def _lines(c: str, order: list[Column | str]) -> Column:
    """The texts of a column in order, one per line."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(c).alias("_x")))), lambda p: p["_x"]), "\n")


def _connections(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, rank, nbr, line of every neighbour of a seed; of two opposite edges the outgoing one is shown."""
    out = edges.select("query_id", F.col("u").alias("id"), F.col("v").alias("nbr"), F.lit(0).alias("way"), "label", "brackets")
    back = edges.select("query_id", F.col("v").alias("id"), F.col("u").alias("nbr"), F.lit(1).alias("way"), "label", "brackets")
    near = seeds.join(out.unionByName(back), ["query_id", "id"]).groupBy("query_id", "rank", "nbr").agg(F.min(F.struct("way", "label", "brackets")).alias("e"))
    shown = near.join(nodes.select("query_id", F.col("id").alias("nbr"), F.col("label").alias("kind"), "show"), ["query_id", "nbr"])
    way = F.when(F.col("e.way") == 1, " (inbound)").otherwise("")
    return shown.select("query_id", "rank", "nbr", F.concat(F.lit("    - "), "kind", F.lit(": "), "show", F.lit(" via ["), "e.label", "e.brackets", F.lit("]"), way).alias("line"))


def _named_seeds(r: Retrieved) -> DataFrame:
    return r.seeds.select("query_id", "rank", "score", _key(r, F.col("node_id"), F.col("graph_id")).alias("id"))


def node_centric(r: Retrieved) -> DataFrame:
    nodes, edges = _composed(r)
    seeds = _named_seeds(r)
    near = _connections(nodes, edges, seeds)
    blocks = near.groupBy("query_id", "rank").agg(F.concat(F.lit("\n  Connected to:\n"), _lines("line", ["nbr"])).alias("connected"))
    shown = seeds.join(nodes, ["query_id", "id"]).join(blocks, ["query_id", "rank"], "left")
    title = F.concat(F.lit("### "), "label", F.lit(": "), "show", F.lit(" (relevance: "), two_places(F.col("score")), F.lit(")"), F.coalesce("connected", F.lit("")), F.lit("\n"))
    seed_parts = shown.select("query_id", F.lit(1).alias("part"), F.col("rank").cast("long").alias("at"), title.alias("text"))
    covered = near.select("query_id", F.col("nbr").alias("id")).unionByName(seeds.select("query_id", "id")).distinct()
    rest = nodes.join(covered, ["query_id", "id"], "left_anti")
    ends = edges.select("query_id", F.col("u").alias("id"), F.col("v").alias("other"), "label", "brackets", "place").unionByName(edges.where("u <> v").select("query_id", F.col("v").alias("id"), F.col("u").alias("other"), "label", "brackets", "place"))
    of_rest = rest.select("query_id", "id").join(ends, ["query_id", "id"]).join(nodes.select("query_id", F.col("id").alias("other"), F.col("show").alias("other_show")), ["query_id", "other"])
    nth = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("place"))
    few = of_rest.withColumn("nth", nth).where(F.col("nth") <= SHOWN_EDGES).withColumn("said", F.concat(F.lit("["), "label", "brackets", F.lit("] → "), "other_show"))
    said = few.groupBy("query_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "said"))), lambda x: x["said"]), "; ").alias("said"))
    line = F.concat(F.lit("  - "), "show", F.coalesce(F.concat(F.lit("  edges: "), "said"), F.lit("")))
    more = rest.join(said, ["query_id", "id"], "left").withColumn("line", line).groupBy("query_id").agg(_lines("line", ["id"]).alias("text"))
    rest_parts = more.select("query_id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("### Additional Context\n"), "text", F.lit("\n")).alias("text"))
    return _joined(_head(r, nodes, edges, "node-centric").unionByName(seed_parts).unionByName(rest_parts))


def edge_lines(r: Retrieved) -> DataFrame:
    """query_id, place, line of every edge."""
    nodes, edges = _composed(r)
    named = edges.join(nodes.select("query_id", F.col("id").alias("u"), F.col("show").alias("su")), ["query_id", "u"]).join(nodes.select("query_id", F.col("id").alias("v"), F.col("show").alias("sv")), ["query_id", "v"])
    return named.select("query_id", "place", F.concat(F.lit("- "), "su", F.lit(" —["), "label", "brackets", F.lit("]→ "), "sv").alias("line"))


def edge_centric(r: Retrieved) -> DataFrame:
    nodes, edges = _composed(r)
    lines = edge_lines(r).groupBy("query_id").agg(F.concat(_lines("line", ["place"]), F.lit("\n")).alias("text"))
    body = nodes.select("query_id").distinct().join(lines, "query_id", "left").select("query_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    return _joined(_head(r, nodes, edges, "edge-centric").unionByName(body))


def path_centric(r: Retrieved) -> DataFrame:
    nodes, edges = _composed(r)
    seeds = _named_seeds(r).join(nodes.select("query_id", "id"), ["query_id", "id"], "left_semi")
    both = edges.select("query_id", "u", "v").unionByName(edges.select("query_id", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    first, second = seeds.select("query_id", F.col("id").alias("a"), F.col("rank").alias("i")), seeds.select("query_id", F.col("id").alias("b"), F.col("rank").alias("j"))
    asked = hold(first.join(second, "query_id").where("i < j"))
    pairs = pair_paths(both, asked, ["query_id"]).join(asked, ["query_id", "a", "b"])
    # a path found twice is shown at its first pair
    once = pairs.groupBy("query_id", "path").agg(F.min(F.struct("i", "j")).alias("o"))
    steps = once.select("query_id", "path", "o", F.posexplode("path").alias("at", "id")).withColumn("next", F.get("path", F.col("at") + 1))
    named = steps.join(nodes.select("query_id", "id", "show"), ["query_id", "id"])
    out = edges.select("query_id", F.col("u").alias("id"), F.col("v").alias("next"), F.concat("label", "brackets").alias("rel"), F.lit(0).alias("way"))
    back = edges.select("query_id", F.col("v").alias("id"), F.col("u").alias("next"), F.concat("label", "brackets").alias("rel"), F.lit(1).alias("way"))
    links = out.unionByName(back).groupBy("query_id", "id", "next").agg(F.min_by("rel", "way").alias("rel"))
    chained = named.join(links, ["query_id", "id", "next"], "left").withColumn("x", F.concat("show", F.when(F.col("next").isNotNull(), F.concat(F.lit(" —["), F.coalesce("rel", F.lit("RELATED")), F.lit("]→ "))).otherwise("")))
    lines = chained.groupBy("query_id", "path", "o").agg(F.concat(F.lit("Path: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]), "")).alias("line"))
    found = lines.groupBy("query_id").agg(F.concat(_lines("line", ["o"]), F.lit("\n")).alias("text"))
    alone = seeds.join(nodes, ["query_id", "id"]).withColumn("line", F.concat(F.lit("  - "), "show")).groupBy("query_id").agg(F.concat(F.lit("No connecting paths found between seed nodes.\nSeed nodes:\n"), _lines("line", ["rank"]), F.lit("\n")).alias("other"))
    body = alone.join(found, "query_id", "left").select("query_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("at"), F.coalesce("text", "other").alias("text"))
    return _joined(_head(r, nodes, edges, "path-centric").unionByName(body))


def truncate(text: Column, max_tokens: int | None) -> Column:
    """At most four characters per token, then back to the last whole line, with a note."""
    if max_tokens is None:
        return text
    cut = F.substring(text, 1, max_tokens * 4)
    kept = F.regexp_replace(cut, r"\n[^\n]*\z", "")
    return F.when(F.length(text) > max_tokens * 4, F.concat(kept, F.lit("\n... (truncated)"))).otherwise(text)


def render(r: Retrieved, strategy: str = "node-centric", max_tokens: int | None = None) -> DataFrame:
    """query_id, context of every query; queries that found nothing say so."""
    made = {"node-centric": node_centric, "edge-centric": edge_centric, "path-centric": path_centric}
    if strategy not in made:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(sorted(made))}")
    nothing = F.concat(F.lit('No relevant graph context found for query: "'), "query", F.lit('"'))
    joined = r.queries.join(made[strategy](r), "query_id", "left")
    return joined.select("query_id", F.when(F.col("context").isNull(), nothing).otherwise(truncate(F.col("context"), max_tokens)).alias("context"))


def hit(context: Column, targets: Column) -> Column:
    """Whether a context holds all target texts, in any case."""
    return F.forall(targets, lambda t: F.contains(F.lower(context), F.lower(t)))
