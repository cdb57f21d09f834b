"""The token index of a GraphSet, and keyword search over it for many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.text import tokens
from tabweave.plans.shared import hold
from tabweave.schema import GraphSet

#: A token of at most so many nodes is rare: all its nodes are scored for every query that has it.
RARE_NODES = 64


def _texts(extra):
    """Names and values of public properties."""
    shown = F.filter("props", lambda p: ~F.startswith(p["k"], F.lit("_")) & (p["k"] != "label"))
    return F.concat(F.array(*extra), F.flatten(F.transform(shown, lambda p: F.array(p["k"], p["v"]))))


def _token_set(texts):
    return F.array_distinct(F.flatten(F.transform(texts, tokens)))


def postings(gs: GraphSet, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """token, graph_id, node_id, weight, place (and bucket, if a token's bucket is given): one row per token and node.

    A node has the tokens of its id, label, property names and values, and those of its edges' labels, names and values, with weight
    1; tokens of its graph's context have weight 0.5. ``place`` is where the node first occurs in the token's list (nodes in
    order, then edges with source before target); it settles ties. Repeats are folded here, map-side first, so a hub's list
    entry is one row however many edges it has. With ``bucket``, rows are dealt by it: those of edges after they were folded, those
    of nodes, which have no repeats, once."""
    said = gs.graphs.select("graph_id", _token_set(F.array("context")).alias("said"))
    n = gs.nodes.join(said, "graph_id", "left").select(
        "graph_id",
        "node_id",
        _token_set(_texts([F.col("node_id"), F.lit("label"), F.col("label")])).alias("own"),
        "said",
        F.struct(F.lit(0).alias("kind"), F.col("node_ord").alias("ord"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("end")).alias("place"),
    )
    e = gs.edges.join(said, "graph_id", "left").select("graph_id", "src", "dst", _token_set(_texts([F.col("label")])).alias("own"), "said", "src_ord", "seq")
    place = lambda end: F.struct(F.lit(1).alias("kind"), F.col("src_ord").alias("ord"), F.col("seq"), F.lit(end).alias("end"))
    ends = e.select("graph_id", "own", "said", F.explode(F.array(F.struct(F.col("src").alias("node_id"), place(0).alias("place")), F.struct(F.col("dst").alias("node_id"), place(1).alias("place")))).alias("x"))
    weighed = F.concat(F.transform("own", lambda t: F.struct(t.alias("token"), F.lit(1.0).alias("w"))), F.transform(F.array_except(F.coalesce("said", F.array().cast("array<string>")), "own"), lambda t: F.struct(t.alias("token"), F.lit(0.5).alias("w"))))
    flat = lambda df: df.select("graph_id", "node_id", "place", F.explode(weighed).alias("x")).select(F.col("x.token").alias("token"), "graph_id", "node_id", F.col("x.w").alias("weight"), "place")
    folded = lambda df, *more: df.groupBy(*more, "token", "graph_id", "node_id").agg(F.max("weight").alias("weight"), F.min("place").alias("place"))
    ends = ends.select("graph_id", F.col("x.node_id").alias("node_id"), "own", "said", F.col("x.place").alias("place"))
    if bucket is None:
        return folded(flat(n.unionByName(ends)))
    return folded(flat(n).unionByName(folded(flat(ends))).withColumn("bucket", bucket(F.col("token"))).repartition("bucket"), "bucket")


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, token, pos (its first place in the query), n (tokens of the query, repeats counted)."""
    split = queries.select("query_id", tokens(F.col("query")).alias("t"))
    return split.select("query_id", F.size("t").alias("n"), F.posexplode("t").alias("pos", "token")).groupBy("query_id", "token").agg(F.min("pos").alias("pos"), F.first("n").alias("n"))


class Lists(Protocol):
    """An index that finds the postings of tokens itself, and knows how many nodes a token has (see ``store``)."""

    def find(self, tokens: DataFrame) -> tuple[DataFrame, DataFrame]: ...


def search(index: DataFrame | Lists, queries: DataFrame, max_results: int = 50) -> DataFrame:
    """query_id, rank (from 1), graph_id, node_id, score: the best nodes of each query. ``index``: postings, or what finds them.

    A score is the sum of the weights of the query's distinct tokens, over the number of its tokens. Equal scores keep the order in
    which the nodes are met: by the query's tokens, then by place. queries: query_id, query."""
    tokens_of = query_tokens(queries)
    ranked = best_nodes(index, tokens_of, max_results)
    return ranked.join(tokens_of.groupBy("query_id").agg(F.first("n").alias("n")), "query_id").select("query_id", "rank", "graph_id", "node_id", (F.col("sum") / F.col("n")).alias("score"))


def best_nodes(index: DataFrame | Lists, tokens_of: DataFrame, max_results: int) -> DataFrame:
    """query_id, rank, graph_id, node_id, sum: for each query the nodes with the largest sums of the weights of its tokens, ties by the least
    (pos, graph_id, place). tokens_of: query_id, token, pos, one row a token.

    Not every pair of a query and a node that share a token is scored:

    1. The nodes of a query's rare tokens are scored in full. Their ``max_results``-th sum is a bound for the query.
    2. Of its other tokens, the most frequent ones whose weights together stay below the bound cannot bring a node in on their own;
       the rest must be looked up. Without a rest the query is done.
    3. Nodes with none of the rare tokens are ranked by the other tokens alone, whatever the rare ones are. So this is done once for
       all queries that have the same other tokens at the same places, and only the ``max_results`` best are handed to them. A node
       beyond these has as many others before it in every such query, as rare tokens can only add to a sum or bring a node forward.
    """
    # the lists of the tokens that are asked for, read several times
    if isinstance(index, DataFrame):
        lists = hold(index.join(tokens_of.select("token").distinct(), "token", "left_semi"))
        sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("nodes"), F.max("weight").alias("most"))
    else:
        tokens_of = hold(tokens_of)
        lists, sizes = index.find(tokens_of)
        lists = hold(lists)
    asked = hold(tokens_of.join(sizes, "token"))
    rare = asked.where(F.col("nodes") <= RARE_NODES)
    node = ["graph_id", "node_id"]
    summed = lambda df, key: df.groupBy(key, *node).agg(F.sum("weight").alias("sum"), F.min(F.struct("pos", "graph_id", "place")).alias("first"))

    def in_full(found: DataFrame, said: DataFrame, key: str) -> DataFrame:
        """The sums of the found nodes (key and node) over the tokens said (key, token, pos)."""
        return summed(found.join(said.select(key, "token", "pos"), key).join(lists, ["token", *node]), key)

    best = lambda key: Window.partitionBy(key).orderBy(F.desc("sum"), "first")
    near = hold(in_full(lists.join(rare.select("query_id", "token"), "token").select("query_id", *node).distinct(), asked, "query_id"))
    bounds = near.withColumn("nth", F.row_number().over(best("query_id"))).where(F.col("nth") == max_results).select("query_id", F.col("sum").alias("bound"))
    others = asked.where(F.col("nodes") > RARE_NODES).join(bounds, "query_id", "left")
    upto = F.sum("most").over(Window.partitionBy("query_id").orderBy(F.desc("nodes"), "token").rowsBetween(Window.unboundedPreceding, 0))
    others = others.withColumn("needed", F.coalesce(upto >= F.col("bound") - 1e-9, F.lit(True)))
    # queries with the same other tokens, of which some are needed, share one lookup
    alike = others.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", "pos", "needed"))).alias("said")).where(F.exists("said", lambda x: x["needed"]))
    alike = hold(alike.withColumn("like", F.md5(F.to_json("said").cast("binary"))))
    said = alike.groupBy("like").agg(F.first("said").alias("said")).select("like", F.explode("said").alias("x")).select("like", "x.*")
    looked_up = summed(lists.join(said.where("needed"), "token"), "like")
    more = in_full(looked_up.select("like", *node), said.where("not needed"), "like")
    far = looked_up.unionByName(more).groupBy("like", *node).agg(F.sum("sum").alias("sum"), F.min("first").alias("first"))
    far = far.withColumn("nth", F.row_number().over(best("like"))).where(F.col("nth") <= max_results).drop("nth")
    both = near.unionByName(alike.select("query_id", "like").join(far, "like").drop("like")).groupBy("query_id", *node).agg(F.max("sum").alias("sum"), F.min("first").alias("first"))
    ranked = both.withColumn("rank", F.row_number().over(best("query_id"))).where(F.col("rank") <= max_results)
    return ranked.select("query_id", "rank", *node, "sum")


def flat_chunks(gs_tables: DataFrame, rows: DataFrame) -> DataFrame:
    """chunk_id, chunk: each table row as one line of text, '[name Row i] headers => cells' (a baseline for retrieval)."""
    joined = rows.join(gs_tables.select("table_id", "source_file", "headers"), "table_id")
    heads = F.array_join(F.get("headers", F.lit(0)), " | ")
    cells = F.array_join(F.transform("cells", lambda c: F.coalesce(c["v"], F.lit("None"))), " | ")
    name = F.concat(F.lit("["), F.col("source_file"), F.lit(" Row "), F.col("row_idx").cast("string"), F.lit("] "))
    return joined.select(F.struct("table_id", "row_idx").alias("chunk_id"), F.concat(name, heads, F.lit(" => "), cells).alias("chunk"))


#: Characters of a gram by which words meet the words that contain them.
GRAM = 3


def best_chunk(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, chunk, score: for each query the first chunk that contains most of its distinct words as substrings. Question
    marks, apostrophes and commas of a query are left out.

    Words meet chunks through the chunks' own words: a chunk contains a query word iff one of its blank-separated words does, and then
    that word has the query word's first GRAM characters in it. So distinct words are joined by equal grams and tested after that."""
    plain = F.translate(F.lower("query"), "?',", "")
    words = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))).alias("word"))
    parts = chunks.select("chunk_id", F.explode(F.array_distinct(F.split(F.lower("chunk"), r"\s+"))).alias("part"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("part") - (n - 1), F.lit(1))), lambda i: F.substring("part", i, F.lit(n)))
    gram = F.substring("word", 1, GRAM)
    by_gram = parts.select("part").distinct().select("part", F.explode(F.array_distinct(F.concat(*[grams(n) for n in range(1, GRAM + 1)]))).alias("gram"))
    has = words.select("word", gram.alias("gram")).distinct().join(by_gram, "gram").where(F.expr("contains(part, word)")).select("part", "word")
    zero = F.lit(0).cast("long")
    met = parts.join(has, "part").select(F.col("word").alias("token"), zero.alias("graph_id"), F.col("chunk_id").alias("node_id")).distinct()
    lists = met.select("*", F.lit(1.0).alias("weight"), F.col("node_id").alias("place"))
    best = best_nodes(lists, words.select("query_id", F.col("word").alias("token"), F.lit(0).alias("pos")), 1)
    return best.select("query_id", F.col("node_id").alias("chunk_id"), F.col("sum").cast("long").alias("score")).join(chunks, "chunk_id")
