"""Retrieval: seeds of each query, what is reached from them in k hops, and the induced subgraphs, for all queries in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.operators.index import Lists, search
from tabweave.plans.shared import hold
from tabweave.schema import GraphSet

#: Parts into which those that share what they reach are dealt out.
SPREAD = 16


@dataclass(frozen=True)
class Retrieved:
    """queries: query_id, query. seeds: query_id, rank, graph_id, node_id, score. nodes and edges: those of a GraphSet with query_id."""

    queries: DataFrame
    seeds: DataFrame
    nodes: DataFrame
    edges: DataFrame
    multi_graph: bool

    def source_graphs(self) -> DataFrame:
        return self.seeds.groupBy("query_id").agg(F.sort_array(F.collect_set("graph_id")).alias("source_graphs"))


def neighbours(edges: DataFrame) -> DataFrame:
    """graph_id, u, v of both directions of every edge."""
    return edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select("graph_id", F.col("dst").alias("u"), F.col("src").alias("v")))


def _alike(starts: DataFrame, edges: DataFrame, k_hops: int) -> tuple[DataFrame, DataFrame]:
    """graph_id, node_id, like of the start nodes that have edges; and like, graph_id, v, depth (from 1) of what is within ``k_hops``.

    Nodes with equal sets of neighbours are alike: what lies beyond these neighbours is the same for all of them, but for the nodes
    themselves, and is looked for once. A node can be among what is reached from its neighbours, and is to be left out there.
    ``like`` has the number of neighbours and 128 bits that their hashes give: two different sets of n get one with a probability of n²/2¹²⁹."""
    both = neighbours(edges).distinct()
    own = starts.select("graph_id", F.col("node_id").alias("u")).distinct().join(both, ["graph_id", "u"])
    bits = [F.hex(F.bit_xor(F.xxhash64(x))) for x in (F.col("v"), F.md5(F.col("v").cast("binary")))]
    members = hold(own.groupBy("graph_id", F.col("u").alias("node_id")).agg(F.concat_ws(":", F.count(F.lit(1)), *bits).alias("like")).withColumn("like", F.concat_ws(":", "graph_id", "like")))
    one = members.groupBy("graph_id", "like").agg(F.min("node_id").alias("u"))
    if k_hops < 1:
        return members, one.where(F.lit(False)).select("like", "graph_id", F.col("u").alias("v"), F.lit(1).alias("depth"))
    frontier = one.join(both, ["graph_id", "u"]).select("like", "graph_id", "v", F.lit(1).alias("depth"))
    reached = frontier
    for hop in range(2, k_hops + 1):
        step = frontier.select("like", "graph_id", F.col("v").alias("u")).join(both, ["graph_id", "u"]).select("like", "graph_id", "v").distinct()
        # held, as the plan would grow with the power of the hops
        frontier = hold(step.join(reached.drop("depth"), ["like", "graph_id", "v"], "left_anti").withColumn("depth", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return members, reached


def _each(many: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """``many`` joined with what those of one ``key`` share; as few keys may have most rows, each key's rows are dealt out into SPREAD parts.
    The number of partitions is said, as both sides are small against what they make, by which Spark would not see how many tasks it takes."""
    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_part")
    dealt = many.withColumn("_part", F.pmod(F.xxhash64(*many.columns), F.lit(SPREAD)).cast("int")).repartition(n, key, "_part")
    return dealt.join(shared.select("*", part).repartition(n, key, "_part"), [key, "_part"]).drop("_part")


def expand(starts: DataFrame, edges: DataFrame, k_hops: int, key: list[str]) -> DataFrame:
    """The columns ``key``, graph_id, node_id and depth of what is within ``k_hops`` of each start (key, graph_id, node_id), one for a key."""
    members, levels = _alike(starts, edges, k_hops)
    known = starts.select(*key, "graph_id", "node_id")
    further = _each(known.join(members, ["graph_id", "node_id"]).withColumnRenamed("node_id", "_own").drop("graph_id"), levels, "like").where("v <> _own")
    return known.withColumn("depth", F.lit(0)).unionByName(further.select(*key, "graph_id", F.col("v").alias("node_id"), "depth"))


def count_hops(starts: DataFrame, edges: DataFrame, k_hops: int, key: list[str]) -> DataFrame:
    """The columns ``key``, depth, n: how many nodes ``expand`` finds at each depth. They are counted once for starts that are alike."""
    node = ["graph_id", "node_id"]
    members, levels = _alike(starts, edges, k_hops)
    levels = hold(levels)
    counts = levels.groupBy("like", "depth").agg(F.count(F.lit(1)).alias("n"))
    again = members.join(levels.select("like", "graph_id", F.col("v").alias("node_id"), F.col("depth").alias("_at")), ["like", *node]).drop("like")
    further = starts.select(*key, *node).join(members, node).join(again, node, "left").join(counts, "like")
    further = further.withColumn("n", F.col("n") - F.when(F.col("_at") == F.col("depth"), 1).otherwise(0)).where("n > 0")
    return starts.select(*key, F.lit(0).alias("depth"), F.lit(1).cast("long").alias("n")).unionByName(further.select(*key, "depth", "n"))


def beyond(seeds: DataFrame, edges: DataFrame, k_hops: int) -> DataFrame:
    """query_id, graph_id, node_id of what is within ``k_hops`` of a query's seeds, but neither a seed nor next to one. Queries whose seeds
    are alike share what lies beyond them, so it is put together once for these."""
    members, levels = _alike(seeds, edges, k_hops)
    of = seeds.join(members, ["graph_id", "node_id"]).groupBy("query_id").agg(F.array_sort(F.collect_set("like")).alias("likes"), F.collect_set(F.struct("graph_id", "node_id")).alias("_own"))
    of = hold(of.withColumn("seen", F.md5(F.array_join("likes", " ").cast("binary"))))
    sets = of.groupBy("seen").agg(F.first("likes").alias("likes")).select("seen", F.explode("likes").alias("like"))
    far = sets.join(levels, "like").groupBy("seen", "graph_id", F.col("v").alias("node_id")).agg(F.min("depth").alias("depth")).where("depth >= 2").drop("depth")
    return _each(of.drop("likes"), far, "seen").where(~F.array_contains("_own", F.struct("graph_id", "node_id"))).select("query_id", "graph_id", "node_id")


def induced(reached: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """The columns ``key`` and those of the edges that have both ends among what one key has reached.

    Edges between nodes that no key reaches are left out first. Each of the others is then found from its end with fewer edges: a hub that
    every key reaches would otherwise bring all its edges to every key."""
    node = ["graph_id", "node_id"]
    some = reached.select(*node).distinct()
    end = lambda c: some.withColumnRenamed("node_id", c)
    inner = hold(edges.join(end("src"), ["graph_id", "src"], "left_semi").join(end("dst"), ["graph_id", "dst"], "left_semi"))
    many = neighbours(inner).groupBy("graph_id", "u").agg(F.count(F.lit(1)).alias("_n"))
    of = lambda c: many.select("graph_id", F.col("u").alias(c), F.col("_n").alias(f"_{c}"))
    fewer = F.col("_src") <= F.col("_dst")
    found = inner.join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "dst"]).withColumns({"_from": F.when(fewer, F.col("src")).otherwise(F.col("dst")), "_to": F.when(fewer, F.col("dst")).otherwise(F.col("src"))})
    at = reached.select(*key, "graph_id", F.col("node_id").alias("_from"))
    to = reached.select(*key, "graph_id", F.col("node_id").alias("_to"))
    return found.join(at, ["graph_id", "_from"]).join(to, [*key, "graph_id", "_to"]).select(*key, *edges.columns)


def retrieve(gs: GraphSet, index: DataFrame | Lists, queries: DataFrame, top_k: int = 10, k_hops: int = 1, multi_graph: bool | None = None) -> Retrieved:
    """The composed subgraph of each query: the union, over its ``top_k`` best nodes, of what each reaches in ``k_hops`` (edges taken both
    ways) with the edges inside. Queries without tokens or hits have no seeds and no nodes."""
    seeds = hold(search(index, queries, top_k))
    # read by nodes and by both ends of edges
    reached = hold(expand(seeds, gs.edges, k_hops, ["query_id", "rank"]))
    ids = reached.select("query_id", "graph_id", "node_id").distinct()
    edges = induced(reached, gs.edges, ["query_id", "rank"]).drop("rank").dropDuplicates(["query_id", "graph_id", "src", "dst"])
    if multi_graph is None:
        multi_graph = gs.graphs.limit(2).count() > 1
    return Retrieved(queries, seeds, gs.nodes.join(ids, ["graph_id", "node_id"]), edges, multi_graph)


def shortest_paths(edges: DataFrame, starts: DataFrame, key: list[str]) -> DataFrame:
    """``key``, start, node, path (array of nodes): a shortest path from every start to what it can reach along edges (u, v of each key,
    both directions given); among equally short ones the least by node ids. Runs until nothing new is reached. A step leads to
    the frontier, the one before it or new nodes, so it is compared with these two only."""
    frontier = hold(starts.select(*key, "start", F.col("start").alias("node"), F.array("start").alias("path")))
    levels, near = [frontier], frontier
    while True:
        fresh = _step(frontier, near, edges, [*key, "start"], key)
        near, frontier = frontier.unionByName(fresh), fresh
        if frontier.isEmpty():
            break
        levels.append(frontier)
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    return reached


def _step(frontier: DataFrame, near: DataFrame, edges: DataFrame, of: list[str], key: list[str], back: bool = False) -> DataFrame:
    """The next frontier (``of``, node, path), held: what edges (key, u, v) lead to and ``near`` has not; paths grow at their ends, or at
    their beginnings if ``back``."""
    step = frontier.join(edges.withColumnRenamed("u", "node"), [*key, "node"])
    path = F.concat(F.array("v"), "path") if back else F.concat("path", F.array("v"))
    step = step.select(*of, F.col("v").alias("node"), path.alias("path")).groupBy(*of, "node").agg(F.min("path").alias("path"))
    return hold(step.join(near.select(*of, "node"), [*of, "node"], "left_anti"))


def pair_paths(edges: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """``key``, a, b, path: a shortest path between the two nodes of each pair (key, a, b), the least by node ids among equally short
    ones; pairs without a path are left out. edges: key, u, v, both directions given.

    Both ends of a pair look for each other: one frontier goes on from a, one from b, by turns, and the pair is done at the first step
    at which they meet. So a path takes steps for half its length from either side, what lies beyond is never reached, and paths
    are carried as halves. A pair is dropped when it is done, or when one of its frontiers ends; a frontier is compared with the
    one before it only, as edges lead to neighbouring levels."""
    of = [*key, "a", "b"]
    pairs = hold(pairs.select(*of).distinct())
    start = lambda end: pairs.select(*of, F.col(end).alias("node"), F.array(end).alias("path"))
    front = [start("a"), start("b")]
    near = list(front)
    done = pairs.where("a = b").select(*of, F.array("a").alias("path"))
    front = [f.where("a <> b") for f in front]
    turn = 0
    while True:
        fresh = _step(front[turn], near[turn], edges, of, key, turn == 1)
        met = fresh.select(*of, "node", F.col("path").alias("own")).join(front[1 - turn].select(*of, "node", F.col("path").alias("other")), [*of, "node"])
        # the node where they meet is in both halves
        whole = F.concat("own", F.expr("slice(other, 2, greatest(size(other) - 1, 0))")) if turn == 0 else F.concat("other", F.expr("slice(own, 2, greatest(size(own) - 1, 0))"))
        met = hold(met.select(*of, whole.alias("path")).groupBy(*of).agg(F.min("path").alias("path")))
        done = done.unionByName(met)
        left = fresh.join(met.select(*of), of, "left_anti")
        if left.isEmpty():
            return done
        near[turn], front[turn] = front[turn].unionByName(fresh), left
        # pairs that are done, or whose other side has ended, ask no more
        front[1 - turn] = front[1 - turn].join(left.select(*of).distinct(), of, "left_semi")
        turn = 1 - turn
