"""Graphs and their token index in a folder: written in runs, read by buckets of tokens, deletable by graph.

Every call of ``add`` writes one run: graphs, nodes and edges as they are, and the postings in ``bucket=`` folders by a hash of the
token, sorted by token in each, with the number of nodes and the greatest weight of each token beside them. A graph lies in
one run only, and places count within a graph, so reading runs together is all that merging them takes. A search reads the
folders of its tokens' buckets (and, where it has few tokens, the row groups that can hold them), whatever the size of the index.

A manifest row is written after the data of its run; runs that it doesn't name (of a job that failed) are not read. ``remove`` writes
the ids of graphs to be left out from then on; ``compact`` writes one run of what is left. Counts are not lessened by removals
until then, which a search allows for: they only decide what is looked up first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import index
from tabweave.plans.shared import new_folder
from tabweave.schema import GraphSet

#: Postings of a bucket that a new store aims at, and the bounds of its number of buckets.
BUCKET_POSTINGS, BUCKETS = 250_000, (8, 4096)
#: Distinct tokens that a scan is told by name.
NAMED_TOKENS = 500
MANIFEST = "run int, kind string, buckets int"


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class StoredIndex:
    """The postings of a store's runs."""

    postings: DataFrame
    counts: DataFrame
    buckets: int
    removed: DataFrame | None

    def _pruned(self, tokens: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """What cuts a table down to the tokens: by name and bucket if they are few, else by bucket and a join."""
        wanted = tokens.select("token").distinct()
        few = [r["token"] for r in wanted.limit(NAMED_TOKENS + 1).collect()]
        if not few:
            return lambda table: table.where(F.lit(False))
        bucket = bucket_of(F.col("token"), self.buckets)
        if len(few) <= NAMED_TOKENS:
            at = {r["b"] for r in tokens.sparkSession.createDataFrame([(t,) for t in few], "token string").select(bucket.alias("b")).collect()}
            return lambda table: table.where(F.col("bucket").isin(sorted(at)) & F.col("token").isin(few))
        if len(few) > 8 * self.buckets:  # next to no bucket is left out
            return lambda table: table.join(wanted, "token", "left_semi")
        at = {r["b"] for r in wanted.select(bucket.alias("b")).distinct().collect()}
        return lambda table: table.where(F.col("bucket").isin(sorted(at))).join(wanted, "token", "left_semi")

    def find(self, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings of the tokens (column token), from their buckets; and token, nodes (at most; removed graphs count until the next
        ``compact``), most (the greatest weight)."""
        pruned = self._pruned(tokens)
        found = pruned(self.postings).drop("bucket", "run")
        sizes = pruned(self.counts).groupBy("token").agg(F.sum("nodes").alias("nodes"), F.max("most").alias("most"))
        return (found if self.removed is None else found.join(self.removed, "graph_id", "left_anti")), sizes

    def all(self) -> DataFrame:
        found = self.postings.drop("bucket", "run")
        return found if self.removed is None else found.join(self.removed, "graph_id", "left_anti")


class GraphStore:
    """Graphs with their token index. Without a ``path`` the folder goes when the driver's Python ends."""

    def __init__(self, gs: GraphSet | None = None, path: str | None = None, spark: SparkSession | None = None, buckets: int | None = None) -> None:
        self.spark = spark or (gs.nodes.sparkSession if gs is not None else SparkSession.active())
        self.path = path or new_folder(self.spark)
        self._buckets, self._kinds = buckets, {}
        if path is not None:
            self._reload()
        if gs is not None:
            self.add(gs)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphStore:
        """A store that was written before."""
        store = cls(path=path, spark=spark)
        if not store._kinds:
            raise ValueError(f"{path} holds no graphs")
        return store

    def _reload(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return
        for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").orderBy("run").collect():
            self._kinds[r["run"]] = r["kind"]
            self._buckets = r["buckets"]

    def _runs(self, kind: str) -> list[int]:
        first = max([k for k, v in self._kinds.items() if v == "compacted"], default=-1)
        return [k for k, v in self._kinds.items() if k >= first and (v == kind or v == "compacted" and kind == "graphs")]

    def _read(self, name: str, kind: str = "graphs") -> DataFrame | None:
        paths = [f"{self.path}/{name}/run={k}" for k in self._runs(kind)]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths) if paths else None

    def _close_run(self, run: int, kind: str) -> None:
        self.spark.createDataFrame([(run, kind, self._buckets or 0)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self._kinds[run] = kind

    def _write(self, gs: GraphSet, kind: str = "graphs") -> None:
        run = max(self._kinds, default=-1) + 1
        for name in ("graphs", "nodes", "edges"):
            getattr(gs, name).write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")
        # from the written tables, so that the builders' plans run once
        again = GraphSet(*[self.spark.read.parquet(f"{self.path}/{n}/run={run}") for n in ("graphs", "nodes", "edges")])
        if self._buckets is None:
            # a new store's first run decides, by its nodes and edges, as their texts have some ten tokens
            many = 10 * (again.nodes.count() + again.edges.count()) // BUCKET_POSTINGS
            self._buckets = min(max(1 << many.bit_length(), BUCKETS[0]), BUCKETS[1])
        # the one exchange is hashed by bucket, and rows of a bucket are sorted by token
        placed = index.postings(again, lambda token: bucket_of(token, self._buckets)).sortWithinPartitions("bucket", "token", "graph_id", "node_id")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/run={run}")
        written = self.spark.read.parquet(f"{self.path}/postings/run={run}")
        counts = written.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("nodes"), F.max("weight").alias("most"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts/run={run}")
        self._close_run(run, kind)

    def add(self, gs: GraphSet) -> int:
        """Append graphs. If one of their ids is taken (or was removed since the last ``compact``), all of them are moved on behind the
        store's greatest id; what was added to their ids is returned."""
        taken, by = self._read("graphs"), 0
        if taken is not None and not gs.graphs.join(taken.select("graph_id"), "graph_id", "left_semi").isEmpty():
            by = taken.agg(F.max("graph_id")).first()[0] + 1 - gs.graphs.agg(F.min("graph_id")).first()[0]
            gs = GraphSet(*[t.withColumn("graph_id", F.col("graph_id") + by) for t in (gs.graphs, gs.nodes, gs.edges)])
        self._write(gs)
        return by

    def add_all(self, many: list[GraphSet]) -> list[int]:
        """Append several sets, in order."""
        return [self.add(gs) for gs in many]

    def remove(self, graph_ids: list[int] | DataFrame) -> None:
        """Leave graphs out from now on. A DataFrame has a column graph_id."""
        ids = graph_ids if isinstance(graph_ids, DataFrame) else self.spark.createDataFrame([(i,) for i in graph_ids], "graph_id long")
        run = max(self._kinds, default=-1) + 1
        ids.select("graph_id").distinct().write.mode("overwrite").parquet(f"{self.path}/removed/run={run}")
        self._close_run(run, "removed")

    def compact(self) -> None:
        """Write one run of all graphs that are left, which replaces those before; their files stay until the folder is cleared."""
        if self._runs("graphs"):
            self._write(self.graphs, "compacted")

    def _removed(self) -> DataFrame | None:
        found = self._read("removed", "removed")
        return None if found is None else found.select("graph_id").distinct()

    @property
    def graphs(self) -> GraphSet:
        tables, removed = [self._read(n) for n in ("graphs", "nodes", "edges")], self._removed()
        if tables[0] is None:
            raise ValueError("the store holds no graphs")
        return GraphSet(*[t.drop("run") if removed is None else t.drop("run").join(removed, "graph_id", "left_anti") for t in tables])

    @property
    def index(self) -> StoredIndex:
        postings, counts = self._read("postings"), self._read("counts")
        if postings is None:
            raise ValueError("the store holds no graphs")
        return StoredIndex(postings, counts, self._buckets, self._removed())

    @property
    def postings(self) -> DataFrame:
        """The whole index."""
        return self.index.all()

    def __len__(self) -> int:
        return self.graphs.graphs.count() if self._runs("graphs") else 0
