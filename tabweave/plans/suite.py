"""Retrieval suites: literal tables, queries and the texts that an answer must hold, and the share of queries whose context holds them.

A suite is a JSON file: ``{"tables": [{"name", "headers": [[...], ...], "rows": [[...], ...]}, ...], "queries": [{"archetype", "query",
"targets": [...]}, ...]}``. Graph retrieval (types, graphs, index, ``top_k`` seeds, ``k_hops``, node-centric text without a budget) and the
flat baseline (the one row of any table that has most of a query's words) answer the same queries, each in one job."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import context, index
from tabweave.plans import api
from tabweave.plans.shared import hold
from tabweave.schema import TableSet
from tabweave.sources import grids


def load(spark: SparkSession, path: str) -> tuple[TableSet, DataFrame]:
    """The tables, and the queries (query_id, archetype, query, targets), of a suite file that the driver reads."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    ts = grids.from_lists(spark, [{"source_file": t["name"], "headers": t["headers"], "rows": t["rows"]} for t in found["tables"]])
    queries = [(i, q["archetype"], q["query"], q["targets"]) for i, q in enumerate(found["queries"])]
    return ts, spark.createDataFrame(queries, "query_id long, archetype string, query string, targets array<string>")


def answers(ts: TableSet, queries: DataFrame, top_k: int = 10, k_hops: int = 1) -> DataFrame:
    """query_id, archetype, graph_hit, flat_hit of every query."""
    gs = api.build_graphs(ts)
    texts = hold(api.retrieve_context(gs, queries.select("query_id", "query"), "node-centric", top_k, k_hops))
    flat = index.best_chunk(index.flat_chunks(ts.tables, ts.rows), queries.select("query_id", "query")).select("query_id", F.col("chunk").alias("flat"))
    both = queries.join(texts, "query_id", "left").join(flat, "query_id", "left")
    hit = lambda c: F.coalesce(context.hit(F.col(c), F.col("targets")), F.lit(False))
    return both.select("query_id", "archetype", hit("context").alias("graph_hit"), hit("flat").alias("flat_hit"))


def rates(found: DataFrame) -> DataFrame:
    """archetype (null: all), asked, graph_hits, flat_hits."""
    return found.rollup("archetype").agg(F.count(F.lit(1)).alias("asked"), F.count_if("graph_hit").alias("graph_hits"), F.count_if("flat_hit").alias("flat_hits"))


def main() -> None:
    """``python -m tabweave.plans.suite FILE``: the rates of a suite file."""
    import sys

    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    rates(answers(*load(spark, sys.argv[1]))).orderBy("archetype").show(50, False)


if __name__ == "__main__":
    main()
