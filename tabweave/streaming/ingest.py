"""Incremental ingest: each micro-batch of documents is read, normalized, classified, built and indexed, and appended.

A table is never cut over batches, as it lies in one document. Appends are keyed by batch: the folder of a batch is
overwritten if the batch is run again, so a restart does not repeat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabweave.operators import index
from tabweave.plans.api import build_graphs, classify_tables, normalize_tables
from tabweave.plans.shared import held_for_now, hold
from tabweave.schema import GraphSet, TableSet
from tabweave.sources import text_tables

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def tables_of(docs: DataFrame) -> TableSet:
    """The Markdown and HTML tables of documents; HTML tables come after a document's Markdown tables."""
    # pipes on a page of HTML make a table only if there is a rule as well
    marked = ~text_tables.has_html(F.col("text")) | text_tables.has_markdown(F.col("text"))
    md = text_tables.read_markdown(docs.where(marked))
    before = F.when(marked & F.col("text").contains("|"), F.size(text_tables.markdown_grids(F.col("text")))).otherwise(0)
    html = text_tables.read_html(docs, first_index=F.coalesce(before, F.lit(0)))
    return TableSet(md.tables.unionByName(html.tables), md.rows.unionByName(html.rows))


def ingest_batch(docs: DataFrame, out: str, batch_id: int) -> None:
    """Append the graphs and postings of one batch under ``out``/{graphs,nodes,edges,postings}/batch=N."""
    with held_for_now():
        found = normalize_tables(tables_of(docs))
        ts = TableSet(hold(found.tables), hold(found.rows))
        types = hold(classify_tables(ts))
        if types.where("table_type <> 'unknown'").isEmpty():
            return
        gs = build_graphs(ts, types)
        for name, df in (("graphs", gs.graphs), ("nodes", gs.nodes), ("edges", gs.edges), ("postings", index.postings(gs))):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")


def ingest_stream(spark: SparkSession, source: str, out: str, checkpoint: str, schema: T.StructType = DOCUMENTS, max_files: int = 64) -> StreamingQuery:
    """Start a query that takes new Parquet files of documents from ``source`` until there are none left."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return docs.writeStream.foreachBatch(lambda df, n: ingest_batch(df, out, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_graphs(spark: SparkSession, out: str) -> tuple[GraphSet, DataFrame]:
    """The graphs and the postings that have been ingested so far."""
    read = lambda name: spark.read.parquet(f"{out}/{name}").drop("batch")
    return GraphSet(read("graphs"), read("nodes"), read("edges")), read("postings")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events per window and type, with late events up to a bound."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
