"""The tables that the engine works on.

A corpus of two-dimensional tables is a ``TableSet``: one row per table and one row per table row, whose cells are an array, so
that ragged rows and missing cells stay what they are. A set of property graphs is a ``GraphSet`` of plain DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A cell: its text as Python would print it (null: no value) and its type, one of str, int, float, bool, none.
CELL = T.StructType([T.StructField("v", T.StringType()), T.StructField("t", T.StringType())])
BBOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x0", "y0", "x1", "y1")])
TABLES = T.StructType(
    [
        T.StructField("table_id", T.LongType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("table_index", T.IntegerType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("bbox", BBOX),
        T.StructField("context", T.StringType()),
        T.StructField("headers", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
ROWS = T.StructType([T.StructField("table_id", T.LongType()), T.StructField("row_idx", T.LongType()), T.StructField("cells", T.ArrayType(CELL))])
#: A property: name, printed value, and type (str, int or float).
PROP = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType()), T.StructField("t", T.StringType())])
PROPS = T.ArrayType(PROP)
ARCHETYPES = ("key_value", "comparison", "time_series", "hierarchical", "matrix", "relational", "pivot")


@dataclass(frozen=True)
class TableSet:
    """tables: TABLES, one row per table. rows: ROWS, one row per table row."""

    tables: DataFrame
    rows: DataFrame

    def cells(self) -> DataFrame:
        """The long form: table_id, row_idx, col_idx, v, t; a missing cell has no row."""
        return self.rows.select("table_id", "row_idx", F.posexplode("cells").alias("col_idx", "c")).select("table_id", "row_idx", "col_idx", "c.v", "c.t")

    def header_cells(self) -> DataFrame:
        """table_id, level, col_idx, text of every header cell."""
        levels = self.tables.select("table_id", F.posexplode("headers").alias("level", "h"))
        return levels.select("table_id", "level", F.posexplode("h").alias("col_idx", "text"))

    def with_rows(self, rows: DataFrame) -> TableSet:
        return replace(self, rows=rows)

    def to_wide(self, table_id: int, sep: str = " / ") -> DataFrame:
        """One table as a DataFrame with a column per header; the names of several levels are joined by ``sep``."""
        headers = self.tables.where(F.col("table_id") == table_id).select("headers").first()["headers"] or [[]]
        names = [sep.join(dict.fromkeys(str(level[i]) for level in headers if i < len(level))) for i in range(len(headers[0]))]
        rows = self.rows.where(F.col("table_id") == table_id)
        return rows.orderBy("row_idx").select(*[F.get("cells", F.lit(i))["v"].alias(n) for i, n in enumerate(names)])


@dataclass(frozen=True)
class GraphSet:
    """graphs: one row per graph (id, provenance, type, directed). nodes and edges: their properties and the order in which
    they were made: node_ord within a graph; (src_ord, seq) for an edge, by its source node and then by insertion."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def counts(self) -> DataFrame:
        """graph_id, node_count, edge_count of every graph."""
        n = self.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("node_count"))
        e = self.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count"))
        counted = self.graphs.select("graph_id").join(n, "graph_id", "left").join(e, "graph_id", "left")
        return counted.fillna(0, ["node_count", "edge_count"])


def num_cols(headers: str | F.Column = "headers") -> F.Column:
    """The number of columns that the headers name; null without headers."""
    h = F.col(headers) if isinstance(headers, str) else headers
    return F.when(F.size(h) > 0, F.size(F.get(h, F.lit(0))))
