"""Tables from data that is a grid already: nested lists, pandas and Spark DataFrames, CSV and TSV files."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.text import float_repr
from tabweave.plans.shared import number_as_they_come, number_rows
from tabweave.schema import CELL, ROWS, TABLES, TableSet
from tabweave.sources.text_tables import table_columns

#: Texts that stand for a missing value in a CSV file (fixed values).
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def cell_of(x: Any) -> tuple[str | None, str]:
    """A Python value as a cell: its printed text and its type."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None, "none"
    if isinstance(x, bool):
        return str(x), "bool"
    if isinstance(x, int):
        return str(x), "int"
    return (repr(x), "float") if isinstance(x, float) else (str(x), "str")


def from_lists(spark: SparkSession, found: list[dict]) -> TableSet:
    """A TableSet from literal tables: dicts with headers (list of levels), rows (lists of Python values) and, if known, the other
    columns of TABLES. Their table ids are their places in the list unless given."""
    tables, rows = [], []
    for i, t in enumerate(found):
        full = {"table_id": i, "source_file": "nested_list", "table_index": 0, "extraction_method": "dataframe"} | t
        full["headers"] = [[("" if h is None else str(h)) for h in level] for level in full.get("headers") or []]
        tables.append(tuple(full.get(f.name) for f in TABLES))
        rows += [(full["table_id"], r, [cell_of(x) for x in row]) for r, row in enumerate(full.get("rows") or [])]
    return TableSet(spark.createDataFrame(tables, TABLES).coalesce(1), spark.createDataFrame(rows, ROWS))


def from_nested(spark: SparkSession, data: list[list[Any]], source_file: str = "nested_list") -> TableSet:
    """One table: the first list is the header. An empty list is an empty table."""
    return from_lists(spark, [{"headers": data[:1], "rows": data[1:], "source_file": source_file}])


def from_pandas(spark: SparkSession, df: Any, source_file: str = "dataframe") -> TableSet:
    """One table from a pandas DataFrame; the levels of its columns are header levels."""
    headers = [[str(x) for x in df.columns.get_level_values(i)] for i in range(df.columns.nlevels)]
    values = df.astype(object).where(df.notna(), None).values.tolist()
    return from_lists(spark, [{"headers": headers, "rows": values, "source_file": source_file}])


def cell_column(c: Column, kind: T.DataType) -> Column:
    """A column as a cell."""
    if isinstance(kind, T.BooleanType):
        v, t = F.initcap(c.cast("string")), "bool"
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
        v, t = float_repr(c.cast("double")), "float"
    elif isinstance(kind, T.IntegralType):
        v, t = c.cast("string"), "int"
    else:
        v, t = c.cast("string"), "str"
    return F.struct(v.alias("v"), F.when(v.isNull(), "none").otherwise(t).alias("t")).cast(CELL)


def from_spark(df: DataFrame, order: list[str | Column] | None, table_id: int = 0, source_file: str = "dataframe", headers: list[list[str]] | None = None, numbered: bool = True) -> TableSet:
    """One table from a Spark DataFrame of any size, its rows in ascending order of the given columns; ``headers`` replaces the column
    names. Without an order the rows stay as the DataFrame has them. Rows that are not ``numbered`` have null numbers and cost no sort:
    types, profiles, features and classification of tables with headers read no numbers."""
    spark = df.sparkSession
    cells = F.array(*[cell_column(F.col(f"`{f.name}`"), f.dataType) for f in df.schema])
    # the id is stored with the rows: as a literal it would make joins on it products
    own = F.lit(table_id).cast("long").alias("table_id")
    if not numbered:
        rows = df.select(own, F.lit(None).cast("long").alias("row_idx"), cells.alias("cells"))
    elif order is None:
        rows = number_as_they_come(df.select(own, cells.alias("cells"))).select("table_id", "row_idx", "cells")
    else:
        named = {f"_order{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
        rows = number_rows(df.select(own, cells.alias("cells"), *[c.alias(k) for k, c in named.items()]), [F.col(k) for k in named]).select("table_id", "row_idx", "cells")
    one = spark.createDataFrame([(table_id, headers or [df.columns])], "table_id long, headers array<array<string>>").coalesce(1)
    return TableSet(one.select(*table_columns(table_id=F.col("table_id"), source_file=F.lit(source_file), table_index=F.lit(0), extraction_method=F.lit("dataframe"), headers=F.col("headers"))), rows)


def read_csv(spark: SparkSession, path: str, sep: str = ",", table_id: int = 0, multi_line: bool = True) -> TableSet:
    """One table from a CSV file: row 0 is the header, column types are inferred from all values. Whole numbers print as
    such, or as floats if their column has a gap; texts that stand for missing values are null. Quoted line feeds are part of a
    cell. A file is then read by one task, as only its beginning tells what is quoted; without quoted line feeds, ``multi_line=False``
    lets many tasks read a large file."""
    raw = spark.read.csv(path, header=True, sep=sep, inferSchema=False, quote='"', escape='"', multiLine=multi_line).withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    names = [c for c in raw.columns if c not in ("_file", "_start", "_at")]
    clean = raw.select(*[F.when(~F.col(f"`{n}`").isin(*MISSING), F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(names)], "_file", "_start", "_at")
    columns = [F.col(f"c{i}") for i in range(len(names))]
    counts = clean.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"some{i}") for i, c in enumerate(columns)],
        *[F.count_if(c.rlike(r"^\s*[+-]?\d+\s*$")).alias(f"int{i}") for i, c in enumerate(columns)],
        *[F.count_if(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")).alias(f"num{i}") for i, c in enumerate(columns)],
        *[F.count_if(c.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"bool{i}") for i, c in enumerate(columns)],
    ).first()
    cells = []
    for i, c in enumerate(columns):
        some, n = counts[f"some{i}"], counts["n"]
        if some and counts[f"int{i}"] == some == n:
            cells.append(cell_column(F.trim(c).cast("long"), T.LongType()))
        elif some and counts[f"num{i}"] == some:
            cells.append(cell_column(F.trim(c).cast("double"), T.DoubleType()))
        elif some and counts[f"bool{i}"] == some == n:
            cells.append(cell_column(F.lower(c).cast("boolean"), T.BooleanType()))
        else:
            cells.append(cell_column(c, T.StringType()))
    rows = number_rows(clean.select(F.lit(table_id).cast("long").alias("table_id"), F.array(*cells).alias("cells"), "_file", "_start", "_at"), [F.col("_file"), F.col("_start"), F.col("_at")])
    one = spark.createDataFrame([(table_id, [names])], "table_id long, headers array<array<string>>").coalesce(1)
    tables = one.select(*table_columns(table_id=F.col("table_id"), source_file=F.lit(path), table_index=F.lit(0), extraction_method=F.lit("dataframe"), headers=F.col("headers")))
    return TableSet(tables, rows.select("table_id", "row_idx", "cells"))


def read_tsv(spark: SparkSession, path: str, table_id: int = 0, multi_line: bool = True) -> TableSet:
    return read_csv(spark, path, "\t", table_id, multi_line)
