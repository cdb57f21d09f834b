"""Cell normalizers and the stitching of tables."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tabweave.functions.text import ISO_DATE, SLASH_DATE, looks_numeric, squeeze, strip
from tabweave.schema import CELL, TableSet


#: Rows of a table that one task fills or scans in order.
PART_ROWS = 1 << 16


def _text_only(c: Column, change) -> Column:
    """Apply ``change`` to the text of str cells."""
    return F.struct(F.when(c["t"] == "str", change(c["v"])).otherwise(c["v"]).alias("v"), c["t"].alias("t")).cast(CELL)


def whitespace(ts: TableSet) -> TableSet:
    """White space of texts and headers squeezed to single spaces, none at the ends. Note: this removes indentation."""
    tables = ts.tables.withColumn("headers", F.transform("headers", lambda level: F.transform(level, squeeze)))
    return TableSet(tables, ts.rows.withColumn("cells", F.transform("cells", lambda c: _text_only(c, squeeze))))


def whitespace_keep_indent(ts: TableSet) -> TableSet:
    """Like ``whitespace``, but the first cell of a row keeps its leading blanks, so that indented hierarchies survive."""
    done = whitespace(ts)
    indent = lambda v: F.concat(F.regexp_extract(v, r"^[ \t]*", 0), squeeze(v))
    cells = F.transform(ts.rows["cells"], lambda c, i: F.when(i == 0, _text_only(c, indent)).otherwise(_text_only(c, squeeze)))
    return done.with_rows(ts.rows.withColumn("cells", cells))


def fill_column(value: Column, window_by: list[Column | str], order: Column | str) -> Column:
    """Forward fill: null or empty takes the last value above that is neither; the first row keeps what it has."""
    w = Window.partitionBy(*window_by).orderBy(order)
    down = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(F.last(F.nullif(value, F.lit("")), True).over(down), F.first(value).over(down))


def merged_cells(ts: TableSet, part_rows: int = PART_ROWS) -> TableSet:
    """Null and empty cells take the value above, column by column, from the second row on.

    A table is cut into parts of ``part_rows`` rows. The last value of each part and column is carried over the parts that follow, one row
    a part, and then each part is filled on its own, so a long table is many tasks and none holds a column. Rows move once, by table
    and part; cells are laid out, filled and put together again where they are."""
    at = F.floor(F.col("row_idx") / part_rows)
    rows = ts.rows.withColumn("_part", at)
    is_some = F.col("c.v").isNotNull() & ((F.col("c.v") != "") | (F.col("c.t") != "str"))
    laid = rows.select("table_id", "_part", "row_idx", F.posexplode("cells").alias("col_idx", "c"))
    ends = laid.groupBy("table_id", "_part", "col_idx").agg(F.max_by("c", F.when(is_some, F.col("row_idx"))).alias("last"), F.min_by("c", "row_idx").alias("first"))
    before = Window.partitionBy("table_id", "col_idx").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("up", F.coalesce(F.last("last", True).over(before), F.first("first", True).over(before))).where("up is not null")
    carried = carried.groupBy("table_id", "_part").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "up"))).alias("_up"))
    whole = rows.where(F.size("cells") > 0).repartition("table_id", "_part").join(carried, ["table_id", "_part"], "left")
    cells = whole.select("table_id", "_part", "row_idx", "_up", F.posexplode("cells").alias("col_idx", "c"))
    w = Window.partitionBy("table_id", "_part", "col_idx").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = cells.withColumn("c", F.coalesce(F.last(F.when(is_some, F.col("c")), True).over(w), F.try_element_at("_up", F.col("col_idx")), F.first("c").over(w)))
    done = filled.groupBy("table_id", "_part", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "c"))), lambda x: x["c"]).alias("cells")).drop("_part")
    empty = ts.rows.where(F.size("cells") == 0)
    return ts.with_rows(done.unionByName(empty))


def data_type(v: Column, t: Column) -> Column:
    """empty, numeric, date or text."""
    s = strip(v)
    return (
        F.when(v.isNull() | (t == "none"), "empty")
        .when(t.isin("int", "float", "bool"), "numeric")
        .when(s == "", "empty")
        .when(looks_numeric(s), "numeric")
        .when(s.rlike(ISO_DATE) | s.rlike(SLASH_DATE), "date")
        .otherwise("text")
    )


def data_types(ts: TableSet) -> TableSet:
    """Adds ``data_types`` to the rows: the type of each cell."""
    return ts.with_rows(ts.rows.withColumn("data_types", F.transform("cells", lambda c: data_type(c["v"], c["t"]))))


def header_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two header rows, lower-cased and stripped; 0 if either has none."""
    sets = [F.array_distinct(F.transform(x, lambda h: strip(F.lower(h)))) for x in (a, b)]
    both, either = F.size(F.array_intersect(*sets)), F.size(F.array_union(*sets))
    return F.when((F.size(sets[0]) > 0) & (F.size(sets[1]) > 0), both / either).otherwise(F.lit(0.0))


def multipage_stitch(ts: TableSet, by: str = "source_file", threshold: float = 0.8) -> TableSet:
    """Tables of one source, in order, whose first header row is like that of the chain before them, appended to it.

    The fold sees the headers only, and of neighbours with equal headers, which share their fate, one; rows are moved by their new table
    id and place, and never gathered."""
    order = F.struct("page_number", "table_index", "table_id")
    t = ts.tables.select(F.col(by).alias("_by"), order.alias("o"), F.col("table_id").alias("id"), F.get("headers", F.lit(0)).alias("h"))
    w = Window.partitionBy("_by").orderBy("o")
    goes_on = F.coalesce((F.size("h") > 0) & (F.col("h") == F.lag("h").over(w)), F.lit(False))
    t = t.withColumn("_run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy("_by", "_run").agg(F.min("o").alias("o"), F.min_by("id", "o").alias("id"), F.min_by("h", "o").alias("h"))
    parts = runs.groupBy("_by").agg(F.sort_array(F.collect_list(F.struct("_run", "id", "h"))).alias("t"))
    kind = "struct<head:bigint,h:array<string>,done:array<struct<_run:bigint,head:bigint>>>"

    def step(now: Column, x: Column) -> Column:
        joins = F.coalesce(now["h"].isNotNull() & x["h"].isNotNull() & (header_similarity(now["h"], x["h"]) >= threshold), F.lit(False))
        head = F.when(joins, now["head"]).otherwise(x["id"])
        return F.struct(head.alias("head"), F.when(joins, now["h"]).otherwise(x["h"]).alias("h"), F.concat(now["done"], F.array(F.struct(x["_run"].alias("_run"), head.alias("head")))).alias("done")).cast(kind)

    none = F.struct(F.lit(None).alias("head"), F.lit(None).alias("h"), F.array().alias("done")).cast(kind)
    heads = parts.select("_by", F.explode(F.aggregate("t", none, step)["done"]).alias("x")).select("_by", "x.*")
    same = (t["_by"].eqNullSafe(heads["_by"])) & (t["_run"] == heads["_run"])
    joined = t.join(heads, same).select(F.col("head"), F.col("id").alias("table_id"), "o")
    moved = joined.withColumn("nth", F.row_number().over(Window.partitionBy("head").orderBy("o")) - 1).drop("o")
    sizes = ts.rows.groupBy("table_id").agg((F.max("row_idx") + 1).alias("n"))
    w = Window.partitionBy("head").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = moved.join(sizes, "table_id", "left").withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(w), F.lit(0))).select("table_id", "head", "before")
    rows = ts.rows.join(offsets, "table_id").withColumns({"table_id": F.col("head"), "row_idx": F.col("row_idx") + F.col("before")}).select(*ts.rows.columns)
    return TableSet(ts.tables.join(moved.where("nth = 0").select("table_id"), "table_id", "left_semi"), rows)


#: The names that a chain of normalizers is made of.
DEFAULT_CHAIN = ("whitespace", "merged_cells", "data_types")
