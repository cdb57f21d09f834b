"""Structural features of tables and their classification into seven archetypes, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.text import NUMBERED, TEMPORAL, is_key_name, is_temporal, leading_blanks, looks_numeric, strip
from tabweave.plans.shared import hold
from tabweave.schema import ARCHETYPES, TableSet

SECONDARY = 0.3


def value_counts(cells: DataFrame) -> DataFrame:
    """Per table, column and distinct stripped text of a long cells DataFrame: cells, and how many of them end with a colon, are indented or
    begin with a number. Cells are counted by value first, map-side, so that patterns look at distinct values only. Rows without
    cells may be there with a null column."""
    by_value = cells.groupBy("table_id", "col_idx", "v").agg(F.count(F.lit(1)).alias("k"))
    c0 = F.coalesce("v", F.lit(""))
    kinds = by_value.withColumn("s", strip(c0)).withColumns({"n_labels": F.endswith("s", F.lit(":")), "n_indented": leading_blanks(c0) > 0, "n_numbered": F.coalesce(F.col("v").rlike(NUMBERED), F.lit(False)), "n_some": F.col("v").isNotNull()})
    many = lambda c: F.sum(F.when(F.col(c), F.col("k")).otherwise(0)).alias(c)
    return kinds.groupBy("table_id", "col_idx", "s").agg(F.sum("k").alias("k"), *[many(c) for c in ("n_labels", "n_indented", "n_numbered", "n_some")])


def profile_of(counted: DataFrame) -> DataFrame:
    some = counted.withColumns({"is_num": looks_numeric(F.col("s")), "is_empty": F.col("s") == ""})
    some = some.withColumn("is_time", F.when(F.col("is_num") | F.col("is_empty"), False).otherwise(F.col("s").rlike(TEMPORAL)))
    many = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("k"))), F.lit(0))
    return some.groupBy("table_id", "col_idx").agg(F.sum("k").alias("visited"), many("is_num").alias("n_numeric"), many("is_time").alias("n_temporal"), many("is_empty").alias("n_empty"), F.count_if(~F.col("is_empty")).alias("n_distinct"))


def column_profile(cells: DataFrame) -> DataFrame:
    """Per table and column of a long cells DataFrame: visited, numeric, temporal and empty cells, and distinct values."""
    return profile_of(value_counts(cells))


def column_type(n_numeric: Column, n_temporal: Column, non_empty: Column) -> Column:
    return F.when(non_empty == 0, "empty").when(n_numeric / non_empty >= 0.6, "numeric").when(n_temporal / non_empty >= 0.4, "date").otherwise("text")


def features(ts: TableSet) -> DataFrame:
    """One row per table with its structural signals. The rows are read once, as counts of distinct values by column, which are held."""
    laid = ts.rows.select("table_id", F.posexplode_outer("cells").alias("col_idx", "c")).select("table_id", "col_idx", "c.v")
    counted = hold(value_counts(laid))
    # every row has a first cell, or none at all
    per_row = counted.where("col_idx = 0 OR col_idx IS NULL")
    real = F.col("col_idx").isNotNull()
    shape = per_row.groupBy("table_id").agg(F.sum("k").alias("num_rows"), *[F.sum(F.when(real, F.col(c)).otherwise(0)).alias(c) for c in ("n_labels", "n_indented", "n_numbered")])
    h0 = F.get("headers", F.lit(0))
    # one small row a table, read by several branches
    t = hold(ts.tables.select("table_id", "headers", F.coalesce(h0, F.array().cast("array<string>")).alias("h0")))
    # without headers the first row tells the number of columns; rows are read for it only if there is such a table
    first = ts.rows.groupBy("table_id").agg(F.min_by(F.size("cells"), "row_idx").alias("first_width"))
    if t.where(F.size("headers") == 0).isEmpty():
        first = t.select("table_id", F.lit(None).cast("int").alias("first_width"))
    # an empty first header row leaves a table without columns, as no headers and no rows do
    wide = t.join(shape, "table_id", "left").join(first, "table_id", "left").fillna(0, ["num_rows", "n_labels", "n_indented", "n_numbered"])
    wide = wide.withColumn("num_cols", F.when(F.size("headers") > 0, F.size("h0")).otherwise(F.coalesce("first_width", F.lit(0))).cast("long"))
    names = wide.select("table_id", "num_cols", "num_rows")
    profile = profile_of(counted.where(real)).join(names, "table_id").where("col_idx < num_cols")
    non_empty = F.col("num_rows") - F.col("n_empty")
    typed = profile.withColumns({"type": column_type(F.col("n_numeric"), F.col("n_temporal"), non_empty), "unique": F.when(non_empty == 0, 0.0).otherwise(F.col("n_distinct") / non_empty)})
    columns = typed.groupBy("table_id").agg(F.sum("visited").alias("visited"), F.sum("n_numeric").alias("numeric"), F.map_from_entries(F.collect_list(F.struct("col_idx", F.struct("type", "unique")))).alias("by_col"))
    # rows that begin with a column's name: distinct first cells are counted, not gathered
    heads = wide.select("table_id", F.array_distinct(F.transform("h0", lambda x: strip(F.lower(x)))).alias("names"))
    starts = per_row.where(real & (F.col("n_some") > 0)).select("table_id", F.lower("s").alias("start")).distinct()
    met = starts.join(heads, "table_id").groupBy("table_id").agg(F.count(F.lit(1)).alias("n_starts"), F.count_if(F.array_contains("names", F.col("start"))).alias("n_common"), F.first(F.size("names")).alias("n_names"))
    out = wide.join(columns, "table_id", "left").join(met, "table_id", "left")
    of = lambda field, other: F.transform(F.when(F.col("num_cols") > 0, F.sequence(F.lit(0).cast("long"), F.col("num_cols") - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.coalesce(F.try_element_at("by_col", i.cast("int"))[field], other))
    rows, cols = F.col("num_rows"), F.col("num_cols")
    # a column that no row reaches has no empty cell either: with rows it is a text column without values
    unreached = F.when(rows > 0, "text").otherwise("empty")
    ratio = F.when(cols > 0, rows / cols).otherwise(0.0)
    either = F.col("n_names") + F.col("n_starts") - F.col("n_common")
    return out.select(
        "table_id",
        "headers",
        "num_rows",
        "num_cols",
        F.size("headers").alias("header_levels"),
        ratio.alias("row_col_ratio"),
        ((ratio >= 0.7) & (ratio <= 1.3) & (rows >= 2)).alias("is_square"),
        of("type", unreached).alias("col_types"),
        of("unique", F.lit(0.0)).alias("col_uniqueness"),
        F.coalesce(F.col("numeric") / F.col("visited"), F.lit(0.0)).alias("numeric_density"),
        F.when(rows > 0, F.col("n_labels") / rows).otherwise(0.0).alias("col0_label_ratio"),
        F.when(rows > 0, F.col("n_indented") / rows).otherwise(0.0).alias("indent_ratio"),
        F.when(rows > 0, F.col("n_numbered") / rows).otherwise(0.0).alias("numbered_ratio"),
        F.size(F.filter("h0", is_temporal)).alias("temporal_headers"),
        F.transform(F.filter("h0", is_key_name), lambda h: F.array_position("h0", h).cast("int") - 1).alias("key_columns"),
        F.when((F.size("headers") > 0) & (rows >= 2) & (F.col("n_names") > 0), F.col("n_common") / either).otherwise(F.lit(0.0)).alias("header_overlap"),
    ).na.fill(0.0, ["header_overlap", "numeric_density"])


def _sum(*terms: Column) -> Column:
    """Terms added from the left, starting at 0.0, then clamped to [0, 1]."""
    total = F.lit(0.0)
    for t in terms:
        total = total + t
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def _if(cond: Column, score: float, other: Column | float = 0.0) -> Column:
    return F.when(cond, F.lit(score)).otherwise(F.lit(other) if isinstance(other, float) else other)


def _starts_with(values: list[str]) -> Column:
    """Whether any header row begins with one of the (lower-cased, stripped) values."""
    return F.exists("headers", lambda h: (F.size(h) > 0) & F.lower(strip(F.get(h, F.lit(0)))).isin(*values))


def rules() -> dict[str, Column]:
    """The score of each archetype over the columns of ``features``."""
    rows, cols, levels = F.col("num_rows"), F.col("num_cols"), F.col("header_levels")
    density, h0 = F.col("numeric_density"), F.get("headers", F.lit(0))
    corner = F.get(h0, F.lit(0))
    rest = F.slice("col_types", F.lit(2), F.greatest(F.size("col_types") - 1, F.lit(0)))
    temporal = F.col("temporal_headers") / cols
    guard = lambda ok, score: F.when(ok, score).otherwise(F.lit(0.0))
    some = (rows > 0) & (cols > 0)
    repeated = (F.size(h0) > 2) & (F.size(F.array_distinct(h0)) < F.size(h0))
    return {
        "key_value": guard(some, _sum(_if(cols == 2, 0.4, _if(cols == 3, 0.2)), F.col("col0_label_ratio") * 0.3, _if(levels <= 1, 0.1), _if(density < 0.8, 0.2))),
        "comparison": guard(
            (rows >= 2) & (cols >= 3),
            _sum(F.lit(0.3), F.when(F.coalesce(F.size(h0) > 1, F.lit(False)), _if(strip(corner) == "", 0.2, _if(F.length(corner) < 15, 0.1))).otherwise(0.0), _if((F.size("col_types") > 1) & (F.size(F.array_distinct(rest)) == 1), 0.4), _if(levels > 1, -0.3)),
        ),
        "time_series": guard((rows > 0) & (cols >= 2), _sum(_if(temporal > 0.5, 0.6, _if(temporal > 0.2, 0.3)), _if(density > 0.5, 0.2), _if(levels == 1, 0.2))),
        "hierarchical": guard(
            some,
            _sum(_if(levels > 1, 0.4), _if(_starts_with([""]), 0.2), _if(F.col("indent_ratio") > 0.3, 0.7, _if(F.col("indent_ratio") > 0.1, 0.5)), _if(F.col("numbered_ratio") > 0.5, 0.3), _if(levels >= 3, -0.3)),
        ),
        "matrix": guard((rows >= 2) & (cols >= 2), _sum(_if(F.col("is_square"), 0.4), _if(F.col("header_overlap") > 0.5, 0.3, _if(F.col("header_overlap") > 0.2, 0.1)), _if(density > 0.7, 0.3))),
        "relational": guard(some, _sum(_if(F.size("key_columns") > 0, 0.4), _if(F.exists("col_uniqueness", lambda u: u > 0.9), 0.3), _if(F.col("row_col_ratio") > 2.0, 0.3))),
        "pivot": guard((rows > 0) & (cols >= 3), _sum(_if(levels > 1, 0.3), _if(levels >= 3, 0.3), _if((levels > 1) & (cols >= 4), 0.2), _if(_starts_with(["", "from"]), 0.2), _if(density > 0.6, 0.2), _if(F.coalesce(repeated, F.lit(False)), 0.2))),
    }


Rule = Callable[[], Column]


def classify(ts: TableSet | DataFrame, extra: dict[str, Column] | None = None, only: dict[str, Column] | None = None) -> DataFrame:
    """table_id, table_type, confidence, secondary_types, scores. The best score wins, ties go to the rule named first; other
    types of at least SECONDARY are secondary, best first. Tables without rows and headers, or without any score, are unknown.
    ``extra`` adds rules (scores over the feature columns); ``only`` replaces them all."""
    wide = ts if isinstance(ts, DataFrame) else features(ts)
    scored = (only if only is not None else rules()) | (extra or {})
    empty = (F.col("num_rows") == 0) & (F.size("headers") == 0)
    ranked = F.array_sort(F.array(*[F.struct((-F.coalesce(c, F.lit(0.0))).alias("minus"), F.lit(i).alias("nth"), F.lit(name).alias("name")) for i, (name, c) in enumerate(scored.items())]))
    out = wide.withColumns({"_r": ranked, "_empty": empty})
    best = F.get("_r", F.lit(0))
    unknown = F.col("_empty") | (best["minus"] >= 0)
    secondary = F.filter(F.slice("_r", F.lit(2), F.size("_r")), lambda r: (r["minus"] <= -SECONDARY) & (r["minus"] < 0))
    return out.select(
        "table_id",
        F.when(unknown, "unknown").otherwise(best["name"]).alias("table_type"),
        F.when(F.col("_empty"), 0.0).otherwise(-best["minus"] + F.lit(0.0)).alias("confidence"),
        F.when(F.col("_empty"), F.array().cast("array<string>")).otherwise(F.transform(secondary, lambda r: r["name"])).alias("secondary_types"),
        F.when(~F.col("_empty"), F.map_from_entries(F.transform("_r", lambda r: F.struct(r["name"].alias("key"), (-r["minus"] + F.lit(0.0)).alias("value"))))).alias("scores"),
    )


__all__ = ["ARCHETYPES", "classify", "column_profile", "column_type", "features", "profile_of", "rules", "value_counts"]
