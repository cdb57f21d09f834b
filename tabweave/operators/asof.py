"""As-of join: to every row of one table the last row of another at or before its time, by keys or without any.

Both tables are laid in one order by keys and time, cut into ranges by a sort. What the last matching row of a range is is carried over the
ranges that follow, one row a key and range, and within a range a running last value gives the rest. So neither a hot key nor a
join without keys is one task, and no pair is made that isn't in the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.plans.shared import hold


def as_of(left: DataFrame, right: DataFrame, at: str, since: str, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """The rows of ``left`` with a column ``found``, a struct of the columns of the last row of ``right`` (by ``since``, then by ``ties``) with
    equal ``by`` columns and ``since`` at or before ``at``; null if there is none.

    Rows of ``left`` with a null time or key find nothing and stay; such rows of ``right`` are never found. Repeated rows of ``left`` each
    stay. Equal times count as before. Empty tables are fine on either side."""
    by, ties = by or [], ties or []
    keys = [f"_k{i}" for i in range(len(by))]
    key = lambda: [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)]
    row = lambda df: F.struct(*[f"`{c}`" for c in df.columns])
    kind = right.select(row(right).alias("r")).schema["r"].dataType
    mine = left.select(*key(), F.col(f"`{at}`").alias("_t"), F.lit(1).alias("_side"), row(left).alias("_l"), F.lit(None).cast(kind).alias("_r"))
    whole = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, since]))
    theirs = whole.select(*key(), F.col(f"`{since}`").cast(mine.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(mine.schema["_l"].dataType).alias("_l"), row(right).alias("_r"))
    order = [*keys, "_t", "_side", *[F.col("_r")[c] for c in ties]]
    laid = hold(mine.unionByName(theirs).orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    ends = laid.where("_side = 0").groupBy(*keys, "_part").agg(F.max_by("_r", "_at").alias("_last"))
    # each key and range gets the last row of the ranges before it, if a range of the key has none of its own as well
    seen = laid.select(*keys, "_part").distinct().withColumn("_g", F.struct(*keys, "_part") if keys else F.struct("_part"))
    ends = ends.withColumn("_g", F.struct(*keys, "_part") if keys else F.struct("_part")).select("_g", "_last")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.join(ends, "_g", "left").withColumn("_up", F.last("_last", True).over(before)).where("_up is not null").select("_g", "_up")
    rows = laid.withColumn("_g", F.struct(*keys, "_part") if keys else F.struct("_part")).join(carried, "_g", "left")
    inside = Window.partitionBy("_g").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.coalesce(F.last("_r", True).over(inside), F.col("_up"))
    sound = F.col("_t").isNotNull()
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    return rows.withColumn("found", F.when(sound, found)).where("_side = 1").select("_l.*", "found")
