"""Tables in the folder that driver and executors share, and dense row numbers that need no single task."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables made by ``hold``: session, path and the thread that made it.
_made: list[tuple[SparkSession, str, int]] = []


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per Spark context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tabweave_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tabweave-code-")) / "tabweave.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(path))
    sc._tabweave_sent = True


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode without it, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="tabweave-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(tables: list[tuple[SparkSession, str, int]]) -> None:
    """Delete tables, each on its own; those of an ended session go with the folder that the cluster names."""
    for one in tables:
        spark, path, _ = one
        with contextlib.suppress(Exception):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made.remove(one)


atexit.register(lambda: _remove(list(_made)))


@contextlib.contextmanager
def held_for_now() -> Iterator[None]:
    """Tables that this thread holds inside the block are deleted at its end; for jobs that write their results, over and over."""
    before = len(_made)
    try:
        yield
    finally:
        _remove([t for t in _made[before:] if t[2] == threading.get_ident()])


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder. What is written there goes when the driver's Python ends, or at the end of a block of ``held_for_now``."""
    path = f"{shared_dir(spark)}/tabweave-{uuid.uuid4().hex}"
    _made.append((spark, path, threading.get_ident()))
    return path


def hold(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that it is computed once and outlives executors. The table goes
    when the driver's Python ends, or at the end of a block of ``held_for_now``."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counted_up(held: DataFrame, name: str) -> DataFrame:
    """Rows of a held table with _part and _at, numbered by part and then by _at: numbers are counted in each part and moved on by the
    sizes of the parts before, one row per part, so no task sees more than its part."""
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).select("_part", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    return held.withColumn("_inside", inside).join(offsets, "_part").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_at", "_inside", "_before")


def number_as_they_come(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in the order that the DataFrame has when it is computed once: by partition, then as they come."""
    return _counted_up(hold(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})), name)


def number_rows(df: DataFrame, order: list[Column], name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in the given order; the sort is a range partitioning."""
    return number_as_they_come(df.orderBy(*order), name)
