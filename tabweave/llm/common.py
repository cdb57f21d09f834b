"""Helpers shared by the corpus operators: reading, shared-folder tables, word bytes, small joins."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast whole; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000

_made: list[tuple[SparkSession, str]] = []
atexit.register(lambda: _remove_made())


#: Rows of an Arrow batch. Texts are read whole, so a batch of Spark's default size could hold hundreds of MB.
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold BATCH_ROWS rows at most, unless the session has its own setting."""
    if spark.conf.get(_BATCH_CONF) == "10000":
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="tabweave-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_made() -> None:
    """Delete the tables made, each on its own; those of an ended session go with the folder that the cluster names."""
    for spark, path in _made:
        _delete(spark, path)


@contextlib.contextmanager
def made_for_now():
    """Tables that are materialized inside the block are deleted at its end, for long sessions that write their results there."""
    before = len(_made)
    try:
        yield
    finally:
        for spark, path in _made[before:]:
            _delete(spark, path)
        del _made[before:]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: it is computed once, its lineage is cut, and a
    lost executor takes nothing with it. The tables go when the driver's Python ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tabweave-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % mod


def join_small(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a large table to a summary with one row per key. The summary's rows are counted: up to BROADCAST_ROWS it is
    broadcast; beyond, each of its rows is repeated for 16 salts, so that a hot key is dealt over 16 tasks. A row's salt is a hash
    of the row, so a task that is run again deals it as before."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    salt = fresh("_salt", left.columns, right.columns)
    salted = right.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(16)])))
    row = [f"`{c}`" for c, t in left.dtypes if "map<" not in t and "variant" not in t]
    return left.withColumn(salt, F.pmod(F.xxhash64(*row), F.lit(16)).cast("int")).join(salted, [key, salt], how).drop(salt)


def fresh(name: str, *taken: list[str]) -> str:
    """A column name made from ``name`` that none of the lists has, in any case."""
    used = {c.lower() for names in taken for c in names}
    while name.lower() in used:
        name += "_"
    return name


def texts(batch: pa.RecordBatch, at: int = -1, step: int = 512):
    """The strings of a column (the last one, unless told), ``step`` rows at a time: (first row, list)."""
    column = batch.column(at % batch.num_columns)
    for i in range(0, len(column), step):
        yield i, column.slice(i, step).to_pylist()


def without(names: list[str], made: tuple[str, ...]) -> list[str]:
    """Columns to carry along: those that an operator makes itself replace any of the same name."""
    return [x for x in names if x not in made]


def spread(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
