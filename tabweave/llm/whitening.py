"""Embedding whitening: principal components of quantised vectors, scaled to unit variance.

An entry ``c`` becomes the whole number ``x = floor(1024 c) + 100000``. Two aggregations over all vectors fit the model:

1. the number of vectors ``n`` and each dimension's sum ``S``, least and greatest value;
2. generated Spark SQL expressions, in one aggregation, that sum ``(x_i - m_i) (x_j - m_j)`` for every pair of dimensions
   i <= j, where ``m`` is the whole number nearest to the mean: each vector is one row for each i, the key, and there is an
   expression for each j. (An expression of its own for each of the 2,080 pairs of 64 dimensions takes 12 s for 51,282
   vectors against 1.4 s, as Spark can't compile so many together.) Products are made of centred whole numbers, so nothing
   cancels, and their sums are exact doubles (below 2^53) whatever the order of rows. What the mean differs from ``m`` (a half at
   most) is taken off the d by d table afterwards.

The covariance (divisor n) is decomposed by LAPACK on the driver; its size depends on the dimensions only. Tasks project whole
Arrow batches. The error against the identity is
measured on the whitened rows themselves.

Cases: vectors that are null or hold null or non-finite entries are dropped, as are those with an entry whose ``x`` isn't exact in
a double (beyond 2^53). A table's dimension is the length that most of the others have (of equally many the longest); vectors of
another length are dropped. A component without variance (equal vectors, fewer vectors than dimensions) has whitened 0
and explained 0, and isn't counted in the identity error. ``deviation`` is null where the exact sum doesn't fit a long. Of
equal eigenvalues any basis may be taken; signs are fixed by the largest entry. Null and repeated ids are kept, a row each. An
empty table, or one of empty vectors, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import materialize

FACTOR, SHIFT = 1024, 100_000
COMPONENTS = 8
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Model:
    """Vectors ``n``, sums by dimension, whole centres, the mean's rest, unit eigenvectors as rows, eigenvalues in falling order, the
    trace, and whether every deviation fits a long."""

    n: int
    sums: tuple[int, ...]
    centre: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    fits: bool

    @property
    def scale(self) -> np.ndarray:
        """One over the root of each eigenvalue; 0 for a component without variance."""
        some = self.values > max(self.trace, 0.0) * 1e-12
        return np.where(some, 1 / np.sqrt(np.where(some, self.values, 1.0)), 0.0)


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x (array of whole numbers, as doubles) of the vectors that are kept but for their length."""
    vec = F.transform(F.col(f"`{vec_col}`"), lambda c: F.floor(c.cast("double") * FACTOR).cast("double") + SHIFT)
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _EXACT))
    # whole doubles, as a cast of infinity to a long is an error
    exact = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double") * FACTOR)
    ok = F.forall(exact, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _EXACT))
    return rows.where(F.col(f"`{vec_col}`").isNotNull()).where(F.coalesce(ok, F.lit(False))).select(F.col(f"`{id_col}`").alias("vec_id"), vec.alias("x")).where(sound)


def triangle(k: DataFrame) -> np.ndarray:
    """The d by d table of sums of products of the d columns, in one aggregation over the rows of the upper triangle."""
    d = len(k.columns)
    rows = k.select(F.array(*k.columns).alias("k")).select("k", F.posexplode("k").alias("i", "own"))
    sums = [F.expr(f"sum(case when i <= {j} then own * k[{j}] end)") for j in range(d)]
    out = np.zeros((d, d))
    for r in rows.groupBy("i").agg(F.array(*sums).alias("s")).collect():
        out[r.i, r.i :] = out[r.i :, r.i] = r.s[r.i :]
    return out


def fit(x: DataFrame) -> Model | None:
    """The model of all vectors of the most frequent length; None without any entry."""
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or lengths["d"] == 0:
        return None
    d, n = lengths["d"], lengths["count"]
    wide = x.where(F.size("x") == d).select(*[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    exact = [F.sum(F.col(f"x{i}").cast("decimal(17,0)")) for i in range(d)]
    first = wide.agg(*exact, *[F.min(f"x{i}") for i in range(d)], *[F.max(f"x{i}") for i in range(d)]).first()
    sums = tuple(int(s) for s in first[:d])
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - n * m) / n for s, m in zip(sums, centre, strict=True)])
    table = triangle(wide.select(*[(F.col(f"x{i}") - F.lit(float(m))).alias(f"k{i}") for i, m in enumerate(centre)]))
    covariance = table / n - np.outer(rest, rest)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors.T[::-1]
    vectors = vectors * np.sign(vectors[np.arange(d), np.abs(vectors).argmax(1)])[:, None]
    most = sum(max(abs(n * int(lo) - s), abs(n * int(hi) - s)) ** 2 for s, lo, hi in zip(sums, first[d : 2 * d], first[2 * d :], strict=True))
    return Model(n, sums, np.array(centre, float), rest, vectors, values, float(np.trace(covariance)), most <= _LONG)


def project(x: DataFrame, model: Model, components: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation and whitened (array, one entry a component) of every vector of the model's length."""
    d, many = len(model.sums), min(components, len(model.sums))
    basis = (model.vectors[:many] * model.scale[:many, None]).T
    schema = x.select("vec_id").withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.array(F.lit(0.0))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            if model.fits:
                apart = model.n * found.astype(np.int64) - np.array(model.sums, np.int64)
                deviation = (apart * apart).sum(1)
            else:
                apart = [[model.n * int(v) - s for v, s in zip(row, model.sums, strict=True)] for row in found.tolist()]
                deviation = [t if (t := sum(v * v for v in row)) <= _LONG else None for row in apart]
            white = ((found - model.centre) - model.rest) @ basis
            offsets = pa.array(np.arange(0, len(white) * many + 1, many, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names=["vec_id", "deviation", "whitened"])

    return x.where(F.size("x") == d).mapInArrow(run, schema)


def identity_error(white: DataFrame, live: list[int]) -> float:
    """The largest absolute entry of the covariance of the whitened components ``live`` minus the identity, over the rows as they are."""
    if not live:
        return 0.0
    means = white.agg(*[F.avg(F.col("whitened")[c]) for c in live]).first()
    apart = white.select(*[(F.col("whitened")[c] - F.lit(m)).alias(f"w{c}") for c, m in zip(live, means, strict=True)])
    pairs = [(a, b) for a in live for b in live if a <= b]
    found = apart.agg(*[F.expr(f"avg(w{a} * w{b})") for a, b in pairs]).first()
    return float(max(abs(v - (a == b)) for (a, b), v in zip(pairs, found, strict=True)))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each kept vector and component."""
    x = materialize(whole_numbers(rows, id_col, vec_col))
    model = fit(x)
    if model is None:
        empty = x.select("vec_id").limit(0)
        return empty.withColumns({"component": F.lit(0), "n": F.lit(0).cast("long"), "deviation": F.lit(0).cast("long"), "whitened": F.lit(0.0), "explained": F.lit(0.0), "identity_error": F.lit(0.0)})
    white = materialize(project(x, model, components))
    many = min(components, len(model.sums))
    error = identity_error(white, [c for c in range(many) if model.scale[c] > 0])
    explained = F.array(*[F.lit(float(e / model.trace) if s > 0 else 0.0) for e, s in zip(model.values[:many], model.scale, strict=False)])
    long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
