"""Connected components of a link table by alternating stars, without collecting links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import materialize

MAX_ROUNDS = 60
#: Nodes that a task holds at once.
MAX_HELD = 500_000


def local_forest(links: DataFrame) -> DataFrame:
    """Links u, v with the same components: each task hangs what its own links connect on the least node (u on v). Beyond MAX_HELD
    nodes it hands out what it has and begins anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def stars() -> pa.RecordBatch:
            pairs = np.array([(x, find(x)) for x in list(root)], np.int64).reshape(-1, 2)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            if len(root) > MAX_HELD:
                yield stars()
        if root:
            yield stars()

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """v, root of every node with a link to another; root is the least node of its component. ``links``: columns a, b.

    Each task first makes stars of the links that it reads. Each round then hangs every node's larger neighbours on its least neighbour,
    and its smaller ones after that; the links become stars in a number of rounds that grows with the logarithm of the component
    size at most. Each round's links are written to the shared folder. A hub meets its links in a join, which Spark may
    split; its minimum is pre-aggregated."""
    state_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = materialize(local_forest(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    seen = state_of(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct())
        state = state_of(now)
        if state == seen:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select(F.col("v"), F.col("v").alias("root")).distinct())
        now = materialize(local_forest(now))
        seen = state_of(now)
    raise RuntimeError("the components did not settle")
