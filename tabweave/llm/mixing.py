"""Mixing sources to target weights, in built-in expressions only.

A source's share p is its part of all tokens. Temperature mixing weighs it by ``p ** t`` over the sum. The exponent t is
found by bisection: with a target entropy, the t whose weights have it; with a repetition limit R, the smallest t at
which no source is repeated more than R times as often as another. A pass evaluates 255 interior exponents with one
aggregate over the table of shares, one row an exponent, so sources are never collected. A source is read ``weight * budget / tokens`` times. The
budget is a number of tokens; without one it is the smallest at which every source is read at least once, so that no document is
dropped. A smaller budget reads some sources in part.

The weights become a schedule: in each epoch the documents of a source are put in the order of an MD5 of seed, epoch and
id, cut into blocks of about ``block_docs`` documents by ranges of that value. All epochs but the last are whole; in
the last, whole blocks are taken while their running token sum stays in the source's quota, and in the block where it
runs out, documents while theirs does. ``slot`` is where a reading lies in its source's schedule, by tokens from 0 to 1: in the order
of slots all sources advance together, so any stretch of the schedule has about the target weights (``in_order``).

Running sums have two levels: over the blocks of a group of GROUP_BLOCKS, and over a source's groups. No window holds more than
the blocks of one group, the groups of one source or the documents of one block.

Cases: documents with a null source form a source of their own (null). Null and empty texts have no tokens; they are
read once per epoch and cost nothing. A source without any token has repetition 1. Equal ids (repeated rows) are ordered
by a digest of their text; fully equal rows are interchangeable. Null ids count as an empty id. Without a budget no document is
dropped: each is read in epoch 0. Texts are only counted, so very long ones need no room of their own. An empty table gives no
rows. Extra columns are ignored by ``mix`` and passed through by ``repeat_documents``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import fresh, join_small, materialize

MAX_REPEATS = 2.0
BLOCK_DOCS = 512
#: Blocks whose running sums one window makes.
GROUP_BLOCKS = 1024
SEED = 17
_PASSES = 6
_INNER = 255


def n_tokens(text):
    """Words as in the quality rules."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_shares(tokens: DataFrame) -> DataFrame:
    """source, docs, tokens of each source (one row per source)."""
    return materialize(tokens.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))


def _bisect(low: float, high: float, evaluate, below) -> float:
    """Narrow [low, high]: ``evaluate`` maps exponents to values in one pass; ``below(value)`` is true left of the answer."""
    for _ in range(_PASSES):
        at = [low + (high - low) * (i + 1) / (_INNER + 1) for i in range(_INNER)]
        left = [x for x, v in zip(at, evaluate(at), strict=True) if below(v)]
        low, high = (left[-1] if left else low), min([x for x in at if not left or x > left[-1]], default=high)
    return (low + high) / 2


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """The exponent in [0, 1] for a target entropy (in nats; it falls as the exponent grows) or a repetition limit."""
    with_any = shares.where("tokens > 0")
    total = with_any.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))

    def each(at: list[float], **found) -> list:
        """One row of aggregates for each exponent, in order; within a pass they are evenly spaced."""
        step = at[1] - at[0]
        t = F.lit(at[0]) + F.col("i") * F.lit(step)
        rows = with_any.select(p.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(len(at) - 1))).alias("i")).withColumn("t", t)
        return rows.groupBy("i").agg(*[x.alias(k) for k, x in found.items()]).orderBy("i").collect()

    def entropies(at: list[float]) -> list[float]:
        z, e = F.sum(F.pow("p", "t")), F.sum(F.pow("p", "t") * F.log("p") * F.col("t"))
        return [math.log(r["z"]) - r["e"] / r["z"] for r in each(at, z=z, e=e)]

    def spreads(at: list[float]) -> list[float]:
        reads = F.pow("p", F.col("t") - 1)
        return [r["spread"] for r in each(at, spread=F.max(reads) / F.min(reads))]

    if target_entropy is not None:
        return _bisect(0.0, 1.0, entropies, lambda h: h > target_entropy)
    return _bisect(0.0, 1.0, spreads, lambda r: r > max_repeats)


def weights(shares: DataFrame, t: float, budget: float | None = None) -> DataFrame:
    """source, docs, tokens, share, weight, repeats of each source. Without a ``budget`` (in tokens) repeats is at least 1."""
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return shares.withColumns({"share": F.lit(0.0), "weight": F.lit(0.0), "repeats": F.lit(1.0)})
    share = F.col("tokens") / F.lit(float(total))
    z, least = shares.where("tokens > 0").agg(F.sum(F.pow(share, F.lit(t))), F.min(F.pow(share, F.lit(t - 1)))).first()
    some = F.col("tokens") > 0
    reads = F.pow(share, F.lit(t - 1))
    reads = reads / F.lit(least) if budget is None else reads * F.lit(budget / z / total)
    return shares.withColumns(
        {
            "share": share,
            "weight": F.when(some, F.pow(share, F.lit(t)) / F.lit(z)).otherwise(0.0),
            # rounded, so that a source on the bound is read a whole number of times
            "repeats": F.when(some, F.round(reads, 6)).otherwise(1.0),
        }
    )


def schedule(tokens: DataFrame, sources: DataFrame, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per reading of a document: the columns of ``tokens`` (``_id``, ``_tie``, ``source``, ``tokens`` and others), epoch, block, position, slot."""
    plan = sources.select(
        F.struct("source").alias("_s"),
        F.col("weight"),
        F.col("repeats"),
        F.col("tokens").alias("_all"),
        F.floor("repeats").cast("int").alias("_whole"),
        F.floor((F.col("repeats") - F.floor("repeats")) * F.col("tokens")).cast("long").alias("_quota"),
        F.greatest(F.ceil(F.col("docs") / block_docs), F.lit(1)).cast("long").alias("_blocks"),
    )
    # a struct key, as null sources join too
    read = join_small(tokens.withColumn("_s", F.struct("source")), plan, "_s", "inner")
    read = read.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_whole")))).where((F.col("epoch") < F.col("_whole")) | (F.col("_quota") > 0))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("_id")).cast("binary"))
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    read = read.withColumns({"_order": order, "block": F.floor(place * F.col("_blocks") / F.lit(float(1 << 32))).cast("long")})
    # running token sums over the blocks of a source and epoch, in two levels, then inside a block
    part = F.col("epoch") == F.col("_whole")
    sums = read.groupBy("_s", "epoch", "block").agg(F.sum("tokens").alias("_sum")).withColumn("_g", F.floor(F.col("block") / GROUP_BLOCKS))
    preceding = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("_s", "epoch", "_g").agg(F.sum("_sum").alias("_gsum"))
    groups = groups.withColumn("_earlier", F.coalesce(F.sum("_gsum").over(preceding(Window.partitionBy("_s", "epoch").orderBy("_g"))), F.lit(0))).drop("_gsum")
    inner = F.coalesce(F.sum("_sum").over(preceding(Window.partitionBy("_s", "epoch", "_g").orderBy("block"))), F.lit(0))
    before = sums.withColumn("_inner", inner).join(groups, ["_s", "epoch", "_g"]).select("_s", "epoch", "block", (F.col("_earlier") + F.col("_inner")).alias("_before"))
    read = read.join(before, ["_s", "epoch", "block"])
    inside = Window.partitionBy("_s", "epoch", "block").orderBy("_order", "_tie")
    run = F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    read = read.withColumns({"position": F.row_number().over(inside).cast("long"), "_run": F.col("_before") + run})
    whole = F.col("_whole") * F.col("_all") + F.col("_quota")
    slot = F.when(whole > 0, (F.col("epoch") * F.col("_all") + F.col("_run") - F.col("tokens") / 2) / whole).otherwise(0.0)
    return read.where(~part | (F.col("_run") <= F.col("_quota"))).withColumn("slot", slot).drop("_s", "_all", "_whole", "_quota", "_blocks", "_order", "_before", "_run")


def in_order(plan: DataFrame) -> DataFrame:
    """The readings of a schedule in the order of their slots, all sources mixed."""
    return plan.orderBy("slot", "source", "epoch", "block", "position")


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
            F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")).alias("_tie"),
            F.col(source_col).alias("source"),
            n_tokens(F.col(text_col)).alias("tokens"),
        )
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, tokens, weight, repeats, epoch, block, position, slot of each reading."""
    counted = _counted(docs, id_col, text_col, source_col)
    shares = source_shares(counted)
    by_source = weights(shares, exponent(shares, target_entropy, max_repeats), budget)
    return schedule(counted, by_source, seed, block_docs).drop("_id", "_tie")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the schedule reads it (once at least). Equal rows share their readings evenly."""
    counted = _counted(docs, id_col, text_col, source_col)
    shares = source_shares(counted)
    plan = schedule(counted, weights(shares, exponent(shares, **options)))
    # names that no column of the documents has
    own = {k: fresh(f"_{k}", docs.columns) for k in ("id", "tie", "of", "reads", "copies", "nth", "each")}
    reads = plan.groupBy(F.col("_id").alias(own["id"]), F.col("_tie").alias(own["tie"]), F.struct(F.col("source")).alias(own["of"])).agg(F.count(F.lit(1)).alias(own["reads"]), F.count_if(F.col("epoch") == 0).alias(own["copies"]))
    key = docs.withColumns(
        {
            own["id"]: F.coalesce(F.col(id_col).cast("string"), F.lit("")),
            own["tie"]: F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")),
            own["of"]: F.struct(F.col(source_col).alias("source")),
        }
    )
    keys = [own["id"], own["tie"], own["of"]]
    joined = key.join(reads, keys)
    joined = joined.withColumn(own["nth"], F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    n, copies = F.col(own["reads"]), F.col(own["copies"])
    times = F.floor(n / copies) + F.when(F.col(own["nth"]) <= n % copies, 1).otherwise(0)
    return joined.withColumn(own["each"], F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*[f"`{c}`" for c in docs.columns])
