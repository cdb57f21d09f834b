"""Sharding by balanced label propagation, in built-in expressions only: documents are dealt to shards of equal row counts so that
linked documents lie together.

Links come from groups (equal texts; other columns may be given as well): the documents of a group are all linked with each
other. Their number by group and shard is all that a round needs, so pairs are never made.

1. Documents without a link are set aside. The linked ones start evenly dealt by the order of a hash.
2. In each round a document's scores are the numbers of its neighbours in each shard, from a join of its groups with
   their counts by shard. Its target is the best shard; ties go to a shard by a hash of its groups and
   the round, so that a group agrees. It asks
   to move if it has more neighbours there than where it is.
3. Quotas hold for every pair of shards: as many may go from i to j as go from j to i, and more while j has room below its capacity.
   Requests are taken by falling gain and then by a hash, in whole buckets, so no request list meets in one task. Rounds in which every
   shard may be asked for take turns with rounds in which only shards with much room may, so that groups go on from full shards.
   There, a group that fits into the room may leave a full shard even where no single document gains by it.
4. A round that doesn't lessen the cut links is taken back. No cut links, or IDLE rounds in a row of next to no gain, end the propagation.
5. Documents without links fill each shard up to its capacity by ranges of their hash order.

The law is ``rows``: the shards' row counts differ by one at most. ``slot`` numbers a shard's rows from 0 by a hash. Row
numbers come from counts by hash bucket and their running sums in two levels; a window holds the rows of one bucket, the buckets of
one block or the blocks of one shard.

A group that is larger than a shard fills one after another and is cut at their borders only. Where the documents of a
group exceed the room that linked documents leave, smaller groups may be cut too (the result is a local optimum).

Cases: null texts count as empty ones and are equal to them. Null and repeated ids are rows like any other; rows equal in id and
text are interchangeable, and where there are more than MANY of them, they are told apart by their place in the first
table written. Very long texts are read once, for their size and digests. Ties are broken by hashes. Fewer rows than shards leave
shards empty. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import join_small, materialize

SHARDS = 24
#: Rows of a bucket, buckets of a block.
BUCKET_ROWS, BLOCK_BUCKETS = 512, 1024
#: Rows equal in id and text that a bucket may hold together.
MANY = 512
#: Buckets of requests for each pair of shards and class of gains.
REQUEST_BUCKETS = 256
#: Rounds at most; every one of them lessens the cut links, so an end before is the rule.
MAX_ROUNDS = 64
#: Rounds in a row that end it, as they lessen the cut links by a smaller part than LEAST_GAIN each; ties differ between them.
IDLE, LEAST_GAIN = 2, 0.005


def _part(h: Column, parts: int) -> Column:
    """0 to parts - 1, in the order of the hash."""
    # an unsigned 32-bit number from the hash's high half
    return F.floor((F.shiftrightunsigned(h, 32)) * F.lit(parts) / F.lit(float(1 << 32))).cast("long")


def numbered(rows: DataFrame, name: str, within: str | None = None, parts: int = 1) -> DataFrame:
    """``name``: the row's number from 0 in the order of ``h`` (all rows, or within each value of ``within``, of which there are
    ``parts``). ``rows`` is a table that is read twice."""
    buckets = max(1, -(-rows.count() // (BUCKET_ROWS * parts)))
    keys = [within] if within else []
    keyed = rows.withColumn("_bucket", _part(F.col("h"), buckets))
    sums = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_many")).withColumn("_block", F.floor(F.col("_bucket") / BLOCK_BUCKETS))
    blocks = sums.groupBy(*keys, "_block").agg(F.sum("_many").alias("_all"))
    earlier = lambda c, order, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_first", earlier("_all", "_block", *keys)).drop("_all")
    sums = sums.withColumn("_inner", earlier("_many", "_bucket", *keys, "_block")).join(blocks, [*keys, "_block"])
    starts = sums.select(*keys, "_bucket", (F.col("_first") + F.col("_inner")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("h", "doc_id"))
    return keyed.withColumn("_place", place).join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_bucket", "_place", "_start")


def capacities(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def group_counts(linked: DataFrame, g: str, shards: int) -> DataFrame:
    """The group's key and ``n_<g>``: how many of its documents each shard has, as an array."""
    by = linked.where(F.col(g).isNotNull()).groupBy(g, "shard").agg(F.count(F.lit(1)).alias("n")).groupBy(g).agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("m"))
    return by.select(g, F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0).cast("long"))).alias(f"n_{g}"))


def cut_links(counts: dict[str, DataFrame]) -> int:
    """Linked pairs whose documents lie in different shards, from the groups' counts by shard."""
    total = 0
    for g, table in counts.items():
        n = F.transform(f"n_{g}", lambda x: x.cast("decimal(18,0)"))
        zero = F.lit(0).cast("decimal(38,0)")
        whole = F.aggregate(n, zero, lambda a, b: (a + b).cast("decimal(38,0)"))
        within = F.aggregate(n, zero, lambda a, b: (a + b * b).cast("decimal(38,0)"))
        total += int(table.agg(F.sum((whole.cast("decimal(18,0)") * whole.cast("decimal(18,0)") - within).cast("decimal(38,0)"))).first()[0] or 0) // 2
    return total


def requests(linked: DataFrame, counts: dict[str, DataFrame], room: list[int], may: list[int], turn: int = 0) -> DataFrame:
    """The linked documents with ``target`` (null if they stay) and ``gain``; targets are among the shards ``may``. ``counts`` are the groups'
    counts by shard. Ties change with ``turn``."""
    shards, groups = len(room), list(counts)
    scored, scores = linked, None
    for g in groups:
        scored = join_small(scored, counts[g], g)
        own = F.coalesce(F.col(f"n_{g}"), F.array_repeat(F.lit(0).cast("long"), shards))
        scores = own if scores is None else F.zip_with(scores, own, lambda a, b: a + b)
    scored = scored.withColumn("_scores", scores)
    allowed = F.array(*[F.lit(s) for s in may])
    # of equal scores the greatest hash of groups and shard is taken
    ranked = F.transform(allowed, lambda s: F.struct(F.element_at("_scores", s + 1).alias("n"), F.xxhash64(*groups, s, F.lit(turn)).alias("tie"), s.alias("shard")))
    scored = scored.withColumn("_best", F.array_max(ranked))
    # a document counts itself once for each of its groups where it is
    itself = sum((F.col(g).isNotNull().cast("long") for g in groups), F.lit(0).cast("long"))
    gain = F.col("_best.n") - (F.element_at("_scores", F.col("shard") + 1) - itself)
    # out of a full shard, a group that fits goes to the rest of its documents together, though each alone may gain nothing
    full = ~F.array_contains(allowed, F.col("shard"))
    total = F.aggregate("_scores", F.lit(0).cast("long"), lambda a, b: a + b)
    fits = full & (F.col("_best.n") > 0) & (total - F.col("_best.n") <= F.element_at(F.array(*[F.lit(r) for r in room]), F.col("_best.shard") + 1))
    gain = F.when(fits, F.greatest(gain, F.lit(1).cast("long"))).otherwise(gain)
    moves = (F.col("_best.shard") != F.col("shard")) & (gain > 0)
    return scored.withColumns({"target": F.when(moves, F.col("_best.shard")), "gain": F.when(moves, gain)}).drop("_scores", "_best", *[f"n_{g}" for g in groups])


def quotas(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may go from i to j: exchanges, and the target's room, for the larger requests first."""
    allowed = {(i, j): min(m, asked.get((j, i), 0)) for (i, j), m in asked.items()}
    left = list(room)
    for i, j in sorted(asked, key=lambda p: (-asked[p], p)):
        more = min(asked[i, j] - allowed[i, j], left[j])
        allowed[i, j] += more
        left[j] -= more
    return allowed


def loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, groups: list[str], caps: list[int], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The linked documents with their shards after the last round. ``linked`` is a table with ``shard``; ``caps`` are the shards' capacities."""
    spark, shards = linked.sparkSession, len(caps)
    counted = lambda rows: {g: materialize(group_counts(rows, g, shards)) for g in groups}
    counts = counted(linked)
    cut, idle = cut_links(counts), 0
    room = [c - n for c, n in zip(caps, loads(linked, shards), strict=True)]
    for turn in range(max_rounds):
        if not cut or idle == IDLE:
            break
        may = [s for s in range(shards) if turn % 2 == 0 or room[s] > caps[s] // 50]
        idle += 1
        if not may:
            continue
        # read twice, and cheaper to make again than to write
        wish = requests(linked, counts, room, may, turn // 2)
        bucket = F.struct(F.floor(-F.log2(F.col("gain").cast("double"))).alias("cls"), _part(F.xxhash64("h", F.lit(turn)), REQUEST_BUCKETS).alias("part"))
        asking = wish.where(F.col("target").isNotNull()).select("shard", "target", bucket.alias("bucket"))
        by = materialize(asking.groupBy("shard", "target", "bucket").agg(F.count(F.lit(1)).alias("n")))
        asked = {(r["shard"], r["target"]): r["n"] for r in by.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            continue
        allowed = spark.createDataFrame([(i, j, m) for (i, j), m in quotas(asked, room).items()], "shard int, target int, allowed long")
        run = F.sum("n").over(Window.partitionBy("shard", "target").orderBy("bucket"))
        # the last bucket taken, one row for each pair of shards at most
        taken = by.withColumn("run", run).join(F.broadcast(allowed), ["shard", "target"]).where("run <= allowed").groupBy("shard", "target").agg(F.max("bucket").alias("last"))
        moved = wish.join(F.broadcast(taken), ["shard", "target"], "left")
        goes = F.coalesce(bucket <= F.col("last"), F.lit(False))
        after = materialize(moved.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).select(*linked.columns))
        counts_after = counted(after)
        now = cut_links(counts_after)
        if now < cut:
            idle = 0 if now < cut * (1 - LEAST_GAIN) else idle
            linked, counts, cut = after, counts_after, now
            room = [c - n for c, n in zip(caps, loads(linked, shards), strict=True)]
    return linked


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", links: tuple[str, ...] = (), max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document. Documents with equal texts are linked, and those with
    an equal value (not null) in one of the columns ``links``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    groups = ["g0", *[f"g{i + 1}" for i in range(len(links))]]
    keys = [F.sha2(text, 256), *[F.col(f"`{c}`").cast("string") for c in links]]
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(F.col(f"`{text_col}`")).cast("long")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[k.alias(g) for k, g in zip(keys, groups, strict=True)])
    rows = materialize(read.withColumns({"size": F.coalesce("size", F.lit(0).cast("long")) + 8, "at": F.monotonically_increasing_id(), "h": F.xxhash64("doc_id", F.col("doc_id").isNull(), "g0")}))
    repeated = materialize(rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > MANY))
    told_apart = F.when(F.col("copies").isNotNull(), F.xxhash64("h", F.col("at") % F.ceil(F.col("copies") / MANY))).otherwise(F.col("h"))
    state = join_small(rows, repeated, "h").withColumn("h", told_apart).drop("at", "copies")
    # a group of one document links nothing
    for g in groups:
        several = materialize(rows.where(F.col(g).isNotNull()).groupBy(g).count().where("count > 1").select(g, F.lit(True).alias("several")))
        state = join_small(state, several, g).withColumn(g, F.when(F.col("several"), F.col(g))).drop("several")
    is_linked = F.col(groups[0]).isNotNull()
    for g in groups[1:]:
        is_linked = is_linked | F.col(g).isNotNull()
    state = materialize(state.withColumn("linked", is_linked))
    caps = capacities(state.count(), shards)
    linked = materialize(numbered(state.where("linked"), "k").withColumn("shard", (F.col("k") % shards).cast("int")).drop("k"))
    linked = propagate(linked, groups, caps, max_rounds)
    ends, filled = [], 0
    for room in (c - m for c, m in zip(caps, loads(linked, shards), strict=True)):
        filled += room
        ends.append(filled)
    # the shard in whose range the number lies: as many as have ended before it
    target = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("k")))
    others = numbered(state.where("NOT linked"), "k").withColumn("shard", target).drop("k")
    every = materialize(linked.unionByName(others))
    law = {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    return numbered(every, "slot", "shard", shards).withColumns(law).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
