"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

A document's set holds its distinct ``width``-word shingles, as 64-bit hashes (of the whole word sequence if it is
shorter). Documents with equal sets form a class; only one member of a class is compared, so exact copies never pair.

Order. Shingles are ordered by an estimate of their frequency, then by hash. The estimate is a table of 2**SKETCH_BITS
counters filled by all documents and summed over the tasks; its size does not depend on the input.

Prefixes. If two sets link at threshold t, then of n shingles of either the first n - ceil(t n) + l share at least l with
the other's. A document's l is the one of LEVELS whose estimated cost is least: emitting the prefix, meeting the other
documents of its shingles, and the candidates among them; beyond that, the whole set is the prefix. So documents with
frequent shingles get longer prefixes and need more matches. For a pair the bound is exact on both sizes: it needs
alpha - max(n_a - p_a, n_b - p_b) shared prefix shingles, with alpha the least overlap that links sets of these sizes.

Shingles that one class alone has are dropped from the prefixes, and so are classes that are left with too few. What
remains are lists of classes by shingle. Links are then found in rounds, each on what has not been joined yet:

1. Proposals, in proportion to the lists: each class with the class that shares most, among the classes that stand out in its
   lists (the original of a group of near copies does), and with its neighbours by size. Proposals with enough matches are
   verified and give components. This is done ROUNDS times.
2. All other pairs of classes in different components, with enough matches: a class that is in c lists and needs at least t
   matches with anything of one size band in them looks into its c - t + 1 shortest lists. All pairs that pass are verified.

A large group of near copies thus takes a number of pairs in proportion to its size, and as step 2 leaves nothing out, the
components are exact. Verification compares whole sets.

Cases: null and empty texts, or without words, have an empty set, n_shingles 0 and link with nothing. Repeated rows are
copies. Rows with a null id are compared; a component's id is its least id (null if it has none). Equal ids with
different texts are different documents. Ids are whole numbers: they are cast to long, and ids that aren't fail or are lost. Very
long texts are hashed whole, a batch of texts at a time; a set is as long as its text has words. Ties cannot change the result:
proposals and prefixes break them by hashes, and the components are those of all links. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import materialize, spread, texts
from tabweave.llm.graph import components

WIDTH = 5
#: The least Jaccard similarity of a link, in percent.
PERCENT = 80
SKETCH_BITS = 21
SKETCH_BLOCK = 1 << 14
LEVELS = (4, 6, 8, 12, 16)
#: Lists of at least this estimated length are dealt over salts when single-document shingles are dropped.
HOT_LIST = 4096
SALTS = 32
ROUNDS = 1
#: The costs of a candidate, and of each shingle of a whole set in the prefix, in that of meeting a document in a list.
VERIFY = 4
WHOLE = 8
#: Sizes of one band differ by at most this factor.
BAND = 1.05
#: The least and the largest size of a filter of class ids, as powers of two; between them it has about FILTER_ROOM bits for an id.
FILTER_BITS = (24, 30)
FILTER_ROOM = 12
_FILTER_SHIFTS = (0, 17, 34)
_STEP = np.uint64(0x9E3779B97F4A7C15)


_BASE = 0x2545F4914F6CDD1B
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(48_611)
_VALUE_OF_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The start and the 64-bit hash of every word of a text: a polynomial of its bytes' random values, from prefix sums."""
    at = np.frombuffer(raw, np.uint8)
    up, down = _powers.upto(len(at))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE_OF_BYTE[at] * up, dtype=np.uint64)])
    edge = np.diff(np.concatenate([[True], _IS_BLANK[at], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, spread((sums[ends] - sums[starts]) * down[starts])


def shingles(part: list[str | None], width: int = WIDTH, most: int = 1 << 18) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are cut at the six ASCII blanks, and only A-Z are lowered. Texts are
    hashed together, in blocks of about ``most`` bytes; a longer text alone."""
    out: list[np.ndarray] = []
    raws = [t.encode().lower() if t else b"" for t in part]
    first = 0
    while first < len(raws):
        last, size = first, 0
        while last < len(raws) and (last == first or size + len(raws[last]) < most):
            size += len(raws[last]) + 1
            last += 1
        block = raws[first:last]
        starts, h = _word_hashes(b"\n".join(block))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in block]))
        windows = np.zeros(0, np.uint64)
        if len(h) >= width:
            windows = h[: len(h) - width + 1].copy()
            for k in range(1, width):
                windows = (windows ^ (windows >> np.uint64(31))) * _STEP + h[k : len(h) - width + 1 + k]
            windows = spread(windows)
        for raw, a, b in zip(block, bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(windows[a : b - width + 1]))
            elif b > a:
                out.append(np.array([xxhash.xxh3_64_intdigest(b"short\x00" + b" ".join(raw.split()))], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        first = last
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs; (0, 0) for the empty set."""
    if not len(s):
        return 0, 0
    raw = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def least_shared(n: np.ndarray | int, percent: int = PERCENT):
    """ceil(t n): the overlap that any link of a set of n shingles needs."""
    return -(-percent * n // 100)


def survey(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One pass: a row (kind 0) per document with its set's size and digest, and rows (kind 1) of each task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << SKETCH_BITS
        counts = np.zeros(size, np.int64)
        held: list[np.ndarray] = []
        n_held = 0
        names = ["kind", "_id", "n", "hi", "lo", "block", "counts"]

        def pour() -> None:
            nonlocal n_held
            if held:
                counts[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
                held.clear()
                n_held = 0

        for batch in batches:
            for first, part in texts(batch):
                sets = []
                for s in shingles(part, width):
                    held.append(s)
                    n_held += len(s)
                    if n_held > 1 << 19:
                        pour()
                    sets.append((len(s), *set_digest(s)))
                n, hi, lo = zip(*sets, strict=True)
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column(0).slice(first, k), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        pour()
        used = [i for i in range(size // SKETCH_BLOCK) if counts[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK].any()]
        for i in used:
            block = np.minimum(counts[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK], 0x7FFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.int64()) for _ in range(3)], pa.array([i], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=names)

    return docs.mapInArrow(run, "kind int, _id long, n long, hi long, lo long, block int, counts binary")


def sketch(surveyed: DataFrame) -> np.ndarray:
    """The counters of all tasks together; the sum of a block is made in the executors and only it comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(block, np.zeros(SKETCH_BLOCK, np.int64))
                sums[block] += np.frombuffer(raw.as_buffer(), np.int32)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(total, 0x7FFFFFFF).astype(np.int32).tobytes()], pa.binary())], names=["block", "counts"])

    parts = surveyed.where("kind = 1").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for r in parts.toLocalIterator():
        out[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["counts"], np.int32)
    return out


def choose_level(n: int, df: np.ndarray, percent: int = PERCENT) -> int:
    """The l with the least estimated cost for a set whose ordered shingles have ``df`` estimated other documents: emitting the prefix,
    meeting the documents of its lists, and the candidates among them. A whole set in the prefix looks for other whole sets only, and
    only if hardly any of its shingles is missing from all of them, so its cost does not depend on its lists."""
    base = n - int(least_shared(n, percent))
    levels = [x for x in LEVELS if base + x < n]
    if not levels:
        return n - base
    l, p = np.array(levels), base + np.array(levels)
    cost = p + np.cumsum(df[: p[-1]])[p - 1] * (1 + VERIFY / l)
    best = int(cost.argmin())
    return n - base if cost[best] > WHOLE * n else levels[best]


def postings(docs: DataFrame, counts: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """cid, np (n and p in one long), tokens, hot of every document with a set: its prefix's shingles and how many of them, at the
    end, are in long lists."""
    background = float(np.median(counts))
    code = np.minimum(255, np.round(8 * np.log2(counts.astype(np.float32) + 1))).astype(np.uint8)
    table = docs.sparkSession.sparkContext.broadcast((code, background))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, background = table.value
        likely = np.maximum(0.0, 2.0 ** (np.arange(256) / 8) - 1 - background - 3 * np.sqrt(background + 1))
        for batch in batches:
            for _, part in texts(batch):
                rows = []
                for s in shingles(part, width):
                    n = len(s)
                    if not n:
                        continue
                    rank = code[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.argsort((rank.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)))
                    df = likely[rank[order]]
                    p = min(n, n - int(least_shared(n, percent)) + choose_level(n, df, percent))
                    rows.append((set_digest(s)[1], n << 32 | p, int((df[:p] >= HOT_LIST).sum()), s[order[:p]].view(np.int64)))
                if rows:
                    cid, sizes, hot, tokens = zip(*rows, strict=True)
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in tokens])])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens)))
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hot, pa.int32()), lists], names=["cid", "np", "hot", "tokens"])

    return docs.select("_text").mapInArrow(run, "cid long, np long, hot int, tokens array<long>")


def needed(n_a: Column, p_a: Column, n_b: Column, p_b: Column, percent: int = PERCENT) -> Column:
    """The shared prefix shingles that a link of these sizes must have."""
    alpha = F.ceil((n_a + n_b) * percent / (100 + percent) - F.lit(1e-6))
    return F.greatest(alpha - F.greatest(n_a - p_a, n_b - p_b), F.lit(1))


def close_sizes(n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    return (F.least(n_a, n_b) * 100) >= F.greatest(n_a, n_b) * percent


def shared_lists(packed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """token, cid, n, p, k, score, salt of the prefix shingles that several classes have. k: classes in the list; score: the sum of a
    class's k, high for the middle of a group. Long lists (known from the sketch) need no count and are dealt over salts. Classes with
    fewer shared shingles than any link of their size needs are left out."""
    at = packed.select("cid", "np", F.posexplode("tokens").alias("at", "token"), (F.size("tokens") - F.col("hot")).alias("plain"))
    flat = at.select("cid", "np", "token", F.when(F.col("at") < F.col("plain"), 0).otherwise(1 + F.pmod("cid", F.lit(SALTS))).cast("int").alias("salt"))
    counted = flat.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("token", "salt"))).where("salt > 0 or k > 1")
    both = counted.select("token", "cid", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(0xFFFFFFFF).alias("p"), F.when(F.col("salt") > 0, HOT_LIST).otherwise(F.col("k")).cast("long").alias("k"), "salt")
    of = Window.partitionBy("cid")
    least = F.least(F.lit(LEVELS[0]), F.ceil(F.col("n") * (percent / 100) ** 2 - F.lit(1e-6)))
    scored = both.withColumns({"score": F.sum("k").over(of), "c": F.count(F.lit(1)).over(of)})
    return materialize(scored.where(F.col("c") >= least).drop("c"))


def _filter_bits(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table that holds three places of every class id, and its size as a power of two: by the number of ids, 128 MB at most."""
    bits = min(max((FILTER_ROOM * ids.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    mask = F.lit((1 << bits) - 1)
    places = F.explode(F.array(*[F.shiftrightunsigned("cid", k).bitwiseAND(mask) for k in _FILTER_SHIFTS]))
    words = ids.select(places.alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    table = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table["w"].to_numpy()] = table["bits"].to_numpy()
    return out, bits


def sets_of(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """cid, s: the whole sets of the classes in ``ids`` (cid). They are built again from the texts of documents whose class passes a
    bit filter of the ids; what passes wrongly is joined away."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size = bits.value
        mask = (1 << size) - 1
        for batch in batches:
            for _, part in texts(batch):
                cids, sets = [], []
                for s in shingles(part, width):
                    if not len(s):
                        continue
                    cid = set_digest(s)[1]
                    u = cid & 0xFFFFFFFFFFFFFFFF
                    if all(int(table[at >> 6]) >> (at & 63) & 1 for at in ((u >> k) & mask for k in _FILTER_SHIFTS)):
                        cids.append(cid)
                        sets.append(s.view(np.int64))
                if cids:
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                    yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["cid", "s"])

    found = docs.select("_text").mapInArrow(run, "cid long, s array<long>").dropDuplicates(["cid"])
    return materialize(found.join(ids, "cid", "left_semi"))


def verify(docs: DataFrame, pairs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b of class ids) whose whole sets link."""
    sets = sets_of(docs, pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct(), width)
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def with_roots(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The lists with each class's component and its size, without lists of one component only."""
    if roots is None:
        return lists.withColumns({"root": F.col("cid"), "size": F.lit(1).cast("long")})
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    known = roots.join(sizes, "root").select(F.col("v").alias("cid"), "root", "size")
    own = lists.join(known, "cid", "left").withColumns({"root": F.coalesce("root", "cid"), "size": F.coalesce("size", F.lit(1))})
    mixed = own.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    return own.join(mixed, "token", "left_semi")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """v, root after more links (a, b): only the components that they touch are joined anew."""
    if roots is None:
        return components(links)
    if links.isEmpty():
        return roots
    end = lambda x: roots.select(F.col("v").alias(x), F.col("root").alias(f"r{x}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(between)
    old = roots.join(moved.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return materialize(old.unionByName(moved.join(roots.select("v"), "v", "left_anti").select("v", "root")))


def proposals(own: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Promising pairs (a, b) of classes in different components, a few for each class, that have enough matches."""
    standing = own.groupBy("token").agg(F.max_by(F.struct("cid", "n", "root"), F.struct("size", "score", "cid")).alias("x"))
    star = own.join(standing, "token").where((F.col("root") != F.col("x.root")) & close_sizes(F.col("n"), F.col("x.n"), percent)).select("cid", F.col("x.cid").alias("other"))
    w = Window.partitionBy("token", "salt").orderBy("n", "cid")
    near = own.select("cid", "n", "root", *[F.lead(c).over(w).alias(f"{c}2") for c in ("cid", "n", "root")]).where("cid2 is not null and root <> root2").where(close_sizes(F.col("n"), F.col("n2"), percent)).select("cid", F.col("cid2").alias("other"))

    def best(pairs: DataFrame, k: int) -> DataFrame:
        counted = pairs.groupBy("cid", "other").agg(F.count(F.lit(1)).alias("c"))
        return counted.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("c"), "other"))).where(F.col("nth") <= k).select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b"))

    return with_matches(own, best(star, 2).unionByName(best(near, 1)).distinct(), percent)


def with_matches(own: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that share enough of their lists."""
    held = own.groupBy("cid").agg(F.collect_list("token").alias("t"), F.first("n").alias("n"), F.first("p").alias("p"))
    of = lambda x: held.select(*[F.col(c).alias(d) for c, d in (("cid", x), ("t", f"t{x}"), ("n", f"n{x}"), ("p", f"p{x}"))])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(F.size(F.array_intersect("ta", "tb")) >= needed(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)).select("a", "b")


def all_between(own: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs (a, b) of classes in different components with enough matches.

    Only lists of several components count. Classes are ordered by whether their whole set is in the prefix, and by their
    component's size and id; of two classes the lesser one looks for the other. It looks for each size band on its own: with classes of
    a band in c of its lists, and at least t matches needed with any of them (from the least size and the largest remainder n - p of
    the band in these lists), it finds them all in the c - t + 1 shortest of these lists, and nothing if c < t. What is found has its
    matches counted over both whole prefixes."""
    own = own.withColumn("o", F.struct((F.col("n") == F.col("p")).cast("int").alias("full"), "size", "root"))
    own = own.withColumn("band", F.floor(F.log(F.col("n")) / float(np.log(BAND))).cast("int"))
    whole = F.col("o.full") == 1
    rest = F.col("n") - F.col("p")
    bands = own.groupBy("token", "band").agg(F.count(F.lit(1)).alias("len"), F.struct(F.min("n").alias("least"), F.max(rest).alias("rest")).alias("any"), F.struct(F.min(F.when(whole, F.col("n"))).alias("least"), F.lit(0).alias("rest")).alias("full"), F.max("o").alias("g"))
    known = bands.groupBy("token").agg(F.sum("len").alias("len"), F.max("g").alias("g"), F.map_from_entries(F.collect_list(F.struct("band", F.struct("any", "full")))).alias("bands"))
    reach = int(np.ceil(np.log(100 / percent) / np.log(BAND)))
    least = F.ceil(F.col("n") * (percent / 100) - F.lit(1e-6))

    def bound(j: Column) -> Column:
        """A band that is j away and the least matches needed with a class of it; null matches if the list has none."""
        of = F.try_element_at("bands", F.col("band") + j)
        n, r = (F.when(whole, of["full"][k]).otherwise(of["any"][k]) for k in ("least", "rest"))
        t = F.ceil((F.col("n") + F.greatest(n, least)) * percent / (100 + percent) - F.lit(1e-6)) - F.greatest(rest, r)
        return F.struct((F.col("band") + j).alias("band"), F.when(n.isNotNull(), F.greatest(t, F.lit(1))).alias("t"))

    bounds = F.filter(F.transform(F.array(*[F.lit(j) for j in range(-reach, reach + 1)]), bound), lambda x: x["t"].isNotNull())
    looking = own.join(known, "token").where("o < g").select("token", "cid", "n", "o", "len", F.explode(bounds).alias("x"))
    of = Window.partitionBy("cid", "x.band")
    measured = looking.withColumns({"c": F.count(F.lit(1)).over(of), "t": F.min("x.t").over(of), "nth": F.row_number().over(of.orderBy("len", "token"))})
    look = measured.where("nth <= c - t + 1").select("token", F.col("x.band").alias("band"), F.col("cid").alias("c1"), F.col("n").alias("n1"), F.col("o").alias("o1"))
    seen = own.select("token", "band", F.col("cid").alias("c2"), F.col("n").alias("n2"), F.col("o").alias("o2"))
    found = (F.col("o1") < F.col("o2")) & (F.col("o1.root") != F.col("o2.root")) & close_sizes(F.col("n1"), F.col("n2"), percent)
    pairs = look.join(seen, ["token", "band"]).where(found).select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct()
    return with_matches(own, pairs, percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    surveyed = materialize(survey(rows, width))
    counts = sketch(surveyed)
    members = surveyed.where("kind = 0").select("_id", "n", "hi", "lo")
    lists = shared_lists(postings(rows, counts, width, percent).dropDuplicates(["cid"]), percent)
    roots = None
    for step in [proposals] * ROUNDS + [all_between]:
        # what is left between components is a small part of the lists; held, it is made once and the plans on it stay small
        own = with_roots(lists, roots) if roots is None else materialize(with_roots(lists, roots))
        pairs = materialize(step(own, percent))
        if not pairs.isEmpty():
            roots = merged(roots, materialize(verify(rows, pairs, width, percent)))
    if roots is None:
        roots = rows.sparkSession.createDataFrame([], "v long, root long")
    classes = members.where("n > 0").groupBy("hi", "lo").agg(F.min("_id").alias("least"))
    named = classes.join(roots.select(F.col("v").alias("lo"), "root"), "lo", "left").withColumn("root", F.coalesce("root", "lo"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = materialize(named.join(ids, "root").select("hi", "lo", "component_id"))
    joined = members.join(by_class, ["hi", "lo"], "left")
    return joined.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
