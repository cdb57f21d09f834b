"""Sharding, source divergence and whitening against plain versions, and their odd inputs."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.llm import divergence, sharding, whitening
from tests.llm.test_corpus import documents, empty, odd

# Sharding


def copies(seed, rows, repeats):
    rnd = random.Random(seed)
    out = [f"text {i}" for i in range(rows)]
    for i, n in enumerate(repeats):
        out += [f"copied {i}"] * n
    rnd.shuffle(out)
    return [(i, t, None, None) for i, t in enumerate(out)]


def sharded(docs, shards=sharding.SHARDS, **options):
    rows = sharding.shard(docs, shards, **options).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}
    return rows


def spans(rows, key):
    at = collections.defaultdict(set)
    for r in rows:
        at[key(r)].add(r.shard)
    return {k: len(v) for k, v in at.items()}


def test_shards_are_even_and_groups_stay_together(spark):
    data = copies(1, 300, [2] * 30 + [3] * 20 + [7] * 5)
    rows = sharded(documents(spark, data))
    text = {i: t for i, t, *_ in data}
    assert set(spans(rows, lambda r: text[r.doc_id]).values()) == {1}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    again = {r.doc_id: (r.shard, r.slot) for r in sharded(documents(spark, data[::-1]).repartition(7))}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_a_group_larger_than_shards_fills_them(spark):
    data = copies(2, 120, [100, 2, 2, 2, 3])
    rows = sharded(documents(spark, data), 6)
    by = spans(rows, lambda r: data[r.doc_id][1])
    assert by.pop("copied 0") <= 4 and set(by.values()) == {1}


def test_only_linked_documents(spark):
    # no room at all: documents can only be exchanged
    data = copies(3, 0, [2] * 48)
    rows = sharded(documents(spark, data), 8)
    assert sum(n == 1 for n in spans(rows, lambda r: data[r.doc_id][1]).values()) >= 30


def test_links_of_several_kinds(spark):
    data = [(i, f"t{i // 2}", None, f"s{i % 10}" if i % 3 else None) for i in range(60)]
    rows = sharded(documents(spark, data), 5, links=("source",))
    at = {r.doc_id: r.shard for r in rows}
    linked = [(a, b) for a, b in itertools.combinations(range(60), 2) if data[a][1] == data[b][1] or data[a][3] and data[a][3] == data[b][3]]
    assert sum(at[a] != at[b] for a, b in linked) < 0.5 * len(linked)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_requests_and_cut_links_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y", None]), rnd.randrange(4)) for i in range(40)]
    linked = spark.createDataFrame(rows, "doc_id long, g0 string, g1 string, shard int").withColumn("h", F.xxhash64("doc_id"))
    groups, room, may = ["g0", "g1"], [3, 0, 2, 9], [0, 2, 3]
    tie = {(r.g0, r.g1, r.s): r.t for r in linked.select("g0", "g1", F.explode(F.array(*map(F.lit, range(4)))).alias("s")).select("*", F.xxhash64("g0", "g1", "s", F.lit(7)).alias("t")).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(rows, 2)]
    counts = {g: sharding.group_counts(linked, g, 4) for g in groups}
    assert sharding.cut_links(counts) == sum((a[1] is not None and a[1] == b[1]) + (a[2] is not None and a[2] == b[2]) for a, b in pairs if a[3] != b[3])
    for r in sharding.requests(linked, counts, room, may, 7).collect():
        scores = [sum(((o[1] is not None) & (o[1] == r.g0)) + ((o[2] is not None) & (o[2] == r.g1)) for o in rows if o[3] == s) for s in range(4)]
        best = max(may, key=lambda s: (scores[s], tie[r.g0, r.g1, s]))
        gain = scores[best] - (scores[r.shard] - (r.g0 is not None) - (r.g1 is not None))
        if r.shard not in may and scores[best] > 0 and sum(scores) - scores[best] <= room[best]:
            gain = max(gain, 1)
        assert (r.target, r.gain) == ((best, gain) if best != r.shard and gain > 0 else (None, None))


def test_quotas():
    asked = {(0, 1): 5, (1, 0): 3, (2, 1): 4}
    allowed = sharding.quotas(asked, [0, 3, 0])
    assert allowed == {(0, 1): 5, (1, 0): 3, (2, 1): 1}
    for s in range(3):
        assert sum(n for (i, j), n in allowed.items() if j == s) - sum(n for (i, j), n in allowed.items() if i == s) <= [0, 3, 0][s]


@pytest.mark.parametrize("parts", [None, 3])
def test_numbers_have_no_gaps(spark, monkeypatch, parts):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    monkeypatch.setattr(sharding, "BLOCK_BUCKETS", 3)
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 3).alias("shard"))
    got = collections.defaultdict(list)
    for r in sharding.numbered(rows, "k", "shard" if parts else None, parts or 1).collect():
        got[r.shard if parts else 0].append(r)
    for v in got.values():
        assert sorted(r.k for r in v) == list(range(len(v)))


def test_shards_of_odd_rows(spark):
    rows = sharded(odd(spark))
    assert len(rows) == 10 and {r.size for r in rows if r.doc_id == 2} == {8} and sum(r.doc_id is None for r in rows) == 2
    assert sharding.shard(empty(spark)).count() == 0
    many = documents(spark, [(1, "same", None, None)] * 2000)
    assert len(sharded(many)) == 2000


def test_tables_made_for_now_go(spark):
    from pathlib import Path

    from tabweave.llm.common import made_for_now, materialize, shared_dir

    kept = materialize(spark.range(3))
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    with made_for_now():
        assert materialize(spark.range(4)).count() == 4 and set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before and kept.count() == 3


# Source divergence


def brute_audit(rows, min_docs, top):
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", find.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for _, t, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        v = len(kept)
        count = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if t in set(kept)) for s in {d[1] for d in mine}}
        whole = sum(count.values(), collections.Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = sorted(((-sum(f(p(c, t), p(o, t)) for t in kept), k.encode(), k) for k, o in count.items() if k != s))
            terms = sorted(((-f(p(c, t), p(whole, t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(whole, t)))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_equals_brute_force(spark, monkeypatch, seed):
    for k, n in (("BLOCK_ROWS", 7), ("FOLD_ROWS", 5)):
        monkeypatch.setattr(divergence, k, n)
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x", "γάμμα", "don't", "b2b", "😀", "né"]
    rows = [(i, " ".join(rnd.choices(words, range(10, 0, -1), k=rnd.randrange(12))), rnd.choice(["en", "fr", None]), rnd.choice(["s1", "S2", "ß", None, ""])) for i in range(60)]
    rows += [(90, None, "en", "void"), (91, "--- 123", "de", "a"), (92, "", "de", "b")]
    got = divergence.audit(documents(spark, rows), min_docs=3, top_terms=4).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_audit(rows, 3, 4)


def test_counts_handed_out_early(spark):
    rows = [(i, f"a b{'bcd'[i % 3]} Éa", "en", f"s{i % 2}") for i in range(40)]
    few, many = (sorted(map(tuple, divergence.term_counts(documents(spark, rows), held=n).collect()), key=repr) for n in (0, 10**6))
    assert few == many


def test_very_large_counts(spark):
    one = spark.createDataFrame([(3 * 10**12, 7 * 10**13, 5)], "c long, n long, v long")
    got = one.select(F.expr(divergence._p("c", "n", "v"))).first()[0]
    assert got == 1 + 10**9 * (3 * 10**12 + 2) // (7 * 10**13 + 10)


def test_divergence_of_odd_rows(spark):
    got = divergence.audit(odd(spark), min_docs=1).collect()
    assert {(r.lang, r.source) for r in got} >= {("en", "a"), ("", "a"), ("", "")}
    assert divergence.audit(empty(spark)).count() == 0
    alone = divergence.audit(odd(spark)).collect()  # nothing is kept
    assert all(r.part == "pair" and r.value == 0 for r in alone)


# Whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({k: F.lit("extra") for k in ("x", "whitened", "component", "d")})


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * 0.1).astype(np.float32)
    got = whitening.whiten(vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)]).repartition(5)).collect()
    x = np.floor(1024 * data.astype(float)) + 100000
    apart = x - x.mean(0)
    values, basis = np.linalg.eigh(apart.T @ apart / len(x))
    values, basis = values[::-1], basis.T[::-1]
    assert len(got) == 300 * 8 and {r.n for r in got} == {300}
    whole = [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*whole)]
    want = apart @ basis.T / np.sqrt(values)
    sign = {}
    for r in got:
        assert r.deviation == sum((300 * v - s) ** 2 for v, s in zip(whole[r.vec_id], sums))
        w = want[r.vec_id, r.component - 1]
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(w) - abs(r.whitened)) < 1e-8 and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
    assert max(r.identity_error for r in got) < 1e-9


def test_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.1]), (2, [0.25, -3.0]), (None, [0.5, 0.1]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, []), (9, [1e30, 0.0]), (1, [0.75, 0.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert collections.Counter(r.vec_id for r in got) == {1: 4, 2: 2, None: 2} and {r.n for r in got} == {4}
    assert whitening.whiten(vectors(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0


def test_vectors_without_variance(spark):
    got = whitening.whiten(vectors(spark, [(1, [0.5, 0.1, 0.0])] * 3)).collect()
    assert len(got) == 9 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in got} == {(0.0, 0.0, 0, 0.0)}
    flat = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)])).collect()
    assert {r.component for r in flat if r.whitened != 0} == {1} and abs(flat[0].explained - 1) < 1e-9 and flat[0].identity_error < 1e-9


def test_deviations_beyond_a_long(spark):
    x = spark.createDataFrame([(1, [3.0e9]), (2, [-3.0e9])], "vec_id long, x array<double>")
    model = whitening.fit(x)
    assert not model.fits and {r.deviation for r in whitening.project(x, model).collect()} == {None}
    near = spark.createDataFrame([(1, [2.0e9]), (2, [0.0]), (3, [0.0])], "vec_id long, x array<double>")
    assert {r.vec_id: r.deviation for r in whitening.project(near, whitening.fit(near)).collect()} == {1: None, 2: 4 * 10**18, 3: 4 * 10**18}
