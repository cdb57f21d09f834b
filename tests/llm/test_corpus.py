"""Corpus operators against brute force, round trips and odd inputs."""

import collections
import functools
import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.llm import chat, fingerprints, graph, langid, licences, mixing, ngram_join, pieces, quality, quality_rules, toxicity
from tabweave.llm.licence_texts import LICENCES, MIT

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(400))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


def odd(spark):
    """Nulls in every column, empty and blank texts, ties and repeated rows, a long text; and columns with clashing names."""
    rows = [(1, LONG, "en", "a"), (1, LONG, "en", "a"), (2, None, None, None), (None, "some words here", "en", "a"), (3, "", "en", "b"), (4, " \n\t", "fr", "b"), (5, LONG + " more", "en", None), (6, "1234 5678", None, "a"), (7, "x" * 50_000, "de", "b"), (None, None, None, None)]
    extra = {k: F.lit("extra") for k in ("_text", "score", "held_out", "n_words", "ids", "features", "_host", "token", "cid", "root", "label", "severity", "_key", "_nth", "_id", "_salt", "rejected", "_failed")}
    return documents(spark, rows).withColumns(extra)


def empty(spark):
    return documents(spark, []).limit(0)


# Near duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=3, groups=6, size=25):
    import random

    rnd = random.Random(seed)
    rows, n = [], 0
    passage = [f"p{i}" for i in range(40)]
    for g in range(groups):
        base = [f"g{g}w{rnd.randrange(900)}" for _ in range(rnd.choice([3, 6, 30, 120, 200]))]
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 6])):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            if rnd.random() < 0.4:
                w += passage
            rows.append((n, " ".join(w).upper() if rnd.random() < 0.2 else "\n".join([" ".join(w)])))
            n += 1
    return rows + [(n, ""), (n + 1, None), (n + 2, "one two"), (n + 3, "One  TWO"), (n + 4, "one two three")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_filter_of_class_ids_grows_with_them(spark):
    from unittest import mock

    ids = spark.range(3000).select(F.xxhash64("id").alias("cid"))
    with mock.patch.object(ngram_join, "FILTER_BITS", (10, 16)):
        table, bits = ngram_join._filter_bits(ids)
    assert bits == 16 and len(table) == 1 << 10
    for r in ids.limit(200).collect():
        u = r.cid & 0xFFFFFFFFFFFFFFFF
        assert all(int(table[at >> 6]) >> (at & 63) & 1 for at in ((u >> k) & 0xFFFF for k in ngram_join._FILTER_SHIFTS))


def test_near_duplicates_of_odd_rows(spark):
    got = ngram_join.near_duplicates(odd(spark)).collect()
    assert len(got) == 10
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(396, 1)} and by[5] == {(397, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[7] == {(1, 7)}
    assert by[None] == {(1, None), (0, None)}
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


@given(st.lists(st.text(alphabet="aB \n\té", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingles(texts):
    got = ngram_join.shingles(texts, most=40)
    for t, s in zip(texts, got, strict=True):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        assert len(s) == (len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else bool(w))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# Pieces


def test_pieces_equal_the_library_and_round_trip(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    vocabulary = pieces.load()
    texts = ["hello  world\nx", " a", "", "a ", "é日本 \t z", " " * 45 + "x", "a" * 300, "internationalization, https://example.com/?q=1", "😀👍🏽 ñandú", "\x00\x01", "a▁b", LONG]
    encoder = pieces.Encoder(vocabulary)
    import numpy as np

    got = [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)]
    assert got == sp.encode(texts)
    assert [pieces.decode(vocabulary, g) for g in got] == [sp.decode(g) for g in got]
    rows = pieces.encode_documents(odd(spark), ["doc_id", "ids"]).collect()
    assert len(rows) == 10 and all(r.round_trip for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (2, 3)} == {0}
    back = pieces.decode_documents(pieces.encode_documents(odd(spark), ["doc_id"]), ["doc_id"]).collect()
    assert {r.text for r in back if r.doc_id == 1} == {LONG}
    assert pieces.encode_documents(empty(spark), ["doc_id"]).count() == 0


@given(st.lists(st.text(alphabet="ab ▁éinto", min_size=1, max_size=30), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_merges_equal_a_plain_loop(texts):
    """The heap of pairs against merging the best pair, the leftmost among equals, over and over."""
    v = _vocabulary()
    for text in texts:
        parts = list(text)
        while True:
            pairs = [(-v.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in v.scores]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert pieces.Encoder(v).merged(text) == parts


@functools.cache
def _vocabulary():
    return pieces.load()


def test_lattice_scores_of_merge_and_unigram_models():
    """The best path's score against all segmentations, the forbidden neighbours left out for the merge model."""
    v = _vocabulary()
    for merges in (True, False):
        encoder = pieces.Encoder(pieces.Vocabulary(v.ids, v.scores, v.byte_ids, v.surface, merges, v.unk))
        for word in ("▁interest", "▁hello", "▁▁▁abcde", "▁winter"):
            found = []

            def cut(rest, path, found=found, encoder=encoder, merges=merges):
                if not rest:
                    found.append((sum(v.scores[p] for p in path), path))
                for n in range(1, len(rest) + 1):
                    if rest[:n] in v.scores and (not merges or encoder.allowed(path[-1] if path else "", rest[:n])):
                        cut(rest[n:], [*path, rest[:n]])

            cut(word, [])
            best = max(found)
            state = [("", 0.0)]
            encoder.forward(word, state)
            assert abs(state[-1][1] - best[0]) < 1e-6 and state[-1][0] == best[1][-1]
            assert not merges or (len(found) == 1 and best[1] == encoder.merged(word))


def test_a_very_long_word():
    v = _vocabulary()
    import numpy as np

    text = "ab" * 100_000
    ids = np.frombuffer(pieces.Encoder(v).encode([text])[0], np.int32).tolist()
    assert pieces.decode(v, ids) == text and len(ids) < len(text)
    assert "".join(pieces.Encoder(v).merged("日x" * 20_000)) == "日x" * 20_000


def test_unigram_lattice():
    v = pieces.Vocabulary({"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}, {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -1.5, "▁a": -1.9}, [9] * 256, [b" ", b"a", b"b", b"ab", b" a"], False, 8)
    import numpy as np

    assert [np.frombuffer(x, np.int32).tolist() for x in pieces.Encoder(v).encode(["ab", "abab"])] == [[0, 3], [0, 3, 3]]


# Fingerprints


def reference_phrases(text):
    known, out, i = set(), [], 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        out.append(text[i:j])
        known.add(text[i:j])
        i = j
    return out


@given(st.text(alphabet="abc ", max_size=60), st.text(alphabet="abc ", max_size=30))
@settings(max_examples=100, deadline=None)
def test_phrases(text, following):
    assert fingerprints.phrases(text) == reference_phrases(text)
    new, cut = fingerprints.edited_text(text, following)
    assert fingerprints.phrases_with_edit(text, new, cut) == (reference_phrases(text), reference_phrases(new))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_fingerprints_equal_brute_force(spark, n):
    import random

    rnd = random.Random(n)
    ids = rnd.sample(range(-50, 1000), n)
    rows = [(i, None if rnd.random() < 0.1 else "".join(rnd.choice("ab cdé") for _ in range(rnd.randint(0, 90)))) for i in ids]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    assert len(got) == n
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % n][1]
        new, _ = fingerprints.edited_text(t, following)
        a, b, c = (fingerprints.signature(reference_phrases(x)) for x in (t, new, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.written(a), fingerprints.written(b))
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.fingerprints(odd(spark)).collect()
    assert len(got) == 10
    assert len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1


def test_likeness_of_long_texts_estimates_jaccard():
    import random

    def words(seed, alphabet, n):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choices(alphabet, k=rnd.randint(2, 9))) for _ in range(n))

    low, high, n = "abcdefghijklm", "nopqrstuvwxyz", 100_000
    text = words(1, low, n)
    others = [words(2, high, n).replace(" ", "_"), words(3, low, n), text[: len(text) // 2] + words(4, high, n // 2), text[: len(text) * 9 // 10] + words(5, low, n // 10), words(6, high, 2 * n)]
    mine = fingerprints.phrases(text)
    for other in others:
        its = fingerprints.phrases(other)
        true = len(set(mine) & set(its)) / len(set(mine) | set(its))
        error = (true * (1 - true) / fingerprints.N_HASHES) ** 0.5
        assert abs(fingerprints.likeness(fingerprints.signature(mine), fingerprints.signature(its)) - true) <= 3.5 * error + 0.01


# Chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b", "### ", "\\", ""]), st.text(alphabet="\\#< /turn>:\n a", max_size=25)), min_size=1, max_size=4))
@settings(max_examples=12, deadline=None)
def test_chat_round_trip(spark, turns):
    turns = turns + [("assistant", "</turn>\n### user: x"), ("user", "\\### Assistant: </turn> ok")]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(rows).collect()
    assert len(made) == 1 and made[0].round_trip
    assert [(t.role, t.text) for t in made[0].turns] == turns
    masked = [re.sub(r"(?s)\\(.)", r"\1", made[0].formatted[s.start : s.end]) if s.escaped else made[0].formatted[s.start : s.end] for s in made[0].loss_spans]
    assert masked == [t for r, t in turns if r == "assistant"]


def test_chat_digests_and_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é</turn>"), (1, 1, "assistant", "é</turn>"), (2, 0, None, None), (None, 0, "assistant", ""), (3, None, "system", "s")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("out", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 16
    assert got[1].turns_sha256 == hashlib.sha256("user\nhi\nassistant\né</turn>\nassistant\né</turn>\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("é</turn>é</turn>".encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and set(got) == {1, 2, 3, None}
    assert chat.format_conversations(frame.limit(0)).count() == 0


# Licences


def test_licences(spark):
    wild = "Copyright (c) 2020, Some One\n\n" + MIT.replace("sublicense", "sub-license").replace(",", " ,").upper()
    rows = [(1, wild, None, None), (2, "Intro\n\nreleased UNDER the MIT licence!\nbye", None, None), (3, "MIT", None, None), (4, None, None, None), (5, "before\n\n" + LICENCES["zlib"].split("\n\n")[0] + "\n\nafter", None, None), (6, "Released under the MIT License.\nx\nReleased under the MIT License.", None, None)]
    got = {r.doc_id: r for r in licences.scan(documents(spark, rows), licences.registry(spark)).collect()}
    assert got[1].whole_licence == "mit"
    assert (got[2].whole_licence, got[2].notices) == (None, "mit-line")
    assert (got[3].n_notices, got[4].n_notices, got[5].n_notices, got[6].n_notices) == (0, 0, 0, 2)
    assert licences.scan(odd(spark), licences.registry(spark)).count() == 10
    assert licences.scan(empty(spark), licences.registry(spark)).count() == 0
    assert {r.bodies for r in licences.scan(documents(spark, rows), []).collect()} == {""}


def test_every_licence_is_found_whole_and_inside(spark):
    names = list(LICENCES)
    whole = [(i, LICENCES[n], None, None) for i, n in enumerate(names)]
    inside = [(100 + i, f"Some words before.\n{LICENCES[n].replace(chr(10) + chr(10), chr(10))} Permission is hereby granted, free of charge, to any\nand more", None, None) for i, n in enumerate(names)]
    cut = [(200 + i, LICENCES[n][: -len(LICENCES[n]) // 10], None, None) for i, n in enumerate(names)]
    got = {r.doc_id: r for r in licences.scan(documents(spark, whole + inside + cut), licences.registry(spark)).collect()}
    for i, n in enumerate(names):
        assert got[i].whole_licence == n
        long = len(LICENCES[n]) > 450
        assert (n in got[i].bodies.split(",")) == (n in got[100 + i].bodies.split(",")) == long
        assert got[100 + i].whole_licence is None and n not in got[200 + i].bodies.split(",")


def test_long_licences_by_their_digests(spark):
    import pathlib

    folder = pathlib.Path("/usr/share/common-licenses")
    files = {"apache-2.0": "Apache-2.0", "gpl-2.0": "GPL-2", "gpl-3.0": "GPL-3", "lgpl-2.1": "LGPL-2.1", "lgpl-3.0": "LGPL-3", "mpl-2.0": "MPL-2.0", "cc0-1.0": "CC0-1.0"}
    texts = {n: (folder / f).read_text() for n, f in files.items() if (folder / f).exists()}
    if not texts:
        pytest.skip("no licence texts on this machine")
    rows = [(i, t.replace("  ", " ").upper(), None, None) for i, t in enumerate(texts.values())] + [(100 + i, "x\n" + t + "\ny", None, None) for i, t in enumerate(texts.values())]
    got = {r.doc_id: r for r in licences.scan(documents(spark, rows), licences.registry(spark)).collect()}
    for i, n in enumerate(texts):
        assert got[i].whole_licence == n and got[100 + i].whole_licence is None
        assert n in got[100 + i].bodies.split(",")  # the Apache licence has its own notice inside as well


def test_many_heads_in_a_long_text(spark):
    """10,000 beginnings of a licence and then the licence, beside letters of several bytes; a text ten times as long takes about ten times as long."""
    import time

    known = licences.registry(spark)
    head = next(k.head for k in known if k.licence == "mit")
    took = []
    for n in (1_000, 10_000):
        rows = [(1, f"été {head} γ " * n + MIT + " end", None, None), (2, f"été {head} γ " * n, None, None)]
        began = time.perf_counter()
        got = {r.doc_id: r.bodies for r in licences.scan(documents(spark, rows), known).collect()}
        took.append(time.perf_counter() - began)
        assert got == {1: "mit", 2: ""}
    assert took[1] < 5


def test_a_large_registry(spark):
    texts = {f"l{i}": f"licence number {i} " + "of many words " * 3 for i in range(6_000)}
    known = licences.registry(spark, texts)
    assert len(known) == 6_000
    got = licences.scan(documents(spark, [(1, texts["l5999"].upper(), None, None), (2, "none", None, None)]), [*known[:40], *[k for k in known if k.licence == "l5999"]]).collect()
    assert {r.doc_id: r.whole_licence for r in got} == {1: "l5999", 2: None}


def test_anchors_leave_nothing_out(spark):
    """A text with a known text in it holds an anchor in its lower-case form, whatever stands around."""
    words = licences.anchors(licences.registry(spark))
    assert words
    for around in ("", "before", "e-mail a(c)b", "HTTPS://www.x.org", "favour 1"):
        for text in LICENCES.values():
            assert any(w in f"{around} {text.upper()}{around}".lower() for w in words)
            assert any(w in f"{text.lower().replace('license', 'licence')}" for w in words)
    # what a stem stands for is in every spelling that the canonical form makes one
    assert all(licences.STEM[1] in found for found, written in licences.SPELLINGS if licences.STEM[0] in written)
    assert licences.anchors([licences.Known("x", "", 9, "favor on it")]) == []


# Mixing


def test_mixing_schedule(spark):
    rows = [(i, "w " * (1 + i % 7), None, "big" if i < 300 else "small" if i < 340 else None) for i in range(400)]
    got = mixing.mix(documents(spark, rows), block_docs=64).collect()
    assert {r.doc_id for r in got if r.epoch == 0} == set(range(400))
    reads = collections.Counter(r.doc_id for r in got)
    assert max(reads.values()) <= 2 and {reads[i] for i in range(300)} == {1}
    tokens = collections.Counter()
    for r in got:
        tokens[r.source] += r.tokens
    for source, repeats in {(r.source, r.repeats) for r in got}:
        own = sum(1 + i % 7 for i, _, _, s in rows if s == source)
        assert repeats * own - 7 <= tokens[source] <= repeats * own + 1e-6
    places = [(r.source, r.epoch, r.block, r.position) for r in got]
    assert len(set(places)) == len(places)


def test_mixing_targets(spark):
    import math

    shares = spark.createDataFrame([("a", 10, 900), ("b", 10, 90), ("c", 10, 10)], "source string, docs long, tokens long")
    t = mixing.exponent(shares, target_entropy=0.8)
    z = [p**t for p in (0.9, 0.09, 0.01)]
    w = [x / sum(z) for x in z]
    assert abs(-sum(x * math.log(x) for x in w) - 0.8) < 1e-9
    t = mixing.exponent(shares, max_repeats=4.0)
    assert abs((0.9 / 0.01) ** (1 - t) - 4.0) < 1e-6


def test_mixing_to_a_budget_and_in_order(spark):
    rows = [(i, "w " * (1 + i % 7), None, "big" if i < 700 else "small") for i in range(800)]
    total = {s: sum(1 + i % 7 for i, _, _, x in rows if x == s) for s in ("big", "small")}
    got = mixing.in_order(mixing.mix(documents(spark, rows), max_repeats=2.0, budget=1200, block_docs=16)).collect()
    weight = {r.source: r.weight for r in got}
    assert abs(sum(weight.values()) - 1) < 1e-9
    read = collections.Counter()
    for r in got:
        read[r.source] += r.tokens
    for s in total:
        assert 1200 * weight[s] - 7 <= read[s] <= 1200 * weight[s] + 1
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    # every stretch of the order has about the target weights
    for a in range(0, len(got) - 80, 40):
        some = got[a : a + 80]
        assert abs(sum(r.tokens for r in some if r.source == "small") / sum(r.tokens for r in some) - weight["small"]) < 0.08


def test_running_sums_have_two_levels(spark):
    from unittest import mock

    rows = [(i, "w " * (1 + i % 5), None, "a" if i % 3 else "b") for i in range(300)]
    take = lambda: sorted((r.source, r.epoch, r.block, r.position, r.doc_id, round(r.slot, 9)) for r in mixing.mix(documents(spark, rows), block_docs=4).collect())
    one = take()
    with mock.patch.object(mixing, "GROUP_BLOCKS", 3):
        assert take() == one


def test_mixing_keeps_columns_with_clashing_names(spark):
    names = ("_id", "_tie", "_of", "_nth", "_each", "_reads", "_copies", "_s", "source_", "tokens", "epoch")
    frame = odd(spark).withColumns({k: F.lit("keep") for k in names})
    out = mixing.repeat_documents(frame)
    assert out.columns == frame.columns and all(r[k] == "keep" for r in out.collect() for k in names)


def test_mixing_of_odd_rows(spark):
    frame = odd(spark)
    assert sum(r.epoch == 0 for r in mixing.mix(frame).collect()) == 10
    out = mixing.repeat_documents(frame)
    assert out.columns == frame.columns and out.where("doc_id = 2").count() >= 1 and out.count() >= 10
    assert mixing.mix(empty(spark)).count() == 0 and mixing.repeat_documents(empty(spark)).count() == 0


# Rules, quality, language, toxicity


def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    many = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {i + k for i in range(len(w) - 2) if many[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(lines)


@given(st.text(alphabet="ab é#\n\t|", max_size=60))
@settings(max_examples=150, deadline=None)
def test_text_stats(text):
    assert quality_rules.text_stats(text) == brute_stats(text)


def brute_verdicts(rows, z=1.645):
    """kept and by_host of (id, text, host) by the moments of the beta-binomial distribution, in plain numbers."""
    kinds = ("any", "symbols", "lines", "lengths")
    failed = {}
    for i, t, _ in rows:
        n, chars, symbols, dup, repeated, lines = brute_stats(t)
        f = {"short": n < 50, "repeated": 100 * repeated > 50 * n, "symbols": 100 * symbols > 10 * n, "lines": 100 * dup > 30 * lines, "lengths": chars < 3 * n or chars > 10 * n}
        failed[i] = f | {"any": any(f.values()), "base": f["short"] or f["repeated"]}
    hosts = collections.defaultdict(list)
    for i, _, h in rows:
        if h is not None:
            hosts[h].append(failed[i])
    total = sum(map(len, hosts.values()))
    low, mean = {}, {}
    for kind in kinds:
        m = sum(f[kind] for fs in hosts.values() for f in fs) / total
        squares = sum(len(fs) * (sum(f[kind] for f in fs) / len(fs) - m) ** 2 for fs in hosts.values())
        room = total - sum(len(fs) ** 2 for fs in hosts.values()) / total - (len(hosts) - 1)
        rho = max(0, (squares / (m * (1 - m)) - (len(hosts) - 1)) / room) if room > 1e-9 and 0 < m < 1 else 0
        for h, fs in hosts.items():
            low[h, kind] = m - z * (m * (1 - m) / total) ** 0.5
            if rho > 1e-9:
                a, b = m * (1 / rho - 1) + sum(f[kind] for f in fs), (1 - m) * (1 / rho - 1) + sum(not f[kind] for f in fs)
                low[h, kind] = a / (a + b) - z * (a * b / (a + b) ** 2 / (a + b + 1)) ** 0.5
        mean[kind] = m
    by_host = {i: h is not None and (low[h, "any"] > max(0.5, mean["any"]) or any(low[h, k] > max(0.05, mean[k]) and failed[i][k] for k in kinds[1:])) for i, _, h in rows}
    return {i: (not failed[i]["base"] and not by_host[i], by_host[i]) for i, _, _ in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_host_verdicts_equal_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = []
    for h in range(25):
        bad = rnd.choice([0.0, 0.02, 0.1, 0.4, 0.9])
        for _ in range(rnd.choice([1, 1, 3, 20, 60])):
            kind = rnd.choice(["short", "symbols", "lines", "lengths"]) if rnd.random() < bad else "good"
            text = {"short": "too short", "symbols": LONG + " #" * 60, "lines": LONG + "\none line" * 9, "lengths": "extraordinarily" + LONG.replace("word", "extraordinarily"), "good": LONG}[kind]
            rows.append((len(rows), text, None if h == 0 else f"h{h}"))
    docs = documents(spark, [(i, t, None, h) for i, t, h in rows])
    got = {r.doc_id: (r.kept, r.by_host) for r in quality_rules.judge(docs, ["doc_id"]).collect()}
    assert got == brute_verdicts(rows)
    assert any(b for _, b in got.values())
    assert {r.doc_id for r in quality_rules.keep_passing(docs).collect()} == {i for i, (k, _) in got.items() if k}


def test_host_rules(spark):
    good, bad, marked = LONG, "short", LONG + " #" * 60
    rows = [(i, bad if i % 10 else good, None, "bad.host") for i in range(200)] + [(i, good if i % 5 else marked, None, "marked.host") for i in range(200, 400)]
    rows += [(400, good, None, None), (401, None, None, "good.host"), (402, bad, None, "tiny.host"), (403, marked, None, None)] + [(i, good, None, "good.host") for i in range(410, 600)] + [(600, marked, None, "good.host")]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, rows), ["doc_id"]).collect()}
    assert not any(got[i].kept for i in range(200)) and all(got[i].kept == (i % 5 > 0) for i in range(200, 400)) and not got[401].kept
    assert got[400].kept and got[403].kept and got[600].kept  # one marked text on a host without others stays
    kept = quality_rules.keep_passing(documents(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    clash = odd(spark).withColumn("rejected", F.lit("extra"))
    assert quality_rules.judge(clash, ["doc_id", "n_words", "_text"]).select("_text").distinct().count() == 1
    assert quality_rules.judge(clash, ["doc_id"]).count() == 10 and quality_rules.keep_passing(clash).columns == clash.columns
    assert quality_rules.judge(empty(spark), ["doc_id"]).count() == 0 and quality_rules.keep_passing(empty(spark)).count() == 0


def test_a_host_is_judged_by_the_others(spark):
    """Equal documents fare differently on hosts of which one stands out; where all hosts are alike, none is condemned."""
    marked = LONG + " #" * 60
    apart = [(i, marked if i % 4 == 0 else LONG, None, "worse") for i in range(100)] + [(100 + i, marked if i == 0 else LONG, None, f"h{i % 5}") for i in range(300)]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, apart), ["doc_id"]).collect()}
    assert not got[0].kept and got[100].kept and got[1].kept
    alike = [(i, marked if i % 10 < 3 else LONG, None, f"h{i // 10 % 8}") for i in range(400)]
    got = quality_rules.judge(documents(spark, alike), ["doc_id"]).collect()
    assert all(r.kept and not r.by_host and abs(r.host_rate - 0.3) < 1e-9 for r in got)


def test_spread_of_hosts_with_one_document():
    ones = [0, 1] * 20
    n, f = len(ones), sum(ones)
    assert quality_rules.spread_of(n, n, n, f, sum(x * x for x in ones)) == 0.0
    # hosts that fail all or nothing have all their spread between them
    assert quality_rules.spread_of(400, 40, 4000, 200, 200) > 0.9
    assert quality_rules.spread_of(0, 0, 0, 0, 0) == 0.0


def test_quality(spark):
    clean = [(i, f"This is a plain text, number {i}. It has some words in it and ends well.", None, None) for i in range(60)]
    junk = [(100 + i, "buy$$$ now### " * (10 + i), None, None) for i in range(60)]
    docs = documents(spark, clean + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, F.col("doc_id") % 3 == 0).collect()
    assert all(r.predicted == (r.doc_id < 100) and 0 <= r.score <= 1 for r in got)
    assert quality.classify(odd(spark), labels, F.lit(False)).count() == 10
    assert quality.classify(empty(spark), labels.limit(0), F.lit(False)).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0), F.lit(False)).collect()} == {0.5}


def test_quality_scores_equal_brute_force(spark):
    """Moments, shrinkage, densities and posterior once more, from the features and in another way."""
    import numpy as np

    rnd = np.random.default_rng(4)
    rows = [(i, " ".join(rnd.choice(["a", "The", "x#", "word.", "9", "lo!"], 5 + i % 40)) + "\n" * (i % 3), None, None) for i in range(160)]
    labels = {i: int(rnd.random() < (0.8 if i % 40 > 20 else 0.3)) for i in range(160)}
    got = {r.doc_id: r.score for r in quality.classify(documents(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), F.col("doc_id") % 5 == 0).collect()}
    x = {i: np.array(quality.features(t)) for i, t, _, _ in rows}
    own = {k: np.array([x[i] for i in x if i % 5 and labels[i] == k]) for k in (0, 1)}
    n = {k: len(v) for k, v in own.items()}
    covs = {k: np.cov(v.T, bias=True) for k, v in own.items()}
    pooled = sum(n[k] * covs[k] for k in (0, 1)) / sum(n.values())
    d = len(quality.FEATURES)
    for k in (0, 1):
        covs[k] = 0.89 * covs[k] + 0.1 * pooled + 0.01 * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
    for i, v in x.items():
        logs = [np.log(n[k]) - 0.5 * np.linalg.slogdet(covs[k])[1] - 0.5 * (v - own[k].mean(0)) @ np.linalg.solve(covs[k], v - own[k].mean(0)) for k in (0, 1)]
        assert abs(got[i] - 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))) < 1e-6


def test_language(spark):
    rows = [(i, f"the house and the garden number {i} are there", "en", None) for i in range(40)] + [(100 + i, f"das Haus und der Garten Nummer {i} sind dort", "de", None) for i in range(40)]
    model = langid.train(documents(spark, rows), F.lit(True))
    names, scores = langid.score_texts(model, ["the garden", "der Garten", "", None, "12 34 ½", "x"])
    assert names[:5] == ["en", "de", "und", "und", "und"] and names[5] in ("de", "en") and all(0 <= s <= 1 for s in scores)
    assert langid.detect(odd(spark), model, ["doc_id", "score"]).count() == 10
    kept = langid.keep_known(odd(spark), model)
    assert kept.columns == odd(spark).columns and {r.doc_id for r in kept.collect()} <= {1, 5, 7, None}
    nothing = langid.train(empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.detect(documents(spark, rows), nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.detect(empty(spark), model, ["doc_id"]).count() == 0


@given(st.lists(st.text(alphabet="abc é1ß", max_size=40), min_size=1, max_size=6), st.sampled_from([3, 7, 1 << 21]))
@settings(max_examples=60, deadline=None)
def test_language_scores_equal_brute_force(parts, gathered):
    """Sums of log probabilities gram by gram, in plain numbers, whatever is gathered at once."""
    import math
    from unittest import mock

    import numpy as np

    rnd = np.random.default_rng(5)
    logp = np.log(rnd.dirichlet(np.ones(256), 3).T).astype(np.float32)
    model = langid.LangModel(["a", "b", "c"], logp, np.log([0.5, 0.3, 0.2]), 8)
    with mock.patch.object(langid, "MAX_GATHERED", gathered):
        names, scores = langid.score_texts(model, parts)
    for text, name, score in zip(parts, names, scores, strict=True):
        if not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        low = text.lower()
        sums = list(model.prior)
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                codes, ends = langid.code_points([low[i : i + n]])
                bucket = list(langid.gram_codes(codes, ends, 8))[n - 1][0][0]
                sums = [s + float(logp[bucket, k]) for k, s in enumerate(sums)]
        top = max(range(3), key=sums.__getitem__)
        assert name == "abc"[top] and abs(score - 1 / sum(math.exp(s - sums[top]) for s in sums)) < 1e-4


def test_many_languages(spark):
    """More languages than a task holds counters for, and fewer buckets for them."""
    assert [langid.buckets_for(n, 16) for n in (1, 1024, 1025, 5000, 1 << 26)] == [16, 16, 15, 13, 1]
    rows = [(10 * k + i, f"{chr(0x4E00 + 5 * k)}{chr(0x4E01 + 5 * k)} {chr(0x4E02 + 5 * k)}", f"l{k:04d}", None) for k in range(1500) for i in range(2)]
    model = langid.train(documents(spark, rows).repartition(2), F.lit(True))
    assert model.bits == 15 and len(model.langs) == 1500 and model.logp.size <= langid.MAX_CELLS
    names, _ = langid.score_texts(model, [rows[2 * k][1] for k in range(0, 1500, 100)])
    assert names == [f"l{k:04d}" for k in range(0, 1500, 100)]


def test_toxicity(spark):
    rows = [(i, f"a kind and plain text with number word{i % 17}", None, None) for i in range(120)] + [(200 + i, f"you {'idiot ' * (1 + i % 2)}{'scum trash moron ' if i % 3 == 0 else ''}number word{i % 17}", None, None) for i in range(60)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i, _, _, _ in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r for r in toxicity.grade(docs, model, ["doc_id"]).collect()}
    assert all(r.predicted == (i >= 200) for i, r in got.items())
    assert got[200].severity > got[201].severity > got[1].severity
    assert list(model.thresholds) == sorted(model.thresholds)
    assert toxicity.grade(odd(spark), model, ["doc_id", "severity"]).count() == 10
    untrained = toxicity.train(empty(spark), labels.limit(0), F.lit(True))
    assert all(r.predicted == 0 for r in toxicity.grade(docs, untrained, ["doc_id"]).collect())


def test_ordinal_fit_equals_brute_force():
    """The gradient fit against the likelihood of nearby parameters: nothing close by is better by more than the steps' error."""
    import numpy as np

    rnd = np.random.default_rng(2)
    rows = [np.flatnonzero(rnd.random(3) < 0.5) for _ in range(600)]
    true, cuts = np.array([2.0, -1.0, 0.5]), np.array([0.3, 1.5])
    margins = np.array([true[r].sum() for r in rows])
    grades = (margins[:, None] + rnd.logistic(size=(600, 1)) > cuts).sum(1)
    w, theta = toxicity._descend(rows, grades, 3, steps=800, rate=0.05)

    def likelihood(w, theta):
        total = 0.0
        for r, g in zip(rows, grades, strict=True):
            below = [0.0] + [1 / (1 + np.exp(-(t - w[r].sum()))) for t in theta] + [1.0]
            total += np.log(below[g + 1] - below[g])
        return total / len(rows)

    here = likelihood(w, theta)
    for at in range(5):
        for d in (-0.15, 0.15):
            p = np.concatenate([w, theta])
            p[at] += d
            assert likelihood(p[:3], p[3:]) < here
    assert here >= likelihood(true, cuts) and theta[0] < theta[1]


def test_terciles():
    import numpy as np

    assert toxicity.terciles(np.array([9, 1, 1, 2, 5, 7, 8]), np.array([0, 1, 1, 1, 1, 1, 1])).tolist() == [0, 1, 1, 2, 2, 3, 3]
    assert toxicity.terciles(np.array([4, 4, 4]), np.array([1, 1, 0])).tolist() == [1, 1, 0]


def test_given_grades_are_kept(spark):
    rows = [(200 * g + i, f"a plain text with number word{i % 17} {words}", None, None) for g, words in enumerate(["", "scum", "idiot", "moron"]) for i in range(60)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i // 200) for i, _, _, _ in rows], "doc_id long, severity int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 4 != 0, label_col="severity")
    got = {r.doc_id: r.grade for r in toxicity.grade(docs, model, ["doc_id"]).collect()}
    assert got == {i: i // 200 for i, _, _, _ in rows}


# Pipeline


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    plain = [(100 + i, " ".join(f"the{i}w{k} and" for k in range(60)), "en", f"h{i % 3}") for i in range(30)]
    frame = odd(spark).select(*odd(spark).columns).unionByName(documents(spark, plain), allowMissingColumns=True)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == frame.columns
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == {1} | {100 + i for i in range(30)} and all(r.round_trip for r in last)
    none = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
    assert none.count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    def text(name, n=40):
        return " ".join(f"{name}{k}" for k in range(n))

    rows = [(7, text("a")), (7, text("b")), (8, text("b") + " more"), (9, text("c")), (9, text("c"))]
    rows += [(None, text("a")), (None, text("d")), (None, text("d")), (None, text("d") + " more"), (None, text("e")), (10, " \n"), (11, " \n")]
    kept = corpus_pipeline.one_of_each_group(spark, documents(spark, [(i, t, None, None) for i, t in rows]), "").collect()
    got = sorted(((r.doc_id, r.text[:2]) for r in kept), key=str)
    assert got == sorted([(7, "a0"), (7, "b0"), (9, "c0"), (None, "d0"), (None, "e0"), (10, " \n"), (11, " \n")], key=str)
