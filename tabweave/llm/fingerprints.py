"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases: each is the longest known phrase at its place and one more character, and becomes known
(the last one may be a known one). The set of phrases, hashed, is summed up by a minimum-hash signature: N_HASHES
positions, each the low 16 bits of the least value of one hash function over the set, written as four hex digits. (The high
bits of a minimum only tell how large the set is.) The likeness of two fingerprints is the share of equal positions, an estimate
of the phrase sets' Jaccard similarity.

An edited text has the same beginning up to its cut as its source, so the parse up to the cut is shared: what the source's
own end has added to the dictionary is taken back, and the parse goes on with the new end.

Neighbours. ``with_next`` deals the rows to ranges of the id and sorts each by id; one Arrow pass then sees every
document followed by its successor. The first document of each range is also sent to the range before it (the very first
to the last), marked, and only ends the stream there. So each text is shuffled once and no task sees more than its range.
Ranges are cut at approximate quantiles of the id; only their first ids (one per range) come to the driver.

Cases: null texts count as empty; the empty text has the phrase set {} and a constant fingerprint. Rows with equal ids
are ordered by text, null ids come first. With a single row, the next document is the row itself. Fully equal rows are
interchangeable. Very long texts are parsed whole. An empty table gives no rows. Extra columns are ignored. Rows of one id lie in
one range, as each needs its successor: ids are taken to be ids, and whole numbers (they are cast to long).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_HASHES = 128
_RANDOM = np.random.default_rng(20_240_607)
_FACTORS = (_RANDOM.integers(0, 1 << 31, N_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _RANDOM.integers(0, 1 << 32, N_HASHES, dtype=np.uint32)[:, None]


def _grow(root: dict, text: str, node: dict, start: int, at: int, added: list | None) -> tuple[list[str], dict, int]:
    """Parse text[at:] from a state; returns the new phrases and the state (node, start of the open phrase) at the end."""
    phrases = []
    for i in range(at, len(text)):
        ch = text[i]
        deeper = node.get(ch)
        if deeper is None:
            node[ch] = {}
            if added is not None:
                added.append((node, ch))
            phrases.append(text[start : i + 1])
            node, start = root, i + 1
        else:
            node = deeper
    return phrases, node, start


def phrases(text: str) -> list[str]:
    """The phrases of a text; the last may repeat an earlier one."""
    root: dict = {}
    found, _, start = _grow(root, text, root, 0, 0, None)
    return found + [text[start:]] if start < len(text) else found


def phrases_with_edit(text: str, edited: str, cut: int) -> tuple[list[str], list[str]]:
    """The phrases of two texts that are equal up to ``cut``."""
    root: dict = {}
    shared, node, start = _grow(root, text[:cut], root, 0, 0, None)
    both = []
    for whole in (text, edited):
        added: list = []
        more, _, end = _grow(root, whole, node, start, cut, added)
        both.append(shared + more + ([whole[end:]] if end < len(whole) else []))
        for parent, ch in reversed(added):
            del parent[ch]
    return both[0], both[1]


def signature(parts: list[str]) -> np.ndarray:
    """The low 16 bits of the minimum hashes of a set of phrases."""
    least = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    if parts:
        h = np.fromiter((crc32(p.encode()) for p in parts), np.uint32, len(parts))
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        for i in range(0, len(h), 2048):
            np.minimum(least, (h[i : i + 2048] * _FACTORS + _SHIFTS).min(1), out=least)
    return (least & np.uint32(0xFFFF)).astype(np.uint16)


def fingerprint(text: str | None) -> str:
    return written(signature(phrases(text or "")))


def written(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text, _end of every row, dealt by ranges of the id and sorted in each; rows with _end only close a range."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    cuts = sorted(set(docs.select(F.col(id_col).cast("long").alias("_id")).approxQuantile("_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    splits = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # the number of cuts at or below the id; null ids lie in the first range
    rank = F.coalesce(F.size(F.filter(splits, lambda c: c <= F.col("_id"))), F.lit(0)) if len(cuts) < 64 else _rank(cuts)
    ids = rows.select("_id").withColumn("_range", rank)
    firsts = [(r["_range"], r["_id"]) for r in ids.groupBy("_range").agg(F.when(F.max(F.col("_id").isNull()), None).otherwise(F.min("_id")).alias("_id")).orderBy("_range").collect()]
    ended = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # first id of a range -> the range before
    named = {k: v for k, v in ended.items() if k is not None}
    lookup = F.create_map(*[F.lit(x) for kv in named.items() for x in kv]) if named else F.create_map().cast("map<bigint,int>")
    closes = F.when(F.col("_id").isNull(), F.lit(ended.get(None))).otherwise(F.try_element_at(lookup, F.col("_id")))
    here = F.struct(rank.alias("_range"), F.lit(False).alias("_end"))
    there = F.struct(closes.cast("int").alias("_range"), F.lit(True).alias("_end"))
    dealt = rows.withColumn("_to", F.explode(F.when(closes.isNull(), F.array(here)).otherwise(F.array(here, there)))).select("_id", "_text", "_to._range", "_to._end")
    return dealt.repartitionById(len(cuts) + 1, F.col("_range")).sortWithinPartitions("_range", "_end", F.col("_id").asc_nulls_first(), "_text")


def _rank(cuts: list[float]):
    """The number of cuts at or below _id, by nested halving."""

    def half(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("_id") >= int(cuts[m]), half(m + 1, b)).otherwise(half(a, m))

    return F.when(F.col("_id").isNull(), 0).otherwise(half(0, len(cuts)))


def edited_text(text: str, following: str) -> tuple[str, int]:
    """The last quarter replaced by as many first characters of the following text; and where the change begins."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m], len(text) - m


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    dealt = with_next(docs, id_col, text_col)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last document: its id and text; it is emitted once its successor is known
        done: list[tuple] = []

        def flush():
            columns = list(zip(*done, strict=True))
            done.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def rows(batch: pa.RecordBatch, step: int = 64) -> Iterator[tuple]:
            for a in range(0, len(batch), step):
                yield from zip(*(batch.column(k).slice(a, step).to_pylist() for k in (0, 1, 3)), strict=True)

        waiting: dict = {}  # the held document's range has closed if its end row was seen
        for batch in batches:
            for doc_id, text, end in rows(batch):
                if held:
                    before_id, before = held.pop()
                    new, cut = edited_text(before, text)
                    mine, changed = phrases_with_edit(before, new, cut)
                    # the successor's own parse comes with its edit, one step later: keep what this row still lacks
                    sig, edit_sig = signature(mine), signature(changed)
                    if "row" in waiting:
                        row, its = waiting.pop("row")
                        done.append((*row, likeness(its, sig)))
                    waiting["row"] = ((before_id, len(before), hashlib.sha256(new.encode()).hexdigest(), written(sig), written(edit_sig), likeness(sig, edit_sig)), sig)
                if end:
                    if "row" in waiting:
                        row, its = waiting.pop("row")
                        done.append((*row, likeness(its, signature(phrases(text)))))
                    held.clear()
                else:
                    held.append((doc_id, text))
                if len(done) >= 256:
                    yield flush()
        if done:
            yield flush()

    return dealt.select("_id", "_text", "_range", "_end").mapInArrow(run, schema)
