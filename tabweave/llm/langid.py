"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of lower-cased code points per language in the executors, sums them per
(language, bucket) and brings the table of ``languages x buckets`` counts to the driver. The log-probability matrix is broadcast
and each batch of texts is scored in numpy: the hashed grams of a batch are a sparse (document, bucket) list, gathered from the
matrix in pieces of bounded size and summed by document.

The matrix has at most MAX_CELLS cells (256 MB) whatever the input is: there are ``2 ** bits`` buckets, and half as many for each
doubling of the languages beyond MAX_CELLS / 2 ** bits (1,024 with 16 bits). The languages are a label set, whose names are on the driver.

Training uses at most about ``per_lang`` documents of each language, chosen by a hash of id and text length.

Cases: null or empty text, or one without a letter: ``und`` with score 0. Null languages are not learned. If nothing
can be learned, every text is ``und``. Ties go to the alphabetically first language. Repeated rows and null ids are
scored like any other row. Very long texts are hashed whole and scored in pieces. An empty table gives no rows. Extra columns
are ignored by ``detect`` and passed through by ``keep_known``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import join_small, materialize, texts, without

UNDETERMINED = "und"
#: Cells of the log-probability matrix, and of what is gathered from it at once.
MAX_CELLS = 1 << 26
MAX_GATHERED = 1 << 21
#: Languages whose counters a training task holds at once.
HELD_LANGS = 128
_WORDY = re.compile(r"[^\W\d_]")


@dataclass
class LangModel:
    """langs: sorted names; logp: float32, buckets x languages; prior: per language."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray
    bits: int


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _WORDY.finditer(text))


def gram_codes(codes: np.ndarray, ends: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: buckets of the grams that lie within one document, and the position each starts at."""
    c = codes.astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - bits)
    h = one
    doc_end = np.repeat(ends, np.diff(ends, prepend=0))  # of the document each position is in
    for n in (1, 2, 3):
        if n > 1:
            if len(c) < n:
                return
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[n - 1 :]
        at = np.arange(len(h))
        inside = at + n <= doc_end[: len(h)]
        mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + np.uint32(n * 0x27D4EB2F)
        yield (mixed[inside] >> shift).astype(np.int64), at[inside]


def code_points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts one after the other, and where each text ends."""
    low = [p.lower() for p in parts]
    return np.frombuffer("".join(low).encode("utf-32-le"), dtype=np.uint32), np.cumsum([len(p) for p in low])


def blocks(parts: list[str], most: int = 200_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``most`` code points together, with the index of the first; a longer text alone."""
    first, size = 0, 0
    for i, p in enumerate(parts):
        if size and size + len(p) > most:
            yield first, parts[first:i]
            first, size = i, 0
        size += len(p)
    if first < len(parts):
        yield first, parts[first:]


def buckets_for(langs: int, bits: int) -> int:
    """The bits of a bucket, at most ``bits``, with which a matrix for so many languages has at most MAX_CELLS cells (2 buckets at least)."""
    while bits > 1 and langs << bits > MAX_CELLS:
        bits -= 1
    return bits


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 16, per_lang: int = 20_000, smoothing: float = 0.5) -> LangModel:
    """Learn from the rows that satisfy ``where`` and have a language and a text."""
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = materialize(rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("docs")))
    table = sizes.orderBy("lang").toArrow()
    langs, docs_of = table["lang"].to_pylist(), table["docs"].to_numpy().astype(float)
    bits = buckets_for(len(langs), bits)
    size = 1 << bits
    if not langs:
        return LangModel([], np.zeros((size, 0), np.float32), np.zeros(0), bits)
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("docs")).alias("share"))
    known = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    taken = join_small(known, share, "lang", "inner").where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    index = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                bucket = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lang, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[bucket])], names=["lang", "bucket", "n"])
            totals.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, part in texts(batch):
                by: dict[str, list[str]] = {}
                for name, text in zip(names[first : first + len(part)], part, strict=True):
                    by.setdefault(name, []).append(text)
                for name, group in by.items():
                    if index[name] not in totals:
                        if len(totals) >= HELD_LANGS:
                            yield from out()
                        totals[index[name]] = np.zeros(size, np.int64)
                    for _, some in blocks(group):
                        for buckets, _ in gram_codes(*code_points(some), bits):
                            totals[index[name]] += np.bincount(buckets, minlength=size)
        yield from out()

    counted = taken.select("lang", "text").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    grams = np.full((size, len(langs)), smoothing)
    grams[table["bucket"].to_numpy(), table["lang"].to_numpy()] += table["n"].to_numpy()
    return LangModel(langs, np.log(grams / grams.sum(0)).astype(np.float32), np.log(docs_of / docs_of.sum()), bits)


def score_texts(model: LangModel, parts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    names, scores = [UNDETERMINED] * len(parts), np.zeros(len(parts))
    if not model.langs:
        return names, scores
    at = [i for i, p in enumerate(parts) if has_letter(p)]
    for first, some in blocks([parts[i] for i in at]):
        codes, ends = code_points(some)
        sums = np.tile(model.prior, (len(some), 1))
        step = max(1, MAX_GATHERED // len(model.langs))
        for buckets, where in gram_codes(codes, ends, model.bits):
            of = np.searchsorted(ends, where, side="right")  # the text of each gram
            for a in range(0, len(buckets), step):
                firsts = np.flatnonzero(np.diff(of[a : a + step], prepend=-1))
                sums[of[a : a + step][firsts]] += np.add.reduceat(model.logp[buckets[a : a + step]], firsts, axis=0, dtype=np.float64)
        best = sums.argmax(1)
        top = sums[np.arange(len(some)), best]
        prob = 1 / np.exp(sums - top[:, None]).sum(1)
        for k, i in enumerate(at[first : first + len(some)]):
            names[i] = model.langs[best[k]]
            scores[i] = prob[k]
    return names, scores


def detect(docs: DataFrame, model: LangModel, keep: list[str], text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The columns ``keep`` of every row, with the predicted language and its probability."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keep = without(keep, (lang_as, score_as))
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = docs.select(*keep).withColumns({lang_as: F.lit(""), score_as: F.lit(0.0)}).schema
    out_names = [*keep, lang_as, score_as]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = []
            for _, part in texts(batch):
                n, s = score_texts(shared.value, part)
                names += n
                scores.append(s)
            if names:
                columns = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=out_names)

    return source.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: LangModel, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows, whole and unchanged, whose text has a language with at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for _, part in texts(batch, at):
                names, scores = score_texts(shared.value, part)
                good += [n != UNDETERMINED and s >= min_score for n, s in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
