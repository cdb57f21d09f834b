"""Toxicity as severity grades: cumulative-link ordinal regression over sparse text features.

Features of a text are its distinct lower-cased words and the words' first four to eight characters, hashed. For every hash the
labelled rows used are counted per label; the hashes that stand out in toxic rows (at least ``min_docs`` rows, smoothed log odds
of at least ``min_odds``) are the model's features, so a text is a short sparse row.

Severity grades come from the labels. If a label to be learned is above 1, the labels are grades already and are used as they
are (rounded up). With labels 0 and 1, grades 1 to 3 of the toxic rows are made from how often abusive words occur in a row,
repeats counted, cut at the terciles of all toxic rows. So that a grade is no echo of the features that predict it, the words that
count in a row are those that stand out among the rows of the other of two folds (by a hash of the id); the row's own words do not
decide which words are abusive.

The model has one weight vector and one increasing threshold per grade step: P(grade > k) = sigmoid(w x - threshold k). It is fitted
on at most about ``max_rows`` labelled rows (toxic ones up to half of it), chosen by a hash of the id: features are counted over them
in the executors, and the gradient descent has their sparse rows on the driver. What comes to the driver is thus bounded by
``max_rows``. A text's expected severity is the sum of P(grade > k); ``score`` is P(grade > 0).

Cases: null and empty texts have no features and get the thresholds' score. Null labels are not learned. Without toxic or
clean rows nothing is learned and all scores are 0. Ties at a tercile take the lower grade; of equally probable grades the lower
one is predicted. Repeated rows count each time. Very long texts are read whole, as sets of words. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import materialize, texts, without

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)
GRADES = 3


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings (as signed 32-bit values in a long)."""
    raw = "\x01" + word
    return [crc32(raw.encode())] + [crc32(f"{n}{word[:n]}".encode()) for n in PREFIXES if len(word) > n]


class _Hashes(dict):
    """word -> its hashes, kept up to a bound."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = word_features(word)
        return got


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Ordinal:
    """weights by feature hash, and the increasing thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def margin(self, words: set[str], hashes: dict) -> float:
        w = self.weights
        got = {h for x in words for h in hashes[x] if h in w}
        return sum(w[h] for h in got)

    def above(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k), rows x thresholds."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds, -60, 60)))


def feature_counts(labelled: DataFrame) -> DataFrame:
    """h, fold, toxic, rows: in how many (toxic) rows of a fold each feature hash occurs; a task sums its rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        toxic: tuple[dict[int, int], ...] = ({}, {})
        rows: tuple[dict[int, int], ...] = ({}, {})

        def out(fold: int) -> pa.RecordBatch:
            keys = list(rows[fold])
            columns = [pa.array(keys, pa.int64()), pa.array([fold] * len(keys), pa.int32()), pa.array([toxic[fold].get(k, 0) for k in keys], pa.int64()), pa.array(list(rows[fold].values()), pa.int64())]
            rows[fold].clear()
            toxic[fold].clear()
            return pa.RecordBatch.from_arrays(columns, names=["h", "fold", "toxic", "rows"])

        for batch in batches:
            marks, folds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, part in texts(batch):
                for text, mark, fold in zip(part, marks[first:], folds[first:], strict=False):
                    mine, marked = rows[fold], toxic[fold]
                    for h in {h for w in distinct_words(text) for h in hashes[w]}:
                        mine[h] = mine.get(h, 0) + 1
                        if mark:
                            marked[h] = marked.get(h, 0) + 1
                for fold in (0, 1):
                    if len(rows[fold]) > 300_000:
                        yield out(fold)
        for fold in (0, 1):
            if rows[fold]:
                yield out(fold)

    return labelled.select("toxic", "fold", "text").mapInArrow(run, "h long, fold int, toxic long, rows long").groupBy("h", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))


def standing_out(counts: DataFrame, n: dict[int, int], min_docs: int, min_odds: float) -> DataFrame:
    """The hashes of ``counts`` (h, toxic, rows) that are more frequent in toxic rows than in others, among n[1] and n[0] rows."""
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("rows") - F.col("toxic") + 0.5) / (n[0] + 1))
    return counts.where((F.col("toxic") >= min_docs) & (odds >= min_odds))


def terciles(occurrences: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades: 0 for rows that are not toxic, 1 to 3 by the terciles of the toxic rows' occurrences."""
    cuts = np.quantile(occurrences[toxic > 0], [1 / 3, 2 / 3], method="inverted_cdf") if (toxic > 0).any() else np.zeros(2)
    return np.where(toxic == 0, 0, 1 + (occurrences > cuts[0]).astype(int) + (occurrences > cuts[1]))


def _descend(rows: list[np.ndarray], grades: np.ndarray, n: int, steps: int = 400, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the cumulative-link likelihood; thresholds stay increasing by positive gaps."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    k = int(grades.max())
    w, first, gaps = np.zeros(n), 1.0, np.zeros(max(k - 1, 0))
    params = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, theta = params[:n], np.cumsum(np.concatenate([[params[n]], np.exp(params[n + 1 :])]))
        margin = np.bincount(of, w[at], len(rows))
        below = 1 / (1 + np.exp(-np.clip(np.concatenate([[-60.0], theta, [60.0]])[None, :] - margin[:, None], -60, 60)))  # P(grade <= k - 1)
        i = np.arange(len(rows))
        high, low = below[i, grades + 1], below[i, grades]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p  # of log p by each bound
        g_margin = -(d_high - d_low)
        g_theta = np.array([d_high[grades == j].sum() - d_low[grades == j + 1].sum() for j in range(k)]) / len(rows)
        g = np.zeros_like(params)
        g[:n] = np.bincount(at, g_margin[of], n) / len(rows) - decay * w
        g[n] = g_theta.sum()
        for j in range(1, k):
            g[n + j] = g_theta[j:].sum() * np.exp(params[n + j])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n], np.cumsum(np.concatenate([[params[n]], np.exp(params[n + 1 :])]))


def train(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", min_docs: int = 6, min_odds: float = 2.0, max_rows: int = 50_000) -> Ordinal:
    """Learn from labelled documents whose id satisfies ``where`` (a condition on ``doc_id``)."""
    known = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("toxic"), F.greatest(F.ceil(label_col), F.lit(0)).cast("int").alias("given")).where(where & F.col("toxic").isNotNull())
    found = known.groupBy("toxic").agg(F.count(F.lit(1)), F.max("given")).collect()
    n, most = {r[0]: r[1] for r in found}, max((r[2] for r in found), default=0)
    if len(n) < 2:
        return Ordinal({}, np.array([60.0] * GRADES))
    # a bounded set of labelled ids goes to the texts, so no text is shuffled for the join
    toxic_rows = min(n[1], max_rows // 2)
    share = F.when(F.col("toxic") == 1, toxic_rows / n[1]).otherwise(min(1.0, (max_rows - toxic_rows) / n[0]))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    known = known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic", "given", "fold"))
    of = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    n = {k: of.get((0, k), 0) + of.get((1, k), 0) for k in (0, 1)}
    counts = materialize(feature_counts(rows))
    both = counts.groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
    feature = {h: i for i, h in enumerate(np.sort(standing_out(both, n, min_docs, min_odds).select("h").toArrow()["h"].to_numpy()).tolist())}
    # what counts as abusive in a row of one fold is learned from the other fold
    abusive = tuple(
        frozenset(standing_out(counts.where(F.col("fold") == 1 - fold), {k: of.get((1 - fold, k), 0) for k in (0, 1)}, min_docs // 2, min_odds).select("h").toArrow()["h"].to_pylist())
        for fold in (0, 1)
    )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found, often = [], []
            folds = batch.column(2).to_pylist()
            for first, part in texts(batch):
                for text, fold in zip(part, folds[first:], strict=False):
                    words = _WORD.findall(text.lower()) if text else []
                    found.append(sorted({feature[h] for w in set(words) for h in hashes[w] if h in feature}))
                    often.append(sum(hashes[w][0] in abusive[fold] for w in words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.int32())], names=["toxic", "given", "x", "n"])

    table = rows.select("toxic", "given", "fold", "text").mapInArrow(rows_of, "toxic int, given int, x array<int>, n int").toArrow()
    toxic = table["toxic"].to_numpy()
    grades = table["given"].to_numpy() if most > 1 else terciles(table["n"].to_numpy(), toxic)
    present = np.unique(grades)
    if len(present) < 2 or not feature:
        return Ordinal({}, np.array([60.0] * GRADES))
    dense = np.searchsorted(present, grades)
    w, theta = _descend([np.array(x, np.int64) for x in table["x"].to_pylist()], dense, len(feature))
    # a grade that no row has is never predicted: its step shares the next present one's threshold
    steps = np.array([theta[np.searchsorted(present, k) - 1] if k <= present[-1] else 60.0 for k in range(1, max(GRADES, most) + 1)])
    return Ordinal({h: float(w[i]) for h, i in feature.items()}, steps)


def grade(docs: DataFrame, model: Ordinal, keep: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep``, severity (expected grade), grade (most probable), score and predicted (score >= threshold) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = without(keep, ("severity", "grade", "score", "predicted"))
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = docs.select(*keep).withColumns({"severity": F.lit(0.0), "grade": F.lit(0), "score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = shared.value, _Hashes()
        for batch in batches:
            margins = [model.margin(distinct_words(t), hashes) for _, part in texts(batch) for t in part]
            if margins:
                above = model.above(np.array(margins))
                steps = np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))])
                best = (steps[:, :-1] - steps[:, 1:]).argmax(1)
                out = [pa.array(above.sum(1)), pa.array(best.astype(np.int32)), pa.array(above[:, 0]), pa.array((above[:, 0] >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *out], names=[*keep, "severity", "grade", "score", "predicted"])

    return source.mapInArrow(run, schema)
