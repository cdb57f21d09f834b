"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each text becomes a vector of counts and shares, put on a log or logit scale. Every class has its own mean and
covariance; a class covariance S is shrunk to ``(1 - a - b) S + a P + b (tr P / d) I`` with the pooled covariance P. Only
moments are gathered (sums and products per class, one row per class), over all labelled rows. A class is kept as
its mean and the inverse Cholesky factor of its covariance, so that a Mahalanobis distance is one product and a sum of
squares and the log determinant is read off the diagonal. The score is the posterior probability of label 1 from the
difference of the two log densities.

Cases: null and empty texts have zero counts and get a score like any text. Null labels and labels other than 0 and 1
are not learned; a document with several labels counts once for each. If a class has no labelled row, the score is the
share of label 1 (0.5 without any). Repeated rows and null ids are scored like any row; a label of a null id is not learned. Very
long texts are counted whole. Ties cannot arise: a score at the threshold is predicted 1. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import materialize, texts, without
from tabweave.llm.quality_rules import SYMBOLS

FEATURES = ("words", "symbols", "shouts", "capitals", "repeats", "stutter", "distinct", "word_chars", "dup_lines", "stops", "line_words", "digits")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))


def features(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    count = lambda drop: len(raw) - len(raw.translate(None, drop))
    chars = sum(map(len, words))
    letters = sum(map(str.isupper, text)) if text and not text.isascii() else count(_UPPER)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = max(n - 2, 0)
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    pairs = sum(map(bytes.__eq__, words[1:], words))
    logit = lambda part, whole: float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)) if whole > 0 else 0.0)
    share = lambda part, whole: float(np.log(max(part, 0) / max(whole, 1) + 0.01))
    return [
        float(np.log1p(n)), share(count(SYMBOLS), chars), share(count(b"!"), n), share(letters, chars), share(windows - triples, windows + 30), share(pairs, n + 10),
        logit(len(set(words)), n) / max(1.0, np.log1p(n)), float(np.log1p(chars / max(n, 1))), share(len(lines) - len(set(lines)), len(lines) + 4), share(count(b".,"), n),
        float(np.log1p(n / max(len(lines), 1))), share(count(_DIGITS), chars),
    ]


def with_features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and an array ``features`` of every row."""
    keep = without(keep, ("features",))
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = docs.select(*keep).withColumn("features", F.array(F.lit(0.0))).schema
    names = [*keep, "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for _, part in texts(batch) for t in part]
            if rows:
                flat = np.array(rows)
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], arrays], names=names)

    return source.mapInArrow(run, schema)


@dataclass
class Qda:
    """Per class (0, 1): mean, inverse Cholesky factor, constant of the log density with the log prior; or a fixed score."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    fixed: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame, label_col: str = "label", to_pooled: float = 0.1, to_ball: float = 0.01) -> Qda:
    """Fit from a table of ``features`` and 0/1 labels."""
    d = len(FEATURES)
    x = F.col("features")
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    got = {r["label"]: r for r in labelled.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    if len(got) < 2:
        return Qda([], [], [], 0.5 if not got else float(next(iter(got))))
    n = {k: r["n"] for k, r in got.items()}
    means, covs = {}, {}
    for k, r in got.items():
        means[k] = np.array([r[f"s{i}"] for i in range(d)]) / n[k]
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                second[i, j] = second[j, i] = r[f"p{i}_{j}"] / n[k]
        covs[k] = second - np.outer(means[k], means[k])
    pooled = sum(n[k] * covs[k] for k in (0, 1)) / (n[0] + n[1])
    ball = max(np.trace(pooled) / d, 1e-6) * np.eye(d)
    model = Qda([], [], [])
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - to_pooled - to_ball) * covs[k] + to_pooled * pooled + to_ball * ball)
        model.means.append(means[k])
        model.factors.append(np.linalg.inv(lower))
        model.constants.append(float(np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(lower)).sum()))
    return model


def score(featured: DataFrame, model: Qda, keep: list[str]) -> DataFrame:
    """``keep`` and ``score`` of every row of a table with ``features``."""
    schema = featured.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(model.score(x))], names=[*keep, "score"])

    return featured.select(*keep, "features").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, held_out, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. ``held_out``: a column; where true, labels are not learned. The
    features of all rows are made once and held as a table; labels join to them, not to the texts."""
    featured = materialize(with_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_body")), ["doc_id"], "_body").withColumn("held_out", held_out))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    model = fit(featured.where(~F.col("held_out")).join(known, "doc_id"))
    return score(featured, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
