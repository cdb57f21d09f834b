"""Quality rules by host: failures of each rule are summed per host, the hosts' rates are shrunk with a beta prior fitted to all
hosts, and the hosts' verdicts are joined back to their documents.

Per document, in Arrow batches: words are runs without space, tab, line feed, vertical tab, form feed or carriage
return. Five rules look at a document; the first two are the base rule, which fails a document on its own:

* ``short``: fewer than ``min_words`` words
* ``repeated``: more than ``max_repeat_pct`` percent of the words lie in three-word windows that occur twice or more
* ``symbols``: more than ``max_symbol_pct`` of ``#*$%&|<>`` for 100 words
* ``lines``: more than ``max_dup_line_pct`` percent of the lines with a word equal an earlier line
* ``lengths``: the mean length of a word is not between ``min_mean`` and ``max_mean``

A failure of one of the last three says little by itself (a table, a refrain, a list of names); that a host fails one again and
again does. For each rule, and for failing any rule, a host's rate is estimated from its documents and failures and from the
beta prior of all hosts, by the moments of the beta-binomial distribution: the spread of the hosts' rates that is left after the
binomial part is taken off. A host stands out by a rule if the lower end of its posterior (the mean less ``Z`` standard deviations) is
above the mean of all hosts:

* so for failing any rule, and the lower end is above ``max_host_rate``: the host is rejected with all its documents;
* so for one of the last three rules, and the lower end is above ``max_rule_rate``: the host's documents that fail this rule are rejected.

Where the hosts' rates differ by no more than chance, no host stands out, however high the rate that all of them share is: then it is
the rule or the corpus that is unusual, and documents are judged by the base rule alone.

Cases: null and empty texts have no words and fail the base rule. Documents with a null host have no host verdict and are judged by
the base rule alone. Hosts of one document have no spread of their own: if all hosts are such, the prior is endless and every host
gets the mean of all, with the binomial error of that mean. Without spread beyond the binomial part it is so as well; no host stands
out then. Repeated rows count each time. Very long texts are
counted whole, one at a time. Ties cannot arise. An empty table gives no rows. Extra columns are ignored by ``judge`` and passed
through by ``keep_passing``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.common import fresh, join_small, materialize, texts, without

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The rules whose failures count only together with the host's verdict.
SOFT = ("symbols", "lines", "lengths")
RULES = ("short", "repeated", *SOFT)
#: Standard deviations below the posterior mean: about the fifth percentile.
Z = 1.645


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbol_pct: int = 10
    max_dup_line_pct: int = 30
    min_mean: int = 3
    max_mean: int = 10
    max_host_rate: float = 0.5
    max_rule_rate: float = 0.05

    def failed(self, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) -> dict:
        """Whether each rule fails, for numbers or columns."""
        return {
            "short": n_words < self.min_words,
            "repeated": 100 * n_repeat_words > self.max_repeat_pct * n_words,
            "symbols": 100 * n_symbols > self.max_symbol_pct * n_words,
            "lines": 100 * n_dup_lines > self.max_dup_line_pct * n_lines,
            "lengths": (word_chars < self.min_mean * n_words) | (word_chars > self.max_mean * n_words),
        }


DEFAULT = Limits()


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The five counts of STATS, and the lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes split at exactly BLANKS
    if not words:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        many = Counter(windows)
        hit = np.fromiter((many[w] > 1 for w in windows), bool, len(windows))
        cover = np.zeros(len(words), bool)
        for k in range(3):
            cover[k : k + len(hit)] |= hit
        repeated = int(cover.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def with_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, the five counts and ``n_lines``."""
    made = (*STATS, "n_lines")
    keep = without(keep, made)
    body = fresh("_text", keep)
    source = docs.select(*keep, F.col(text_col).alias(body))
    schema = docs.select(*keep).withColumns({k: F.lit(0).cast("long") for k in made}).schema
    names = [*keep, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t) for _, part in texts(batch) for t in part]
            if rows:
                columns = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]], names=names)

    return source.mapInArrow(run, schema)


def failures(limits: Limits) -> dict[str, Column]:
    """Whether each rule fails, over the columns of ``with_stats``."""
    return limits.failed(*[F.col(c) for c in (*STATS, "n_lines")])


def base_failed(limits: Limits = DEFAULT) -> Column:
    f = failures(limits)
    return f["short"] | f["repeated"]


def spread_of(n: float, k: float, squares: float, f: float, q: float) -> float:
    """The correlation rho = 1 / (a + b + 1) of the beta prior by moments, from the sums over the hosts: documents n, hosts k, squared
    documents, failures f and f_i * f_i / n_i. The hosts' weighted squared deviations q - f * f / n are expected to be
    m (1 - m) ((k - 1) + rho (n - squares / n - (k - 1))); 0 if there is no spread beyond the binomial part, or no way to see one."""
    m = f / n if n else 0.0
    room = n - squares / n - (k - 1) if n else 0.0
    if room <= 1e-9 or not 0 < m < 1:
        return 0.0
    return min(1.0, max(0.0, ((q - f * f / n) / (m * (1 - m)) - (k - 1)) / room))


def host_verdicts(stats: DataFrame, host_col: str, limits: Limits = DEFAULT) -> DataFrame:
    """Per host: documents, the shrunk rate of failing any rule, whether the host is rejected, and ``bad_`` for each soft rule.

    Only counts are summed over documents, map-side first, and the priors come from one row of sums over the hosts."""
    f = failures(limits)
    some = f[RULES[0]]
    for r in RULES[1:]:
        some = some | f[r]
    kinds = ("any", *SOFT)
    flags = {"any": some} | {r: f[r] for r in SOFT}
    counts = stats.where(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count(F.lit(1)).alias("host_docs"), *[F.count_if(flags[r]).alias(f"f_{r}") for r in kinds])
    hosts = materialize(counts)
    n = F.col("host_docs")
    sums = hosts.agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum((n * n).cast("double")).alias("squares"), *[x for r in kinds for x in (F.sum(f"f_{r}").alias(f"f_{r}"), F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / n).alias(f"q_{r}"))]).first()
    out, ends = hosts, {}
    for r in kinds:
        m = sums[f"f_{r}"] / sums["n"] if sums["n"] else 0.0
        rho = spread_of(sums["n"] or 0, sums["k"], sums["squares"] or 0.0, sums[f"f_{r}"] or 0, sums[f"q_{r}"] or 0.0)
        weight = 1 / rho - 1 if rho > 1e-9 else None
        mean, low = F.lit(float(m)), F.lit(float(m - Z * (m * (1 - m) / max(sums["n"] or 0, 1)) ** 0.5))
        if weight is not None:
            a, total = F.col(f"f_{r}") + F.lit(m * weight), n + F.lit(weight)
            mean = a / total
            low = mean - Z * F.sqrt(mean * (1 - mean) / (total + 1))
        # beyond the mean of all hosts, and the limit
        ends[r] = low > max(limits.max_host_rate if r == "any" else limits.max_rule_rate, m)
        if r == "any":
            out = out.withColumn("host_rate", mean)
    return out.withColumns({"rejected": ends["any"]} | {f"bad_{r}": ends[r] for r in SOFT})


def by_host(failed: dict[str, Column]) -> Column:
    """Whether the joined verdict of its host rejects a document; false without a verdict."""
    hit = F.col("rejected")
    for r in SOFT:
        hit = hit | (F.col(f"bad_{r}") & failed[r])
    return F.coalesce(hit, F.lit(False))


def judge(docs: DataFrame, keep: list[str], host_col: str = "source", text_col: str = "text", limits: Limits = DEFAULT) -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``host_rate``, ``by_host`` (the host's verdict rejects it) and ``kept`` of every row. The
    counts are made once and held as a table."""
    made = (*STATS, "n_lines", "base_failed", "by_host", "kept", "host_rate", "host_docs", "rejected", *[f"{k}{r}" for r in SOFT for k in ("bad_", "f_")], "f_any")
    keep = without(keep, made)
    host = fresh("_host", keep, list(made))
    stats = materialize(with_stats(docs.withColumn(host, F.col(host_col)), [*keep, host], text_col).withColumn("base_failed", base_failed(limits)))
    verdicts = host_verdicts(stats, host, limits).select(host, "host_rate", "rejected", *[f"bad_{r}" for r in SOFT])
    judged = join_small(stats, verdicts, host).withColumn("by_host", by_host(failures(limits)))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("by_host")).select(*keep, *STATS, "n_lines", "base_failed", "host_rate", "by_host", "kept")


def keep_passing(docs: DataFrame, host_col: str = "source", text_col: str = "text", limits: Limits = DEFAULT) -> DataFrame:
    """The rows, whole and unchanged, that pass the base rule and that their host's verdict leaves. The texts are read twice, once
    for the hosts' rates, so that they need not be shuffled or held."""
    counted = with_stats(docs.select(F.col(host_col).alias("_host"), F.col(text_col).alias("_body")), ["_host"], "_body")
    host, bits = fresh("_host", docs.columns), fresh("_failed", docs.columns)
    verdicts = host_verdicts(counted, "_host", limits).select(F.col("_host").alias(host), F.struct("rejected", *[f"bad_{r}" for r in SOFT]).alias(fresh("_verdict", docs.columns)))
    verdict = F.col(verdicts.columns[1])
    at = docs.columns.index(text_col)
    schema = docs.withColumn(bits, F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [limits.failed(*text_stats(t)) for _, part in texts(batch, at) for t in part]
            soft = pa.array([sum(1 << i for i, r in enumerate(SOFT) if f[r]) for f in found], pa.int32())
            good = pa.array([not (f["short"] or f["repeated"]) for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, soft], schema=pa.schema([*batch.schema, pa.field(bits, pa.int32())])).filter(good)

    joined = join_small(docs.mapInArrow(run, schema).withColumn(host, F.col(f"`{host_col}`")), verdicts, host)
    hit = verdict["rejected"]
    for i, r in enumerate(SOFT):
        hit = hit | (verdict[f"bad_{r}"] & (F.col(bits).bitwiseAND(1 << i) > 0))
    return joined.where(~F.coalesce(hit, F.lit(False))).select(*[f"`{c}`" for c in docs.columns])
