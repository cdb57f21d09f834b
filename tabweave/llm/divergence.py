"""Source divergence audit: how far the vocabulary of every source of a language lies from that of each other source, and which
terms set a source apart from its language.

Terms are runs of ASCII letters and characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms that occur in
MIN_DOCS of its documents at least (V terms). A group (a source of a language, or the whole language) with N occurrences of
kept terms gives a term with ``c`` of them the weight ``p = 1 + floor(SCALE * (c + 2) / (N + 2 V))``. Two weights differ by
``f = floor((p - q)^2 / (p + q))``. All of it is whole-number arithmetic (longs, and decimals of 38 digits where they don't suffice).

``f`` depends on the two counts alone, so for each pair of sources the terms are tallied by their joint counts (a, b), and ``f``
is evaluated once per combination and multiplied. Only terms that both sources have are looked at: tasks over terms
tally them in Arrow batches and hand out combinations with their multiplicity, not terms. The cells with a zero are implied: of
the terms that a source has ``a`` times, those not met together are (a, 0); what is left of the V terms is (0, 0). These
come from the sources' own histograms of counts by inclusion and exclusion. The result names every pair of sources of a
language, so it is quadratic in the sources of one language, and so is the tally; terms and documents are never paired.

One pass over the texts sums counts in the workers, at most HELD entries at a time, so a hot source or term shuffles its
partial sums only.

Cases: null text, language and source are read as ''. A text without terms still makes its group occur. A group without kept
terms has N = 0 and is compared like any other; a language without kept terms has value 0 for every pair and no ``term`` rows. A
language's only source has no ``pair`` rows. Ties have the item of the lesser UTF-8 bytes first. Repeated rows and ids count each
time; ids are not read. Very long texts are counted whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.common import materialize, texts

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Entries of counts that a worker holds before it hands them out.
HELD = 500_000
#: Rows (term, source, count) that are tallied together, and joint rows before they are folded.
BLOCK_ROWS, FOLD_ROWS = 20_000, 500_000

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
_TABLE = bytes(b if b >= 0x80 else (b | 0x20 if b in _LETTERS else 0x20) for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8, in order."""
    return (text or "").encode().translate(_TABLE).split()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); and a row with a null term for each group."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in found.items():
                columns = [pa.array([*n, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*(d[t] for t in n), 0], pa.int64())]
                of = [pa.repeat(pa.scalar(x, pa.string()), len(n) + 1) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*of, *columns], names=["lang", "source", "term", "n", "docs"])
            found.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in texts(batch):
                for i, text in enumerate(part, at):
                    n, d = found.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                    words = terms_of(text)
                    n.update(words)
                    d.update(set(words))
                if sum(len(n) for n, _ in found.values()) > held:
                    yield from handed_out()
        yield from handed_out()

    made = read.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def joint_counts(cells: DataFrame) -> DataFrame:
    """lang, s, t, a, b, m: for sources s < t, how many terms s has a times and t has b times, a and b above zero. ``cells``: lang,
    term, source, n with one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tally(block: pa.Table) -> Iterator[pa.RecordBatch]:
            code, values = {}, {}
            for c in ("lang", "term", "source"):
                column = block.column(c).combine_chunks().dictionary_encode()
                code[c], values[c] = column.indices.to_numpy().astype(np.int64), column.dictionary
            n, many = block.column("n").to_numpy(), len(values["source"])
            term = code["lang"] * len(values["term"]) + code["term"]
            held: list[pa.Table] = []

            def folded() -> pa.Table:
                return pa.concat_tables(held).group_by(["pair", "a", "b"], use_threads=False).aggregate([("m", "sum")]).rename_columns(["pair", "a", "b", "m"])

            # rows of a term lie together: compare each with the next one, the one after that, and so on
            for step in range(1, len(n)):
                same = np.flatnonzero(term[step:] == term[:-step])
                if not len(same):
                    break
                pair = (code["lang"][same] * many + code["source"][same]) * many + code["source"][same + step]
                held.append(pa.table({"pair": pair, "a": n[same], "b": n[same + step], "m": np.ones(len(same), np.int64)}))
                if sum(t.num_rows for t in held) > FOLD_ROWS:
                    held[:] = [folded()]
            if held:
                out = folded()
                pair = out.column("pair").to_numpy()
                names = [values["lang"].take(pa.array(pair // (many * many))), values["source"].take(pa.array(pair // many % many)), values["source"].take(pa.array(pair % many))]
                yield from pa.table([*names, *(out.column(c) for c in ("a", "b", "m"))], names=["lang", "s", "t", "a", "b", "m"]).to_batches()

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(len(b) for b in waiting) >= BLOCK_ROWS:
                block = pa.Table.from_batches(waiting)
                last = [block.column(c)[-1] for c in ("lang", "term")]
                others = pc.or_(pc.not_equal(block.column("lang"), last[0]), pc.not_equal(block.column("term"), last[1]))
                whole = pc.sum(others).as_py()  # sorted, so the rows before the last term
                if whole:
                    yield from tally(block.slice(0, whole))
                waiting = block.slice(whole).to_batches()
        if waiting:
            yield from tally(pa.Table.from_batches(waiting))

    rows = cells.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    made = rows.mapInArrow(run, "lang string, s string, t string, a long, b long, m long")
    return made.groupBy("lang", "s", "t", "a", "b").agg(F.sum("m").alias("m"))


def _p(count: str, total: str, v: str) -> str:
    of = f"({total} + 2 * {v})"
    # counts whose product fits a long, and all others
    return f"(1 + case when {count} < {(1 << 63) // SCALE - 2} then ({count} + 2) * {SCALE} div {of} else cast({count} + 2 as decimal(20,0)) * {SCALE} div {of} end)"


def _f(p: str, q: str) -> F.Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, s, t (s < t), value: the sum of f over all kept terms. ``groups``: lang, source, total, v."""
    right = groups.select("lang", F.col("source").alias("t"), F.col("total").alias("total_t"))
    pairs = groups.withColumnsRenamed({"source": "s", "total": "total_s"}).join(right, "lang").where("s < t")
    joint = joint_counts(cells)
    own = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("h"))
    zero = F.lit(0).cast("long")
    cell = lambda a, b, m: F.struct(a.alias("a"), b.alias("b"), m.alias("m"))
    a, b, m, h = F.col("a"), F.col("b"), F.col("m"), F.col("h")

    def opened(df: DataFrame, *made) -> DataFrame:
        return df.select("lang", "s", "t", F.explode(F.array(*made)).alias("x")).select("lang", "s", "t", "x.*")

    # what two sources share is taken off the (a, 0) and (0, b) that their own histograms give, and what is taken off twice is added
    shared = opened(joint, cell(a, b, m), cell(a, zero, -m), cell(zero, b, -m), cell(zero, zero, m))
    names = pairs.select("lang", "s", "t", "v")
    first = opened(own.withColumnsRenamed({"source": "s", "n": "a"}).join(names, ["lang", "s"]), cell(a, zero, h), cell(zero, zero, -h))
    second = opened(own.withColumnsRenamed({"source": "t", "n": "b"}).join(names, ["lang", "t"]), cell(zero, b, h), cell(zero, zero, -h))
    rest = names.select("lang", "s", "t", zero.alias("a"), zero.alias("b"), F.col("v").alias("m"))
    tallied = shared.unionByName(first).unionByName(second).unionByName(rest).groupBy("lang", "s", "t", "a", "b").agg(F.sum("m").alias("m")).where("m > 0")
    weighed = tallied.join(pairs, ["lang", "s", "t"]).withColumns({"p": F.expr(_p("a", "total_s", "v")), "q": F.expr(_p("b", "total_t", "v"))})
    sums = weighed.groupBy("lang", "s", "t").agg(F.sum(_f("p", "q") * F.col("m")).alias("value"))
    return names.join(sums, ["lang", "s", "t"], "left").select("lang", "s", "t", F.coalesce("value", zero).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the divergence from each other source of the language, all of them; part
    ``term``: the ``top_terms`` terms that the source has oftener than its language, by their share of the divergence from it."""
    counts = materialize(term_counts(docs, text_col, lang_col, source_col))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    cells = materialize(counts.select("lang", "term", "source", "n").join(kept, ["lang", "term"]))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("of_lang").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total")]))
    pairs = materialize(pair_values(cells, groups.drop("lang_total")))
    both = pairs.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), "value").unionByName(pairs.select("lang", F.col("t").alias("source"), F.col("s").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    weighed = cells.join(groups, ["lang", "source"]).withColumns({"p": F.expr(_p("n", "total", "v")), "q": F.expr(_p("of_lang", "lang_total", "v"))}).where("p > q")
    best = weighed.select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value")).withColumn("rank", rank).where(F.col("rank") <= top_terms)
    order = ["lang", "source", "part", "item", "value", "rank"]
    return both.withColumns({"rank": rank, "part": F.lit("pair")}).select(order).unionByName(best.withColumn("part", F.lit("term")).select(order))
