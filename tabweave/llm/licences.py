"""Licence scan by canonical digests, in built-in expressions only.

A text is put into canonical form: lower case, copyright lines dropped, equivalent spellings made one, everything but
letters and digits of any script turned into single spaces. The SHA-256 of the whole canonical text is joined to the digests of
known licence texts: ``whole_licence``. Long licences (GPL, LGPL, MPL, Apache, CC0 and others) are known by their digests only.

Two more results come from the same digests. ``bodies``: licences that lie anywhere inside the text. Where a known licence's first
HEAD_WORDS words occur, as many characters as it has are taken and their digest is compared, so paragraphs, line breaks
and what stands around do not matter. ``notices``: one-line notices, by the digests of single lines and paragraphs.

Most texts have none of a few words of which every known text has one in a spelling that the canonical form leaves alone
(``anchors``); these texts match nothing, and their canonical form is not made. The registry is a parameter table on the driver, of any
size; its digests are counted before they are broadcast, and the plan has a literal for each of its texts.

Cases: null and empty texts match nothing. A text that holds a notice several times counts each; a body counts once. A
licence known under two names with one canonical text is reported under the alphabetically first. Texts within each other (a licence
with and without its title) are all reported as bodies. Repeated rows are each reported. Very long texts are scanned whole, in one
pass for each head that they have, and each of its occurrences costs a digest of the licence's length. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.common import join_small
from tabweave.llm.licence_texts import DIGESTS, LICENCES

HEAD_WORDS = 6
#: Known texts of at least so many characters are looked for inside others, shorter ones are notices.
BODY_LENGTH = 400

#: Equivalent spellings, as pairs (found, written), applied to lower-case text in this order.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("noninfringement", "non infringement"),
    ("non-infringement", "non infringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("https://", "http://"),
    ("http://www.", "http://"),
    ("(c)", "©"),
    ("copyright owner", "copyright holder"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("e-mail", "email"),
)
#: A word that spellings write, and what it begins with in every spelling of it.
STEM = ("license", "licen")
#: A line that only states a copyright.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:portions )?(?:copyright\b[ \t]*(?:\(c\)|©|[0-9])|©|\(c\)[ \t]*[0-9])[^\n]*$|^[ \t*#/;-]*all rights reserved\.?[ \t]*$"


def canonical(c: Column, keep_lines: bool = False) -> Column:
    """The canonical form; with ``keep_lines``, line feeds stay and only the rest is squeezed."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), r"\r\n?", "\n"), COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        c = F.replace(c, F.lit(old), F.lit(new))
    if keep_lines:
        c = F.regexp_replace(c, r"[^\p{L}\p{N}\n]+", " ")
        return F.regexp_replace(F.regexp_replace(c, r" ?\n ?", "\n"), r"\A[ \n]+|[ \n]+\z", "")
    return F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


@dataclass(frozen=True)
class Known:
    """A known text: name, SHA-256 and length of its canonical form, its first words, and its size in UTF-8 bytes."""

    licence: str
    digest: str
    length: int
    head: str
    bytes_: int | None = None

    @property
    def size(self) -> int:
        """Texts known by their digests only are ASCII."""
        return self.length if self.bytes_ is None else self.bytes_


def registry(spark: SparkSession, texts: dict[str, str] | None = None, digests: tuple[tuple[str, str, int, str], ...] | None = None) -> list[Known]:
    """The known texts and digests, one for each canonical form (the built-in ones without arguments)."""
    texts = LICENCES if texts is None else texts
    digests = digests if digests is not None else DIGESTS if texts is LICENCES else ()
    found = {d: Known(name, d, n, head) for name, d, n, head in sorted(digests, reverse=True)}
    if texts:
        rows = spark.createDataFrame(sorted(texts.items()), "licence string, text string").select("licence", canonical(F.col("text")).alias("c")).where("c <> ''")
        for r in rows.orderBy(F.desc("licence")).collect():
            d = hashlib.sha256(r["c"].encode()).hexdigest()
            found[d] = Known(min(r["licence"], found[d].licence) if d in found else r["licence"], d, len(r["c"]), " ".join(r["c"].split(" ")[:HEAD_WORDS]), len(r["c"].encode()))
    return sorted(found.values(), key=lambda k: k.licence)


def anchors(known: list[Known]) -> list[str]:
    """Few words of which every known text has one among its first words: a text whose canonical form has such a word has it in its
    lower-case form as well, as no spelling touches it, or has what the two spellings of a word begin with (``licen``). Longer words
    come first, as fewer texts have them. No words if some known text has none."""
    changed = {w for _, written in SPELLINGS for w in re.findall(r"[^\W_]+", written)}

    def sure(head: str) -> set[str]:
        words = [w for w in head.split(" ") if len(w) > 2]
        found = {w for w in words if not any(c in w for c in changed)} | {STEM[1] for w in words if STEM[0] in w}
        return {w for w in found if len(w) > 5 or w == STEM[1]} or found

    heads = [sure(k.head) for k in known]
    chosen: list[str] = []
    while heads:
        if not all(heads):
            return []
        best = min({w for h in heads for w in h}, key=lambda w: (-sum(w in h for h in heads), -len(w), w))
        chosen.append(best)
        heads = [h for h in heads if best not in h]
    return chosen


def bodies_in(padded: Column, known: list[Known]) -> Column:
    """The names of the known texts that lie inside a canonical text with a space before and after it, between spaces.

    A head cuts the text into pieces, whose running lengths give the places where it stands: one pass a head. At each place as many
    bytes as the licence has are taken (without a look at what lies before), and hashed if a blank follows them."""
    long = [k for k in known if k.length >= BODY_LENGTH]
    if not long:
        return F.array().cast("array<string>")
    table = F.array(*[F.struct(F.lit(k.licence).alias("licence"), F.lit(f" {k.head}").alias("head"), F.lit(k.size).alias("size"), F.lit(k.digest).alias("digest")) for k in long])
    blank = F.lit(" ").cast("binary")

    def lies(k: Column, text: Column, raw: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.lit(False).alias("met"))

        def step(now: Column, piece: Column) -> Column:
            # the piece ends where the head begins with its blank
            start = now["at"] + F.octet_length(piece)
            here = (F.substring(raw, start + k["size"] + 2, F.lit(1)) == blank) & (F.sha2(F.substring(raw, start + 2, k["size"]), 256) == k["digest"])
            return F.struct((start + F.octet_length(k["head"])).alias("at"), (now["met"] | here).alias("met"))

        # behind the last piece no head stands, but the text's end, where nothing has room
        return F.contains(text, k["head"]) & F.aggregate(F.split(text, k["head"]), none, step, lambda x: x["met"])

    # bound to a variable, so that the text and its bytes are made once, not for each place
    once = F.array(F.struct(padded.alias("text"), padded.cast("binary").alias("raw")))
    names = F.transform(once, lambda x: F.transform(F.filter(table, lambda k: lies(k, x["text"], x["raw"])), lambda k: k["licence"]))
    return F.get(names, F.lit(0))


def scan(docs: DataFrame, known: list[Known], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, whole_licence (null if the whole text is none), bodies, n_notices, notices (names in order, comma-separated)."""
    spark = docs.sparkSession
    words = anchors(known)
    # the lower-case text is a column of its own, so that it is made once for all anchors
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    some = F.lit(bool(known))
    if words:
        some = F.contains("low", F.lit(words[0]))
        for w in words[1:]:
            some = some | F.contains("low", F.lit(w))
    base = texts.select("doc_id", F.when(some, canonical(F.col("text"), True)).otherwise("").alias("c"))
    base = base.withColumn("whole", F.regexp_replace("c", "[ \n]+", " ")).withColumn("padded", F.concat(F.lit(" "), "whole", F.lit(" ")))
    whole = F.col("whole")
    lengths = sorted({k.length for k in known}) or [-1]
    short = sorted({k.length for k in known if k.length < BODY_LENGTH}) or [-1]
    units = F.concat(F.split("c", "\n"), F.transform(F.filter(F.split("c", r"\n{2,}"), lambda p: F.contains(p, F.lit("\n"))), lambda p: F.regexp_replace(p, "\n", " ")))
    units = F.when(F.col("c") == "", F.array().cast("array<string>")).otherwise(F.filter(units, lambda u: F.length(u).isin(short)))
    lookup = F.create_map(*[F.lit(x) for k in known if k.length < BODY_LENGTH for x in (k.digest, k.licence)]) if short != [-1] else F.create_map().cast("map<string,string>")
    found = F.array_sort(F.filter(F.transform(units, lambda u: F.try_element_at(lookup, F.sha2(u, 256))), lambda n: n.isNotNull()))
    per_doc = base.select(
        "doc_id",
        F.when(F.length(whole).isin(lengths), F.sha2(whole, 256)).alias("whole_digest"),
        F.when(F.col("c") == "", "").otherwise(F.array_join(bodies_in(F.col("padded"), known), ",")).alias("bodies"),
        found.alias("found"),
    )
    table = spark.createDataFrame([(k.digest, k.licence) for k in known], "whole_digest string, whole_licence string")
    joined = join_small(per_doc, table, "whole_digest")
    return joined.select("doc_id", "whole_licence", "bodies", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_distinct("found"), ",").alias("notices"))
