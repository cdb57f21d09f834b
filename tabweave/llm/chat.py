r"""Chat formatting by grammar round trip, in built-in expressions only.

A turn is rendered as ``### role: text</turn>`` and a line feed. The parser cuts the output at every ``### `` and takes
from each piece the role up to the first ``: `` and the text up to ``</turn>``; a piece without exactly one ``</turn>``,
at its end, is no turn. It then drops the backslash of every escape (``\x`` is ``x``). A turn is first rendered as it
is and parsed again; if that does not give back its role and text, its backslashes are doubled and a backslash is put
into each control string (``#\## ``, ``<\/turn>`` and, in roles, ``:\ ``), so that no control string is left, and it is
parsed once more. Whole conversations are parsed again from the output; ``round_trip`` tells whether all turns came back.

``loss_spans`` is the loss mask: for each turn of the masked role, where its text starts and ends in the output (in code
points, from 0, the end left out) and whether it is escaped there.

Cases: null roles and texts count as empty. Turns are ordered by turn, role and text (nulls first), so ties and repeated
rows have one order and each gives a turn. Rows without a conversation id form one conversation with a null id. Very long texts
are formatted whole. An empty table gives no rows. Extra columns are ignored. The grouping brings one conversation, which is one
output, together; offsets are summed in it before, by the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
MASKED_ROLE = "assistant"


def _lit_replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, role: bool = False) -> Column:
    """Reversible: backslashes doubled, control strings broken by one."""
    c = _lit_replace(c, "\\", "\\\\")
    c = _lit_replace(c, OPEN, "#\\## ")
    c = _lit_replace(c, CLOSE, "<\\/turn>")
    return _lit_replace(c, SEP, ":\\ ") if role else c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), text, F.lit(CLOSE + "\n"))


def parse(output: Column) -> Column:
    """array<struct<role,text>> of the turns that the grammar finds; a piece that is no turn gives nulls."""
    pieces = F.split(output, OPEN)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, SEP)
        end = F.instr(piece, CLOSE)
        good = (at > 0) & (end > at) & (end == F.length(piece) - len(CLOSE))
        role = F.substring(piece, F.lit(1), at - 1)
        text = F.substring(piece, at + len(SEP), end - at - len(SEP))
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    # what stands before the first marker must be empty
    return F.when(F.startswith(output, F.lit(OPEN)), F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)).otherwise(F.array(F.lit(None).cast("struct<role:string,text:string>")))


def plain_is_enough(role: Column, text: Column) -> Column:
    """Whether the parser gives a turn back from its plain rendering."""
    back = parse(render(role, text))
    turn = F.get(back, F.lit(0))
    return F.coalesce((F.size(back) == 1) & turn.isNotNull() & (turn["role"] == role) & (turn["text"] == text), F.lit(False))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", masked_role: str = MASKED_ROLE) -> DataFrame:
    """conv_id, formatted, turns (parsed from ``formatted``), loss_spans, round_trip."""
    role, text = F.col("role"), F.col("text")
    one = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = one.withColumn("escaped", ~plain_is_enough(role, text))
    as_is = lambda c, is_role=False: F.when(F.col("escaped"), escape(c, is_role)).otherwise(c)
    one = one.withColumns({"written_role": as_is(role, True), "written": as_is(text)})
    head = len(OPEN + SEP) + F.length("written_role")
    length = head + F.length("written") + len(CLOSE) + 1
    before = F.sum(length).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)) - length
    one = one.withColumns({"at": before.cast("long"), "from": (before + head).cast("long")})
    span = F.struct(F.col("from").alias("start"), (F.col("from") + F.length("written")).alias("end"), "escaped")
    out = render(F.col("written_role"), F.col("written"))
    made = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at", out.alias("out"), span.alias("span")))).alias("t"))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    spans = F.transform(F.filter("t", lambda x: x["role"] == masked_role), lambda x: x["span"])
    made = made.select("conv_id", F.array_join(F.col("t.out"), "").alias("formatted"), source.alias("source_turns"), spans.alias("loss_spans"))
    made = made.withColumn("turns", parse(F.col("formatted")))
    return made.select("conv_id", "formatted", "turns", "loss_spans", F.coalesce(F.col("turns") == F.col("source_turns"), F.lit(False)).alias("round_trip"))


def masked_text(output: Column, spans: Column) -> Column:
    """All text under the loss mask, read from the output and unescaped."""

    def one(s: Column) -> Column:
        raw = F.substring(output, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.when(s["escaped"], unescape(raw)).otherwise(raw)

    return F.array_join(F.transform(spans, one), "")


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns: the turns as they were parsed from the output, and the text that the loss mask cuts from it."""
    said = masked_text(F.col("formatted"), F.col("loss_spans"))
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
