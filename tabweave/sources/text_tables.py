"""Tables inside texts: Markdown in built-in expressions, HTML by a streaming parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.text import strip
from tabweave.plans.shared import hold
from tabweave.schema import CELL, ROWS, TABLES, TableSet

_MARK = "\x00"
#: Tables of one document that its table ids leave room for.
ROOM = 1 << 20


def table_ids(doc_id: Column, table_index: Column) -> Column:
    return doc_id * ROOM + table_index


def table_columns(**known: Column) -> list[Column]:
    """All columns of a tables DataFrame: the given ones, the others null."""
    return [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES]


def as_cell(text: Column) -> Column:
    return F.struct(text.alias("v"), F.when(text.isNull(), "none").otherwise("str").alias("t"))


def has_markdown(text: Column) -> Column:
    return text.contains("|---") | text.contains("| ---")


def has_html(text: Column) -> Column:
    return F.coalesce(F.lower(text).contains("<table"), F.lit(False))


def markdown_grids(text: Column) -> Column:
    """array of tables, each an array of rows of stripped cells. Neighbouring lines with a pipe form a table; what stands before the
    first and after the last pipe is no cell; rows whose cells hold only '-' and ':' (or nothing at all) are rules and left out."""
    # each line without a pipe becomes a mark, and the marks cut the text into tables
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(" ")), r"(?md)^[^|\n]*$", _MARK)

    def row(line: Column) -> Column:
        parts = F.split(line, r"\|")
        return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), strip)

    def rows(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: x.contains("|"))
        return F.filter(F.transform(lines, row), lambda r: ~F.forall(r, lambda c: c.rlike(r"^[-:]*\z")))

    return F.filter(F.transform(F.split(marked, _MARK), rows), lambda t: F.size(t) > 0)


def from_grids(found: DataFrame, source_file: Column, method: str = "dataframe") -> TableSet:
    """A TableSet from columns doc_id, table_index, grid (array of rows of text): the first row is the header."""
    ids = table_ids(F.col("doc_id"), F.col("table_index")).alias("table_id")
    tables = found.select(*table_columns(table_id=ids, source_file=source_file, table_index=F.col("table_index"), extraction_method=F.lit(method), headers=F.array(F.transform(F.get("grid", F.lit(0)), lambda c: F.coalesce(c, F.lit(""))))))
    rows = found.select(ids, F.posexplode(F.slice("grid", F.lit(2), F.greatest(F.size("grid") - 1, F.lit(0)))).alias("row_idx", "row"))
    rows = rows.select("table_id", F.col("row_idx").cast("long").alias("row_idx"), F.transform("row", as_cell).cast("array<struct<v:string,t:string>>").alias("cells"))
    return TableSet(tables, rows)


def read_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_file: Column | None = None) -> TableSet:
    """The Markdown tables of a column of texts. No row leaves its task."""
    keep = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.lit("markdown") if source_file is None else source_file).alias("source_file"))
    found = keep.where(F.col("text").contains("|")).select("doc_id", "source_file", F.posexplode(markdown_grids(F.col("text"))).alias("table_index", "grid"))
    return from_grids(found, F.col("source_file"))


class _Tables(HTMLParser):
    """Collects the tables of a page: for each, rows of (text, is header, rowspan, colspan), and how many rows a head has."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.done.append(made := {"rows": [], "head": 0, "cell": None, "in_head": False})
            self.open.append(made)
        elif self.open:
            now = self.open[-1]
            if tag == "tr":
                now["cell"] = None
                now["rows"].append([])
                now["head"] += now["in_head"]
            elif tag in ("td", "th"):
                if not now["rows"]:
                    now["rows"].append([])
                spans = {k: max(1, int(v)) if (v or "").isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
                now["cell"] = [[], tag == "th", spans.get("rowspan", 1), spans.get("colspan", 1)]
                now["rows"][-1].append(now["cell"])
            elif tag in ("thead", "tbody", "tfoot"):
                now["in_head"] = tag == "thead"

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag == "table":
            self.open.pop()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1]["cell"] = None
        elif self.open and tag == "thead":
            self.open[-1]["in_head"] = False

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"]:
            self.open[-1]["cell"][0].append(data)


def _spread_spans(rows: list[list]) -> list[list[tuple[str, bool]]]:
    """Cells repeated over the rows and columns that they span."""
    out: list[list[tuple[str, bool]]] = []
    below: dict[int, tuple[tuple[str, bool], int]] = {}
    for row in rows:
        made: list[tuple[str, bool]] = []
        waiting, below = below, {}

        def from_above(waiting: dict = waiting, made: list = made) -> None:
            while len(made) in waiting:
                cell, more = waiting[len(made)]
                if more > 1:
                    below[len(made)] = (cell, more - 1)
                made.append(cell)

        for parts, header, down, across in row:
            from_above()
            cell = (re.sub(r"\s+", " ", "".join(parts)).strip(), header)
            for _ in range(across):
                if down > 1:
                    below[len(made)] = (cell, down - 1)
                made.append(cell)
        from_above()
        out.append(made)
    return out


_INT, _FLOAT = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def typed_columns(rows: list[list[str | None]], width: int) -> list[list[tuple[str | None, str]]]:
    """Cells as a column-wise type inference prints them: columns of whole numbers are int (float with a gap), of numbers float."""
    out: list[list[tuple[str | None, str]]] = [[] for _ in rows]
    for c in range(width):
        column = [r[c] if c < len(r) else None for r in rows]
        some = [x for x in column if x]
        if some and all(_INT.fullmatch(x) for x in some):
            made = [(str(int(x)), "int") if len(some) == len(column) else (repr(float(x)) if x else None, "float" if x else "none") for x in column]
        elif some and all(_FLOAT.fullmatch(x) for x in some):
            made = [(repr(float(x)), "float") if x else (None, "none") for x in column]
        elif some and len(some) == len(column) and all(x in ("True", "False", "TRUE", "FALSE", "true", "false") for x in some):
            made = [(x.capitalize(), "bool") for x in column]
        else:
            made = [(x, "str") if x else (None, "none") for x in column]
        for row, cell in zip(out, made, strict=True):
            row.append(cell)
    return out


def html_tables(page: str | None) -> list[tuple[list[list[str]], list[list[tuple[str | None, str]]]]]:
    """(headers, rows of typed cells) of each table of a page with any cell. Rows in the head, or leading rows of header cells
    only, are headers; without any, the headers are the column numbers."""
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    found = []
    for table in parser.done:
        grid = [r for r in _spread_spans(table["rows"])]
        head = table["head"]
        if not head:
            while head < len(grid) and grid[head] and all(h for _, h in grid[head]):
                head += 1
            head = min(head, max(len(grid) - 1, 0)) if head == len(grid) > 1 else head
        headers = [[t for t, _ in r] for r in grid[:head] if r]
        rows = [[t or None for t, _ in r] for r in grid[head:] if r]
        if not headers and not rows:
            continue
        width = max([len(r) for r in headers + rows])
        headers = [h + [""] * (width - len(h)) for h in headers] or [[str(i) for i in range(width)]]
        found.append((headers, typed_columns(rows, width)))
    return found


def read_html(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_file: Column | None = None, first_index: Column | None = None) -> TableSet:
    """The HTML tables of a column of pages, with spans expanded; a page's table indexes begin at ``first_index`` (0 unless given). Pages are parsed in Arrow batches, where they lie."""
    keep = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit("html") if source_file is None else source_file).alias("source_file"), F.col(text_col).alias("text"), (F.lit(0) if first_index is None else first_index).cast("int").alias("first"))
    schema = "doc_id long, source_file string, table_index int, headers array<array<string>>, rows array<array<struct<v:string,t:string>>>"
    cell = pa.struct([("v", pa.string()), ("t", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, name, page, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for i, (headers, rows) in enumerate(html_tables(page)):
                    out.append((doc_id, name, first + i, headers, [[{"v": v, "t": t} for v, t in r] for r in rows]))
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.string())), pa.list_(pa.list_(cell))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "source_file", "table_index", "headers", "rows"])

    # tables and rows are read from it: each page is parsed once
    found = hold(keep.where(has_html(F.col("text"))).mapInArrow(run, schema))
    ids = table_ids(F.col("doc_id"), F.col("table_index")).alias("table_id")
    tables = found.select(*table_columns(table_id=ids, source_file=F.col("source_file"), table_index=F.col("table_index"), extraction_method=F.lit("dataframe"), headers=F.col("headers")))
    rows = found.select(ids, F.posexplode("rows").alias("row_idx", "cells")).select("table_id", F.col("row_idx").cast("long").alias("row_idx"), "cells")
    return TableSet(tables, rows)


__all__ = ["CELL", "ROWS", "TableSet", "from_grids", "has_html", "has_markdown", "html_tables", "markdown_grids", "read_html", "read_markdown", "table_columns", "table_ids", "typed_columns"]
