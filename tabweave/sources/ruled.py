"""Tables drawn with rules: from the line segments and words of a page to raw grids, all pages in one job.

1. Segments are horizontal or vertical edges; parallel ones closer than SNAP take their mean position, and collinear
   ones whose ends are closer than JOIN become one.
2. Horizontal and vertical edges of a page cross in points.
3. A cell is the smallest rectangle below and right of a crossing whose corners are crossings and whose sides lie on edges. For two
   horizontal edges, the verticals that cross both stand in order, and neighbours enclose a candidate; of a corner's candidates the
   lowest, then the narrowest, is taken. Rules that stop inside a row or column so leave merged cells; a side without a rule
   leaves the cell open, and out.
4. Cells that share a corner are one table; a lone cell is none. Tables are numbered by their top left corner.
5. A word is in the cell that holds its centre; words meet cells in bins of the height. The grid has a row for each top edge and a
   column for each left edge; places that a merged cell covers are null, cells without words are empty.

A page is a bounded group (its edges are more than SNAP apart), documents and corpora are not, and no step gathers more
than a page's edges. Cases: slanted segments and those shorter than MIN_LENGTH are left out, and rows with nulls as well. Repeated segments
change nothing. Pages without cells have no tables; words outside all cells are ignored."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP = JOIN = CROSS = 3.0
MIN_LENGTH = 3.0
#: Height of the bins, in points, in which words meet cells.
WORD_BIN = 16.0
#: Words whose tops differ by more stand on different lines.
LINE_GAP = 3.0
PAGE = ["doc_id", "page_number"]


def edges(segments: DataFrame, snap: float = SNAP, gap: float = JOIN) -> DataFrame:
    """doc_id, page_number, upright, at (its x or y), start, end of the merged edges. segments: doc_id, page_number, x0, top, x1, bottom.

    Rows are dealt by page once; what follows, here and in ``find_tables``, is grouped by page and more, and so stays where it is."""
    lo, hi = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    upright = F.abs(F.col("x1") - F.col("x0")) < F.abs(F.col("bottom") - F.col("top"))
    thick = F.when(upright, F.abs(F.col("x1") - F.col("x0"))).otherwise(F.abs(F.col("bottom") - F.col("top")))
    s = segments.where(thick <= snap).select(
        *PAGE,
        upright.alias("upright"),
        F.when(upright, (F.col("x0") + F.col("x1")) / 2).otherwise((F.col("top") + F.col("bottom")) / 2).alias("at"),
        F.when(upright, lo("top", "bottom")).otherwise(lo("x0", "x1")).alias("start"),
        F.when(upright, hi("top", "bottom")).otherwise(hi("x0", "x1")).alias("end"),
    )
    near = Window.partitionBy(*PAGE).orderBy("upright", "at", "start", "end")
    before = lambda c: F.lag(c).over(near)
    beside = (before("upright") == F.col("upright")) & (F.col("at") - before("at") <= snap)
    again = F.coalesce((before("upright") == F.col("upright")) & (before("at") == F.col("at")) & (before("start") == F.col("start")) & (before("end") == F.col("end")), F.lit(False))
    s = s.withColumns({"new": F.when(beside, 0).otherwise(1), "again": again})
    s = s.withColumn("line", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0))).where("not again")
    line = Window.partitionBy(*PAGE, "line")
    along = line.orderBy("start", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("piece", F.when(F.col("start") <= reached + gap, 0).otherwise(1))
    s = s.withColumn("piece", F.sum("piece").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("at", F.round(F.avg("at").over(line), 6))
    merged = s.groupBy(*PAGE, "line", "piece").agg(F.first("upright").alias("upright"), F.first("at").alias("at"), F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.where(F.col("end") - F.col("start") >= MIN_LENGTH).drop("line", "piece")


def _points_of_pages(merged: DataFrame, reach: float = CROSS) -> DataFrame:
    """doc_id, page_number, points: the crossings of a page's edges as structs (v, h) of structs (at, start, end)."""
    edge = F.struct("at", "start", "end")
    both = merged.groupBy(*PAGE).agg(F.collect_list(F.when(F.col("upright"), edge)).alias("vs"), F.collect_list(F.when(~F.col("upright"), edge)).alias("hs"))
    meet = lambda v, h: (h["at"] >= v["start"] - reach) & (h["at"] <= v["end"] + reach) & (v["at"] >= h["start"] - reach) & (v["at"] <= h["end"] + reach)
    of_h = lambda h: F.transform(F.filter("vs", lambda v: meet(v, h)), lambda v: F.struct(v.alias("v"), h.alias("h")))
    return both.select(*PAGE, F.flatten(F.transform("hs", of_h)).alias("points")).dropna(subset=PAGE)


def crossings(merged: DataFrame, reach: float = CROSS) -> DataFrame:
    """doc_id, page_number, v, h: the edges that cross, as structs (at, start, end)."""
    return _points_of_pages(merged, reach).select(*PAGE, F.explode("points").alias("p")).select(*PAGE, "p.v", "p.h")


def _page_reader(what: str) -> Callable[[Column, Column], Column]:
    """A function of a page's points and of the centres (mx, my) of its words, which are looked up in bins of the page's height.

    what: 'cells' for x0, top, x1, bottom of the cells; 'tables' for x0, y0, x1, y1, grid of the tables in order, a grid's places being
    lists of words, by number, or null where no cell begins."""

    def cells_of(points: list[tuple]) -> list[tuple]:
        across: dict[tuple, list] = {}
        down: dict[tuple, list] = {}
        for x, v, y, h in sorted(points):
            across.setdefault((y, h), []).append((x, v))
            down.setdefault((x, v), []).append((y, h))
        on = {h: set(vs) for h, vs in across.items()}
        found = []
        for h, vs in across.items():
            for i, v in enumerate(vs[:-1]):
                to, below = None, down[v]
                for k in range(bisect.bisect_right(below, (h[0], math.inf)), len(below)):
                    h2 = below[k]
                    if to and h2[0] > to[0]:
                        break
                    x1 = next((u[0] for u in itertools.islice(vs, i + 1, None) if u in on[h2] and u[0] > v[0]), None)
                    if x1 is not None:
                        to = min(to or (h2[0], x1), (h2[0], x1))
                if to:
                    found.append((v[0], h[0], to[1], to[0]))
        return list(dict.fromkeys(found))

    def grids_of(cells: list[tuple], words: list[tuple]) -> list[dict]:
        root = list(range(len(cells)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        corner: dict[tuple, int] = {}
        for i, (x0, top, x1, bottom) in enumerate(cells):
            for at in ((x0, top), (x1, top), (x0, bottom), (x1, bottom)):
                root[find(i)] = find(corner.setdefault(at, i))
        many: dict[int, list[tuple]] = {}
        for i, c in enumerate(cells):
            many.setdefault(find(i), []).append(c)
        drawn = sorted((c for c in many.values() if len(c) > 1), key=lambda t: min((c[1], c[0]) for c in t))
        bins: dict[int, list[tuple]] = {}
        places: list[dict] = [{} for _ in drawn]
        for said, t in zip(places, drawn, strict=True):
            for x0, top, x1, bottom in t:
                here = said.setdefault((top, x0), {})
                for b in range(int(top // WORD_BIN), int(bottom // WORD_BIN) + 1):
                    bins.setdefault(b, []).append((x0, top, x1, bottom, here))
        for i, (x, y) in enumerate(words):
            if x == x and y == y:
                for x0, top, x1, bottom, here in bins.get(y // WORD_BIN, ()):
                    if x0 <= x < x1 and top <= y < bottom:
                        here[i] = None
        made = []
        for said, t in zip(places, drawn, strict=True):
            lefts, tops = sorted({c[0] for c in t}), sorted({c[1] for c in t})
            grid = [[None if (here := said.get((y, x))) is None else list(here) for x in lefts] for y in tops]
            made.append({"x0": lefts[0], "y0": tops[0], "x1": max(c[2] for c in t), "y1": max(c[3] for c in t), "grid": grid})
        return made

    def rows(a: pa.Array) -> list[list[tuple]]:
        flat = a.flatten()
        at = list(zip(*(flat.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(flat.type.num_fields)), strict=True))
        ends = [0, *itertools.accumulate(n or 0 for n in pc.list_value_length(a).to_pylist())]
        return [at[i:j] for i, j in itertools.pairwise(ends)]

    box = ["x0", "top", "x1", "bottom"]
    as_cells = pa.list_(pa.struct([(k, pa.float64()) for k in box]))
    as_tables = pa.list_(pa.struct([*[(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")], ("grid", pa.list_(pa.list_(pa.list_(pa.int32()))))]))

    if what == "cells":
        kind = "array<struct<x0:double,top:double,x1:double,bottom:double>>"

        def read(points: pa.Array, words: pa.Array) -> pa.Array:
            return pa.array([[dict(zip(box, c, strict=True)) for c in cells_of(p)] for p in rows(points)], as_cells)

    else:
        kind = "array<struct<x0:double,y0:double,x1:double,y1:double,grid:array<array<array<int>>>>>"

        def read(points: pa.Array, words: pa.Array) -> pa.Array:
            return pa.array([grids_of(cells_of(p), w) for p, w in zip(rows(points), rows(words), strict=True)], as_tables)

    read.__annotations__ = {"points": pa.Array, "words": pa.Array, "return": pa.Array}
    return F.arrow_udf(read, kind)


def _read(what: str, points: str, words: Column) -> Column:
    ids = F.transform(points, lambda p: F.struct(p["v"]["at"].alias("x"), p["v"]["start"].alias("v"), p["h"]["at"].alias("y"), p["h"]["start"].alias("h")))
    return _page_reader(what)(ids, words)


def cells(points: DataFrame) -> DataFrame:
    """doc_id, page_number, x0, top, x1, bottom of the cells between crossings."""
    pages = points.groupBy(*PAGE).agg(F.collect_list(F.struct("v", "h")).alias("points"))
    none = F.array().cast("array<struct<mx:double,my:double>>")
    return pages.select(*PAGE, F.explode(_read("cells", "points", none)).alias("c")).select(*PAGE, "c.*")


def _said(words: Column) -> Column:
    """Words in order; a blank between those of a line, a line feed between lines."""

    def one(text: Column, w: Column) -> Column:
        sep = F.when(text["s"] == "", "").when(F.abs(w["top"] - text["top"]) > LINE_GAP, "\n").otherwise(" ")
        return F.struct(F.concat(text["s"], sep, w["text"]).alias("s"), w["top"].alias("top"))

    return F.aggregate(F.array_sort(words), F.struct(F.lit("").alias("s"), F.lit(0.0).alias("top")), one, lambda t: t["s"])


def find_tables(segments: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page_number, table_index, bbox, grid of the ruled tables. words: doc_id, page_number, word_ord, text, x0, x1, top, bottom.

    A page's edges and words each become one row, and these two meet once; nothing else of a page is moved or stored."""
    centre = [((F.col(a) + F.col(b)) / 2).cast("double").alias(c) for a, b, c in (("x0", "x1", "mx"), ("top", "bottom", "my"))]
    said = words.groupBy(*PAGE).agg(F.collect_list(F.struct("word_ord", F.col("top").cast("double").alias("top"), "text", *centre)).alias("words"))
    pages = _points_of_pages(edges(segments)).where(F.size("points") > 0).join(said, PAGE, "left")
    at = F.transform(F.coalesce("words", F.array()), lambda w: F.struct(w["mx"].alias("mx"), w["my"].alias("my"))).cast("array<struct<mx:double,my:double>>")
    found = pages.select(*PAGE, "words", _read("tables", "points", at).alias("tables"))
    own = lambda i: F.get("words", i)
    many = lambda c: F.when(F.size(c) == 0, "").when(F.size(c) == 1, own(F.get(c, F.lit(0)))["text"]).otherwise(_said(F.transform(c, own)))
    text = lambda c: F.when(c.isNotNull(), F.coalesce(many(c), F.lit("")))
    made = F.transform("tables", lambda t: F.struct(F.struct(*[t[k].alias(k) for k in ("x0", "y0", "x1", "y1")]).alias("bbox"), F.transform(t["grid"], lambda r: F.transform(r, text)).alias("grid")))
    return found.select(*PAGE, F.posexplode(made).alias("table_index", "t")).select(*PAGE, "table_index", "t.bbox", "t.grid")
