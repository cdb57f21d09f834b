"""Tables of paged documents (PDF): header rows, context words, continuation over pages, and grids from detected boxes.

Pages come as DataFrames: raw grids (document, page, table, rows), lines that draw tables (see ``ruled``), words with positions, and
boxes found by a vision model. Opening the files themselves is left to a parser function that runs in Arrow batches over
``binaryFile`` rows, as no PDF library is part of Spark; so is the model."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.functions.text import strip
from tabweave.plans.shared import hold, number_rows
from tabweave.schema import TableSet
from tabweave.sources import ruled
from tabweave.sources.text_tables import as_cell, table_columns

MAX_FILE_MB = 50
MAX_PAGES = 1000
#: Words of context on each side of a table.
CONTEXT_WORDS = 50
#: A table that ends below this height (in points) was cut off by the page.
CUT_OFF = 700.0
GRID = "doc_id long, source_file string, page_number int, table_index int, bbox struct<x0:double,y0:double,x1:double,y1:double>, grid array<array<string>>"
ITEMS = "doc_id long, source_file string, page_number int, kind string, ord int, text string, x0 double, top double, x1 double, bottom double, grid array<array<string>>"
BOXES = "table_id long, image_w int, image_h int, boxes array<struct<label:string,score:double,x0:double,y0:double,x1:double,y1:double>>"

log = logging.getLogger(__name__)
#: Models that this Python process has loaded, by their loaders' names.
_models: dict[tuple[str, str], Callable] = {}


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)


def read_pages(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict]], max_file_mb: int = MAX_FILE_MB, max_pages: int = MAX_PAGES, pages: list[int] | None = None) -> DataFrame:
    """What the pages of all PDF files under a path hold (schema ITEMS), a row for each table, line and word. ``parser`` maps a file's
    bytes to its pages: dicts with page_number (from 1), and any of tables (each with bbox and grid), lines (x0, top, x1,
    bottom: rules and sides of rectangles) and words (text, x0, x1, top, bottom). Larger files, or files with more pages,
    raise an error as soon as one is met; ``pages`` are indices from 0. Files are told apart by their paths."""
    files = pdf_files(spark, path)
    if pages is None and not files.where(F.col("length") > max_file_mb * 1024 * 1024).select("path").isEmpty():
        raise ValueError(f"a file exceeds {max_file_mb} MB")
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.list_(pa.list_(pa.string()))]
    names = ["doc_id", "source_file", "page_number", "kind", "ord", "text", "x0", "top", "x1", "bottom", "grid"]

    def items(page: dict) -> Iterator[tuple]:
        for i, t in enumerate(page.get("tables", ())):
            if t["grid"]:
                yield "table", i, None, *(t.get("bbox") or (None,) * 4), t["grid"]
        for i, line in enumerate(page.get("lines", ())):
            yield "line", i, None, *line, None
        for i, w in enumerate(page.get("words", ())):
            yield "word", i, w["text"], w["x0"], w["top"], w["x1"], w["bottom"], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, path, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = parser(raw.as_py())
                if len(found) > max_pages:
                    raise ValueError(f"{path.as_py()} has {len(found)} pages, more than {max_pages}")
                for page in found:
                    if pages is not None and page["page_number"] - 1 not in pages:
                        continue
                    out = [(doc_id.as_py(), path.as_py(), page["page_number"], *x) for x in items(page)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content").mapInArrow(run, ITEMS)


def page_words(items: DataFrame) -> DataFrame:
    return items.where("kind = 'word'").select("doc_id", "source_file", "page_number", F.col("ord").alias("word_ord"), "text", "x0", "x1", "top", "bottom")


def raw_grids(items: DataFrame) -> DataFrame:
    """Raw grids (schema GRID) of the tables that the parser gives, and of those that the lines of the other pages draw."""
    page = ["doc_id", "source_file", "page_number"]
    box = F.when(F.col("x0").isNotNull(), F.struct("x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1")))
    columns = [*page, "table_index", "bbox", "grid"]
    given = items.where("kind = 'table'").withColumns({"table_index": F.col("ord"), "bbox": box}).select(columns)
    lines = items.where("kind = 'line'")
    if lines.isEmpty():
        return given
    lines = lines.join(given.select(page).distinct(), page, "left_anti")
    # a document is its hash and its path, as two paths may have one hash
    of = lambda df: df.withColumn("doc_id", F.struct("doc_id", "source_file"))
    drawn = ruled.find_tables(of(lines), of(page_words(items))).select("doc_id.doc_id", "doc_id.source_file", "page_number", "table_index", "bbox", "grid")
    return given.unionByName(drawn)


def read_pdf(spark: SparkSession, path: str, parser: Callable[[bytes], list[dict]], max_file_mb: int = MAX_FILE_MB, max_pages: int = MAX_PAGES, pages: list[int] | None = None) -> DataFrame:
    """Raw grids (schema GRID) of all PDF files under a path; see ``read_pages``."""
    return raw_grids(hold(read_pages(spark, path, parser, max_file_mb, max_pages, pages)))


def header_rows(grid: Column) -> Column:
    """How many leading rows are headers: the first, and of the next three those, without a gap, whose first cell is blank, 'from' or
    'to' (or that have no cell). 0 for an empty grid."""

    def leads(row: Column) -> Column:
        first = F.get(row, F.lit(0))
        return first.isNull() | F.lower(strip(F.coalesce(first, F.lit("")))).isin("", "from", "to")

    more = F.transform(F.slice(grid, F.lit(2), F.least(F.lit(3), F.greatest(F.size(grid) - 1, F.lit(0)))), leads)
    stop = F.array_position(more, F.lit(False))
    return F.when(F.size(grid) == 0, 0).otherwise(1 + F.when(stop > 0, stop - 1).otherwise(F.size(more))).cast("int")


def split_headers(grids: DataFrame) -> DataFrame:
    """headers and rows instead of a raw grid; missing header cells are empty."""
    n = header_rows(F.col("grid"))
    headers = F.transform(F.slice("grid", F.lit(1), n), lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    return grids.withColumns({"headers": headers, "rows": F.slice("grid", n + 1, F.greatest(F.size("grid") - n, F.lit(0)))}).drop("grid")


def context(tables: DataFrame, words: DataFrame, most: int = CONTEXT_WORDS) -> DataFrame:
    """doc_id, page_number, table_index (and source_file, if both have it), context: the last words above a table's box and the first ones
    below, joined by ' | '. words: doc_id, page_number, word_ord, text, top, bottom."""
    page = ["doc_id", *(["source_file"] if "source_file" in tables.columns and "source_file" in words.columns else []), "page_number"]
    key = [*page, "table_index"]
    near = tables.where("bbox is not null").select(*key, F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1")).join(words, page)
    above = near.where("bottom <= y0").withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("word_ord")))).withColumn("side", F.lit(0))
    below = near.where("top >= y1").withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("word_ord"))).withColumn("side", F.lit(1))
    taken = above.unionByName(below).where(F.col("nth") <= most)
    sides = taken.groupBy(*key, "side").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_ord", "text"))), lambda w: w["text"]), " ").alias("said"))
    return sides.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("side", "said"))), lambda s: s["said"]), " | ").alias("context"))


def staggered(headers: Column) -> Column:
    """Whether deeper header rows look torn: the deepest begins with from or to, or more than half of its other cells are blank."""
    deepest = F.element_at(headers, -1)
    rest = F.slice(deepest, F.lit(2), F.greatest(F.size(deepest) - 1, F.lit(0)))
    empty = F.size(F.filter(rest, lambda c: strip(c) == ""))
    torn = F.lower(strip(F.get(deepest, F.lit(0)))).isin("from", "to") | ((F.size(rest) > 0) & (empty * 2 > F.size(rest)))
    return F.when((F.size(headers) < 2) | (F.size(deepest) == 0), False).otherwise(torn)


def merge_continuations(tables: DataFrame) -> DataFrame:
    """Tables that go on over pages made one, per document in order of page and table. A table joins the one before if it is on the
    page after that one's last part, has as many columns (not none), and either repeats the headers of the chain's first part, or
    that last part was cut off by the page (then its own headers are rows). The joined table has the first part's headers, index and
    context (if there is any) and the last part's page and box. tables: doc_id, source_file, page_number, table_index, bbox, headers, rows and others.

    A chain's last part is always the table just before, so page and box are compared by a window, which cuts a document into runs of
    tables on following pages. Only headers are folded, one run at a time; rows are gathered by the table that they become."""
    width = F.when(F.size("headers") > 0, F.size(F.get("headers", F.lit(0)))).when(F.size("rows") > 0, F.size(F.get("rows", F.lit(0)))).otherwise(0)
    doc = ["doc_id", "source_file"]
    order = Window.partitionBy(*doc).orderBy("page_number", "table_index", "headers")
    t = tables.withColumns({"_n": F.row_number().over(order), "_width": width.cast("int"), "_follows": F.coalesce(F.col("page_number") == F.lag("page_number").over(order) + 1, F.lit(False)), "_cut": F.coalesce(F.lag("bbox.y1").over(order) > CUT_OFF, F.lit(False))})
    t = t.withColumn("_run", F.sum(F.when(F.col("_follows"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy(*doc, "_run").agg(F.sort_array(F.collect_list(F.struct("_n", "_width", "_cut", "headers"))).alias("t"))
    kind = "struct<headers:array<array<string>>,width:int,head:int,done:array<struct<_n:int,_head:int,_same:boolean>>>"

    def step(now: Column, x: Column) -> Column:
        same = (F.size(now["headers"]) > 0) & (F.size(x["headers"]) > 0) & (now["headers"] == x["headers"])
        joins = F.coalesce(now["head"].isNotNull() & (now["width"] == x["_width"]) & (x["_width"] > 0) & (same | x["_cut"]), F.lit(False))
        head = F.when(joins, now["head"]).otherwise(x["_n"])
        mine = F.struct(x["_n"].alias("_n"), head.alias("_head"), F.coalesce(~joins | same, F.lit(True)).alias("_same"))
        return F.struct(F.when(joins, now["headers"]).otherwise(x["headers"]).alias("headers"), F.when(joins, now["width"]).otherwise(x["_width"]).alias("width"), head.alias("head"), F.concat(now["done"], F.array(mine)).alias("done")).cast(kind)

    none = F.struct(F.lit(None).alias("headers"), F.lit(None).alias("width"), F.lit(None).alias("head"), F.array().alias("done")).cast(kind)
    placed = runs.select(*doc, F.explode(F.aggregate("t", none, step)["done"]).alias("x")).select(*doc, "x.*")
    parts = t.withColumn("_doc", F.struct(*doc)).join(placed.select(F.struct(*doc).alias("_doc"), "_n", "_head", "_same"), ["_doc", "_n"]).withColumn("_said", F.when(F.col("_same"), F.col("rows")).otherwise(F.concat("headers", "rows")))
    first = lambda c: F.min_by(c, "_n").alias(c)
    last = lambda c: F.max_by(c, "_n").alias(c)
    rows = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_said"))), lambda x: x["_said"])).alias("rows")
    said = [first("context")] if "context" in tables.columns else []
    return parts.groupBy(*doc, "_head").agg(last("page_number"), first("table_index"), first("headers"), rows, last("bbox"), *said).drop("_head")


def to_table_set(tables: DataFrame, contexts: DataFrame | None = None, method: str = "pdf") -> TableSet:
    """A TableSet from split (and merged) tables. Their ids are numbers from 0 in the order of source, page and place, so that no two
    tables share one, however many pages, tables or files there are. ``contexts`` may be joined here, or be a column."""
    if contexts is not None:
        tables = tables.join(contexts, ["doc_id", "page_number", "table_index"], "left")
    said = F.coalesce(F.col("context"), F.lit("")) if "context" in tables.columns else F.lit(None)
    numbered = hold(number_rows(tables, [F.col(c) for c in ("source_file", "doc_id", "page_number", "table_index")], "table_id"))
    made = numbered.select(*table_columns(table_id=F.col("table_id"), source_file=F.col("source_file"), page_number=F.col("page_number"), table_index=F.col("table_index"), extraction_method=F.lit(method), bbox=F.col("bbox"), context=said, headers=F.col("headers")))
    rows = numbered.select("table_id", F.posexplode("rows").alias("row_idx", "r")).select("table_id", F.col("row_idx").cast("long").alias("row_idx"), F.transform("r", as_cell).cast("array<struct<v:string,t:string>>").alias("cells"))
    return TableSet(made, rows)


def _cells_of_words() -> Callable[[Column, Column, Column], Column]:
    """A function of a table's row boxes, column boxes (structs x0, y0, x1, y1) and words' centres (structs mx, my), all lists of doubles: for each
    row and each column the places in their list of the words that lie in both, ends included. The tables of a batch are done together. A
    table's span is cut into as many bins as it has boxes, so a word is compared with the few boxes that reach into its bin."""

    def each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For counts a, b, ...: 0 a times, 1 b times, ... and beside it 0 to a - 1, 0 to b - 1, ..."""
        of = np.repeat(np.arange(len(counts)), counts)
        return of, np.arange(len(of)) - (np.cumsum(counts) - counts)[of]

    def flat(a: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        one = a.flatten()
        return pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64), [one.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(one.type.num_fields)]

    def inside(n_boxes: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word and a box of its table with lo <= at <= hi, in order of words. What is null or NaN lies nowhere and holds nothing."""
        table, _ = each(n_boxes)
        use, own = np.flatnonzero(lo <= hi), each(n_words)[0]
        least, most = np.full(len(n_boxes), np.inf), np.full(len(n_boxes), -np.inf)
        np.minimum.at(least, table[use], lo[use])
        np.maximum.at(most, table[use], hi[use])
        side = (most - least) / np.maximum(n_boxes, 1)
        side[~(side > 0)] = 1.0
        first = np.cumsum(n_boxes + 1) - (n_boxes + 1)
        # 0 to n_boxes; a bin never falls as x grows, and spans without end are one bin
        nth = lambda x, t: first[t] + np.clip(np.nan_to_num((x - least[t]) / side[t]), 0, n_boxes[t]).astype(np.int64)
        begin = nth(lo[use], table[use])
        i, step = each(nth(hi[use], table[use]) - begin + 1)
        order = np.argsort(begin[i] + step, kind="stable")
        boxes, bins = use[i][order], (begin[i] + step)[order]
        asked = nth(at, own)
        left = np.searchsorted(bins, asked, "left")
        word, k = each(np.searchsorted(bins, asked, "right") - left)
        box = boxes[left[word] + k]
        held = (lo[box] <= at[word]) & (at[word] <= hi[box])
        return word[held], box[held]

    def place(rows: pa.Array, cols: pa.Array, words: pa.Array) -> pa.Array:
        (n_rows, (rx0, ry0, rx1, ry1)), (n_cols, (cx0, cy0, cx1, cy1)), (n_words, (mx, my)) = flat(rows), flat(cols), flat(words)
        with np.errstate(all="ignore"):
            w, row = inside(n_rows, ry0, ry1, n_words, my)
            v, col = inside(n_cols, cx0, cx1, n_words, mx)
        # boxes may be askew: the row's sides and the column's ends hold too
        own_row, own_col = (rx0[row] <= mx[w]) & (mx[w] <= rx1[row]), (cy0[col] <= my[v]) & (my[v] <= cy1[col])
        w, row, v, col = w[own_row], row[own_row], v[own_col], col[own_col]
        left = np.searchsorted(v, w, "left")
        i, k = each(np.searchsorted(v, w, "right") - left)
        table, nth = each(n_words)
        w, col = w[i], col[left[i] + k]
        starts = np.cumsum(n_rows * n_cols) - n_rows * n_cols
        ahead_r, ahead_c = np.cumsum(n_rows) - n_rows, np.cumsum(n_cols) - n_cols
        t = table[w]
        cell = starts[t] + (row[i] - ahead_r[t]) * n_cols[t] + col - ahead_c[t]
        ends = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        found = pa.array(nth[w][np.argsort(cell, kind="stable")], pa.int32())
        cells = pa.ListArray.from_arrays(ends(np.bincount(cell, minlength=int((n_rows * n_cols).sum()))), found)
        return pa.ListArray.from_arrays(ends(n_rows), pa.ListArray.from_arrays(ends(np.repeat(n_cols, n_rows)), cells))

    place.__annotations__ = {"rows": pa.Array, "cols": pa.Array, "words": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "array<array<array<int>>>")


def grids_from_boxes(boxes: DataFrame, words: DataFrame, frames: DataFrame, min_score: float = 0.5) -> DataFrame:
    """table_id, headers, rows rebuilt from detected boxes and the words inside them; tables without a row or a column box are left out.

    boxes: table_id, label ('table row', 'table column', 'table column header', others ignored), score, x0, y0, x1, y1 in pixels.
    words: table_id, word_ord, text, x0, x1, top, bottom in points. frames: table_id, x0, y0, x1, y1 in points, image_w, image_h.
    A word belongs to the cells (a row box cut with a column box) that hold its centre; a cell's words are joined in their order. Rows
    whose middle lies in a header box are headers; without any, the first row is.

    A table (what is seen in one picture) is a bounded group: its boxes and its words each become one row, and these two meet once with its
    frame; no pairs of words, boxes or cells are shuffled or stored."""
    corner = ["x0", "y0", "x1", "y1"]
    kinds = {"_rows": "table row", "_cols": "table column", "_heads": "table column header"}
    of = lambda kind: F.collect_list(F.when(F.col("label") == kind, F.struct(*corner)))
    found = boxes.where((F.col("score") >= min_score) & F.col("label").isin(*kinds.values())).groupBy("table_id").agg(*[of(kind).alias(k) for k, kind in kinds.items()])
    found = found.where((F.size("_rows") > 0) & (F.size("_cols") > 0))
    f = frames.select("table_id", *[F.col(k).alias(f"f{k}") for k in corner], "image_w", "image_h")
    sx, sy = (F.col("fx1") - F.col("fx0")) / F.col("image_w"), (F.col("fy1") - F.col("fy0")) / F.col("image_h")
    scaled = lambda b: [(F.col("fx0") + b["x0"] * sx).alias("x0"), (F.col("fy0") + b["y0"] * sy).alias("y0"), (F.col("fx0") + b["x1"] * sx).alias("x1"), (F.col("fy0") + b["y1"] * sy).alias("y1")]
    # in order of the place in the picture
    lain = lambda c, by: F.sort_array(F.transform(c, lambda b: F.struct(b[by].alias("by"), *scaled(b))))
    placed = found.join(f, "table_id").select("table_id", lain("_rows", "y0").alias("_rows"), lain("_cols", "x0").alias("_cols"), lain("_heads", "y0").alias("_heads"))
    at = F.struct("word_ord", "text", ((F.col("x0") + F.col("x1")) / 2).cast("double").alias("mx"), ((F.col("top") + F.col("bottom")) / 2).cast("double").alias("my"))
    said = words.groupBy("table_id").agg(F.sort_array(F.collect_list(at)).alias("_words"))
    full = placed.join(said, "table_id", "left")
    box = lambda c: F.transform(c, lambda b: F.struct(*[b[k].cast("double").alias(k) for k in corner]))
    centres = F.transform(F.coalesce("_words", F.array()), lambda w: F.struct(w["mx"].alias("mx"), w["my"].alias("my"))).cast("array<struct<mx:double,my:double>>")
    full = full.select("table_id", "_rows", "_heads", "_words", _cells_of_words()(box("_rows"), box("_cols"), centres).alias("_cells"))
    middle = lambda r: (r["y0"] + r["y1"]) / 2
    is_head = F.transform("_rows", lambda r: F.coalesce(F.exists("_heads", lambda h: (h["y0"] <= middle(r)) & (middle(r) <= h["y1"])), F.lit(False)))
    text = lambda c: F.array_join(F.transform(c, lambda i: F.get("_words", i)["text"]), " ")
    grids = full.select("table_id", is_head.alias("_is_head"), F.transform("_cells", lambda r: F.transform(F.transform(r, text), strip)).alias("_grid"))
    headed = F.exists("_is_head", lambda h: h)
    heads = lambda i: F.when(headed, F.get("_is_head", i)).otherwise(i == 0)
    return grids.select("table_id", F.filter("_grid", lambda r, i: heads(i)).alias("headers"), F.filter("_grid", lambda r, i: ~heads(i)).alias("rows"))


def refine(tables: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Staggered tables with a box take their rebuilt headers and rows, if there are any rows; the others stay as they are.
    Both need table_id, headers, rows."""
    new = rebuilt.where(F.size("rows") > 0).select("table_id", F.col("headers").alias("_h"), F.col("rows").alias("_r"))
    use = staggered(F.col("headers")) & F.col("bbox").isNotNull() & F.col("_r").isNotNull()
    joined = tables.join(new, "table_id", "left")
    return joined.withColumns({"rows": F.when(use, F.col("_r")).otherwise(F.col("rows")), "headers": F.when(use, F.col("_h")).otherwise(F.col("headers"))}).drop("_h", "_r")


def detect(tables: DataFrame, files: DataFrame, load: Callable[[], Callable]) -> DataFrame:
    """Boxes (schema BOXES) that a vision model finds in tables (table_id, source_file, page_number, bbox). ``load`` makes a function of
    a file's bytes, the page number and the box, which gives (image width, image height, boxes), a box as a dict with label,
    score, x0, y0, x1, y1 in pixels. It is called once in a Python worker, and each file is read once for all its tables. A
    table for which the function fails has no row. files: path, content."""
    asked = tables.groupBy(F.col("source_file").alias("path")).agg(F.collect_list(F.struct("table_id", "page_number", "bbox")).alias("asked"))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("label", pa.string()), *[(k, pa.float64()) for k in ("score", "x0", "y0", "x1", "y1")]]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, asked in zip(batch.column(0), batch.column(1), strict=True):
                for t in asked.as_py():
                    try:
                        name = (load.__module__, load.__qualname__)
                        if name not in _models:
                            _models[name] = load()
                        w, h, boxes = _models[name](content.as_py(), t["page_number"], tuple(t["bbox"][k] for k in ("x0", "y0", "x1", "y1")))
                        row = [pa.array([x], kind) for x, kind in zip((t["table_id"], w, h, list(boxes)), types, strict=True)]
                    except Exception as e:  # noqa: BLE001  whatever a model raises, the table stays as it is
                        log.warning("no boxes for table %s: %s", t["table_id"], e)
                        continue
                    yield pa.RecordBatch.from_arrays(row, names=["table_id", "image_w", "image_h", "boxes"])

    return files.select("path", "content").join(asked, "path").select("content", "asked").mapInArrow(run, BOXES)


def refine_staggered(tables: DataFrame, words: DataFrame, files: DataFrame, load: Callable[[], Callable], min_score: float = 0.5) -> DataFrame:
    """Split tables, of which the staggered ones with a box are rebuilt from what a model finds in them; they stay as they are where it
    finds nothing or fails. files: path, content; they are read again if there is such a table."""
    # the ids are stored, so that all that follows reads the same ones
    held = hold(tables.withColumn("table_id", F.monotonically_increasing_id()))
    torn = held.where(staggered(F.col("headers")) & F.col("bbox").isNotNull())
    if torn.isEmpty():
        return tables
    found = hold(detect(torn.select("table_id", "source_file", "page_number", "bbox"), files, load))
    frames = found.join(torn, "table_id").select("table_id", "doc_id", "source_file", "page_number", *[F.col("bbox")[k].alias(k) for k in ("x0", "y0", "x1", "y1")], "image_w", "image_h")
    boxes = found.select("table_id", F.explode("boxes").alias("b")).select("table_id", "b.*")
    own = frames.select("table_id", "doc_id", "source_file", "page_number").join(words, ["doc_id", "source_file", "page_number"]).select("table_id", "word_ord", "text", "x0", "x1", "top", "bottom")
    return refine(held, grids_from_boxes(boxes, own, frames.drop("doc_id", "source_file", "page_number"), min_score)).drop("table_id")
