"""Readers, text functions and the stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabweave.functions.text import float_repr, python_float, squeeze, strip, tokens, two_places
from tabweave.plans import api
from tabweave.sources import grids, pages, ruled, text_tables
from tabweave.streaming import ingest


def cells(ts):
    out = {}
    for r in ts.rows.orderBy("table_id", "row_idx").collect():
        out.setdefault(r.table_id, []).append([c.v for c in r["cells"]])
    return out


def test_text_functions(spark):
    floats = [0.1, 1e7, 1e16, 1e-5, 1e-4, 123456789.125, -2.5e-7, 1.5e300, 0.0, float("inf"), float("nan"), 100.0, -1e15]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in floats], "x double").select(float_repr(F.col("x"))).collect()]
    assert got == [repr(x) for x in floats]
    texts = ["1_000", "1d", "nan", "-inf", " 12.5 ", "1e3", ".5", "5.", "", "1__0", "0x1", "Infinity", "abc"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(python_float(F.col("x"))).collect()]

    def real(x):
        try:
            return float(x)
        except ValueError:
            return None

    assert [repr(x) for x in got] == [repr(real(x)) for x in texts]
    blanks = ["　 a\x1c b\xa0", "\n", "x", " a  b "]
    got = spark.createDataFrame([(x,) for x in blanks], "x string").select(strip(F.col("x")).alias("s"), squeeze(F.col("x")).alias("q")).collect()
    assert [(r.s, r.q) for r in got] == [(x.strip(), " ".join(x.split())) for x in blanks]
    row = spark.range(1).select(tokens(F.lit("What is the Q1-2024 Revenue of x?")), two_places(F.lit(0.125)), two_places(F.lit(2 / 3))).first()
    assert tuple(row) == (["q1", "2024", "revenue"], "0.12", "0.67")


def test_markdown(spark):
    text = "intro\n  | Name | Age |\n  |---|:-:|\n  | Ann | 30 |\n  |  |  |\n no pipes\na | b\n| c | d |\n"
    docs = spark.createDataFrame([(3, text), (4, None), (5, "no table"), (6, "|")], "doc_id long, text string")
    got = text_tables.read_markdown(docs)
    heads = {r.table_id: r.headers for r in got.tables.collect()}
    room = text_tables.ROOM
    assert heads == {3 * room: [["Name", "Age"]], 3 * room + 1: [["c", "d"]]}
    assert cells(got) == {3 * room: [["Ann", "30"]]}


def test_html(spark):
    page = "<TABLE><thead><tr><th>A<th colspan=2>B &amp; C</tr></thead><tr><td rowspan='2'>1</td><td>x</td><td>2.5</td></tr><tr><td>y</td><td></td></tr></TABLE><table><tr><td>only</td></tr></table><table></table>"
    got = text_tables.read_html(spark.createDataFrame([(0, page), (1, None)], "doc_id long, text string"))
    assert {r.table_id: r.headers for r in got.tables.collect()} == {0: [["A", "B & C", "B & C"]], 1: [["0"]]}
    assert cells(got) == {0: [["1", "x", "2.5"], ["1", "y", None]], 1: [["only"]]}
    assert [c.t for c in got.rows.orderBy("table_id", "row_idx").first()["cells"]] == ["int", "str", "float"]


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,score,gap,flag\n007,"x, y",1.50,1,True\n8,,2,NA,False\n')
    (tmp_path / "a.tsv").write_text("k\tv\na\t1\n")
    ts = api.extract_tables(spark, str(tmp_path / "a.csv"), api.PipelineConfig(normalizer_chain=[]))
    assert cells(ts) == {0: [["7", "x, y", "1.5", "1.0", "True"], ["8", None, "2.0", None, "False"]]}
    assert ts.tables.first().headers == [["id", "name", "score", "gap", "flag"]]
    assert cells(api.extract_tables(spark, str(tmp_path / "a.tsv"))) == {0: [["a", "1"]]}


def test_quoted_line_feeds_and_their_row_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,said\n1,"one\ntwo"\n2,"a ""b"""\n3,last\n')
    ts = api.extract_tables(spark, str(tmp_path / "a.csv"), api.PipelineConfig(normalizer_chain=[]))
    assert cells(ts) == {0: [["1", "one\ntwo"], ["2", 'a "b"'], ["3", "last"]]}


def test_a_spark_frame_keeps_its_order(spark):
    df = spark.range(0, 400, 1, 5).orderBy(F.desc("id")).select((F.col("id") % 7).alias("a"), "id")
    got = cells(api.extract_tables(spark, df, api.PipelineConfig(normalizer_chain=[])))
    assert got == {0: [[str(i % 7), str(i)] for i in range(399, -1, -1)]}


def test_rows_without_numbers(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    with_numbers, without = (grids.from_spark(df, ["a"], 4, "t", numbered=n) for n in (True, False))
    assert without.rows.select("row_idx").distinct().first()[0] is None
    from tabweave.operators import classify

    assert classify.classify(with_numbers).collect() == classify.classify(without).collect()


def test_tables_of_documents_with_both_kinds(spark):
    both = "| a | b |\n|---|---|\n| 1 | 2 |\n\n<table><tr><th>x</th></tr><tr><td>y</td></tr></table>"
    docs = spark.createDataFrame([(1, both), (2, "<p>a | b</p><table><tr><td>z</td></tr></table>"), (3, "| k |\n|---|\n| v |"), (4, None)], "doc_id long, text string")
    got = ingest.tables_of(docs)
    room = text_tables.ROOM
    assert cells(got) == {room: [["1", "2"]], room + 1: [["y"]], 2 * room: [["z"]], 3 * room: [["v"]]}
    assert got.tables.count() == 4


def merged_by_hand(tables):
    """The tables of one document, one after the other."""
    done = []
    for t in sorted(tables, key=lambda t: (t["page_number"], t["table_index"])):
        last = done[-1] if done else None
        wide = lambda x: len(x["headers"][0]) if x["headers"] else len(x["rows"][0]) if x["rows"] else 0
        if last and t["page_number"] == last["page_number"] + 1 and wide(t) == wide(last) > 0:
            same = bool(last["headers"]) and last["headers"] == t["headers"]
            if same or (last["y1"] or 0) > pages.CUT_OFF:
                last["rows"] += t["rows"] if same else t["headers"] + t["rows"]
                last["page_number"], last["y1"] = t["page_number"], t["y1"]
                continue
        done.append({**t, "rows": list(t["rows"])})
    return [(t["page_number"], t["table_index"], t["headers"], t["rows"]) for t in done]


@pytest.mark.parametrize("seed", [1, 2])
def test_continuations_equal_a_plain_loop(spark, seed):
    import random

    rnd = random.Random(seed)
    docs = {}
    for d in range(30):
        page, made = 1, []
        for i in range(rnd.randrange(9)):
            page += rnd.choice([0, 1, 1, 1, 2])
            head = rnd.choice([[["a", "b"]], [["a", "b"]], [["c", "d"]], [["x"]], []])
            made.append({"page_number": page, "table_index": i, "headers": head, "rows": [[f"{d}.{i}.{k}", "v"] for k in range(rnd.randrange(3))], "y1": rnd.choice([300.0, 750.0, None])})
        docs[d] = made
    rows = [(d, "f", t["page_number"], t["table_index"], None if t["y1"] is None else (0.0, 0.0, 1.0, t["y1"]), t["headers"], t["rows"]) for d, made in docs.items() for t in made]
    frame = spark.createDataFrame(rows, "doc_id long, source_file string, page_number int, table_index int, bbox struct<x0:double,y0:double,x1:double,y1:double>, headers array<array<string>>, rows array<array<string>>")
    got = {}
    for r in pages.merge_continuations(frame).orderBy("doc_id", "page_number", "table_index").collect():
        got.setdefault(r.doc_id, []).append((r.page_number, r.table_index, r.headers, r["rows"]))
    assert got == {d: sorted(merged_by_hand(made), key=lambda t: t[:2]) for d, made in docs.items() if made}


def test_large_grid_is_numbered_in_order(spark):
    df = spark.range(0, 5000, 1, 7).select((4999 - F.col("id")).alias("k"), (F.col("id") / 2).alias("v"))
    ts = grids.from_spark(df, ["k"])
    got = [(r.row_idx, r["cells"][0].v) for r in ts.rows.collect()]
    assert sorted(got) == [(i, str(i)) for i in range(5000)]
    assert ts.header_cells().count() == 2


def test_header_rows(spark):
    grids_ = [[["a", "b"]], [["a"], ["", "x"], ["From"], [None], ["", "never"]], [["a"], ["b"], [""]], []]
    got = spark.createDataFrame([(i, g) for i, g in enumerate(grids_)], "i long, grid array<array<string>>").select("i", pages.header_rows(F.col("grid")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [1, 4, 1, 0]


def test_pdf_parser_plug_in(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one")
    head = ["Name", "Age"]

    def parser(raw):
        return [{"page_number": p, "tables": [{"bbox": (0, 0, 100, 750), "grid": [head, [f"n{p}", str(p)]]}]} for p in (1, 2)]

    config = api.PipelineConfig(pdf_parser=parser, normalizer_chain=["whitespace"])
    ts = api.extract_tables(spark, str(tmp_path / "x.pdf"), config)
    assert cells(ts) == {ts.tables.first().table_id: [["n1", "1"], ["n2", "2"]]} and ts.tables.first().page_number == 2
    with pytest.raises(Exception, match="more than 1"):
        api.extract_tables(spark, str(tmp_path / "x.pdf"), api.PipelineConfig(pdf_parser=parser, max_pages=1)).rows.collect()
    with pytest.raises(ValueError):
        api.extract_tables(spark, str(tmp_path / "x.pdf"))


SEGMENTS = "doc_id long, page_number int, x0 double, top double, x1 double, bottom double"
WORDS = "doc_id long, page_number int, word_ord long, text string, x0 double, x1 double, top double, bottom double"


def across(y, x0, x1, page=1):
    return (1, page, float(x0), float(y), float(x1), float(y))


def down(x, y0, y1, page=1):
    return (1, page, float(x), float(y0), float(x), float(y1))


def at(n, text, x, y, page=1):
    return (1, page, n, text, x - 5.0, x + 5.0, y - 4.0, y + 4.0)


def test_ruled_tables_with_merged_and_open_cells(spark):
    # a header over two columns, a cell over two rows, a side that is missing, pieces of rules, rules a little askew
    segments = [across(0, 0, 300), across(20, 0, 150), across(21, 149, 300), across(40, 100, 300), across(60, 0, 180), across(60, 182, 300), across(40, 300, 400)]
    segments += [down(0, 0, 60), down(100, 0, 60), down(200.5, 20, 60), down(199.5, 22, 60), down(300, 0, 60)]
    segments += [across(200, 0, 50), across(220, 0, 50), down(0, 200, 220), down(50, 200, 220)]  # a lone cell
    segments += [across(y, 0, 50) for y in (300, 310, 320)] + [down(0, 300, 320), down(50, 300, 320)]
    segments += [(1, 1, 0.0, 0.0, 90.0, 90.0), across(30, 10, 11), (1, 1, None, 1.0, 2.0, 1.0)]  # slanted, short, broken
    segments += [across(y, 0, 50, 2) for y in (0, 30)] + [down(x, 0, 30, 2) for x in (0, 25, 50)]
    words = [at(0, "A", 15, 10), at(1, "Head", 130, 10), at(2, "er", 165, 10), at(3, "tall", 20, 30), at(4, "cell", 20, 50), at(5, "b", 115, 30), at(6, "c", 215, 30), at(7, "d", 115, 50), at(8, "out", 315, 50), at(9, "second", 15, 305), at(0, "p2", 30, 15, 2)]
    got = ruled.find_tables(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(words, WORDS)).orderBy("page_number", "table_index").collect()
    assert [(r.page_number, r.table_index, r.grid) for r in got] == [
        (1, 0, [["A", "Head er", None], ["tall\ncell", "b", "c"], [None, "d", ""]]),
        (1, 1, [["second"], [""]]),
        (2, 0, [["", "p2"]]),
    ]
    assert tuple(got[0].bbox) == (0.0, 0.0, 300.0, 60.0)
    none = spark.createDataFrame([], SEGMENTS), spark.createDataFrame([], WORDS)
    assert ruled.find_tables(*none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_ruled_grids_equal_a_plain_search(spark, seed):
    """Cells of random rules against a search of all corners."""
    import random

    rnd = random.Random(seed)
    segments = [across(y * 20, a * 30, b * 30) for y in range(7) for a, b in [sorted(rnd.sample(range(7), 2))]] + [down(x * 30, a * 20, b * 20) for x in range(7) for a, b in [sorted(rnd.sample(range(7), 2))]]
    segments += [across(0, 0, 180), across(120, 0, 180), down(0, 0, 120), down(180, 0, 120)]
    merged = ruled.edges(spark.createDataFrame(segments, SEGMENTS)).collect()
    hs, vs = [e for e in merged if not e.upright], [e for e in merged if e.upright]
    points = {(v.at, h.at): (v, h) for v in vs for h in hs if h.start - 3 <= v.at <= h.end + 3 and v.start - 3 <= h.at <= v.end + 3}
    want = set()
    for (x, y), (v, h) in points.items():
        fits = [(y2, x2) for (x2, y2), (v2, h2) in points.items() if y2 > y and x2 > x and points.get((x, y2), (0, 0))[0] == v and points.get((x2, y), (0, 0))[1] == h and points[x, y2][1] == h2 and points[x2, y][0] == v2]
        if fits:
            want.add((x, y, min(fits)[1], min(fits)[0]))
    got = {(r.x0, r.top, r.x1, r.bottom) for r in ruled.cells(ruled.crossings(ruled.edges(spark.createDataFrame(segments, SEGMENTS)))).collect()}
    assert got == want


def test_a_page_of_drawn_tables_is_moved_once(spark):
    segments = spark.createDataFrame([across(y, 0, 50) for y in (0, 10, 20)] + [down(x, 0, 20) for x in (0, 25, 50)], SEGMENTS)
    words = spark.createDataFrame([at(i, f"w{i}", 10 + 25 * (i % 2), 5 + 10 * (i // 2)) for i in range(4)], WORDS)
    got = ruled.find_tables(segments, words)
    assert [r.grid for r in got.collect()] == [[["w0", "w1"], ["w2", "w3"]]]
    # one exchange for rules, one for words, and nothing that is written and read again
    plan = got._jdf.queryExecution().sparkPlan().toString(), got._jdf.queryExecution().executedPlan().toString()
    assert plan[1].split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 2 and "parquet" not in plan[0]


def test_table_ids_never_meet(spark):
    grid = [["a", "b"], ["1", "2"]]
    rows = [(d, f, p, i, None, grid) for d, f, p, i in [*[(7, "f", 1, i) for i in range(300)], (7, "f", 2, 0), (7, "f", 5000, 0), (7, "f", 4097, 1), (7, "g", 1, 0), (2**62, "h", 1, 0)]]
    ts = pages.to_table_set(pages.split_headers(spark.createDataFrame(rows, pages.GRID)))
    found = ts.tables.orderBy("table_id").collect()
    assert [r.table_id for r in found] == list(range(305)) and [(r.source_file, r.page_number, r.table_index) for r in found] == sorted((f, p, i) for _, f, p, i, _, _ in rows)
    assert ts.rows.select("table_id").distinct().count() == 305
    # one hash, two files: no continuation
    rows = [(7, f, p, 0, None, grid) for f, p in (("a", 1), ("b", 2))]
    assert pages.merge_continuations(pages.split_headers(spark.createDataFrame(rows, pages.GRID))).count() == 2


def test_drawn_tables_and_the_detector_in_the_facade(spark, tmp_path):
    # local functions, as the workers cannot import this file
    def drawn_parser(raw):
        """A page with a drawn table below a title, whose second header row is torn, and a parser's own table on the next page."""
        if b"bad" in raw:
            raise RuntimeError("no such page")
        lines = [(0, y, 200, y) for y in (20, 40, 60, 80)] + [(x, 20, x, 80) for x in (0, 100, 200)]
        said = [("Title", 20, 10), ("Cu", 50, 30), ("Sn", 150, 30), ("From", 50, 50), ("1", 50, 70), ("2", 150, 70), ("Foot", 20, 90)]
        words = [{"text": t, "x0": x - 5, "x1": x + 5, "top": y - 4, "bottom": y + 4} for t, x, y in said]
        return [{"page_number": 1, "lines": lines, "words": words}, {"page_number": 2, "tables": [{"bbox": (0, 0, 9, 9), "grid": [["own"], ["x"]]}]}]

    def fake_model():
        def boxes(content, page, box):
            if b"fails" in content:
                raise RuntimeError("out of memory")
            rows = [{"label": "table row", "score": 0.9, "x0": 0, "y0": y, "x1": 400, "y1": y + 40} for y in (0, 40, 80)]
            columns = [{"label": "table column", "score": 0.9, "x0": x, "y0": 0, "x1": x + 200, "y1": 120} for x in (0, 200)]
            return 400, 120, [*rows, *columns, {"label": "table column header", "score": 0.9, "x0": 0, "y0": 0, "x1": 400, "y1": 30}]

        return boxes

    for name, content in (("a.pdf", b"one"), ("b.pdf", b"fails")):
        (tmp_path / name).write_bytes(content)
    plain = api.PipelineConfig(pdf_parser=drawn_parser, normalizer_chain=[])
    ts = api.extract_tables(spark, str(tmp_path / "a.pdf"), plain)
    one, two = ts.tables.orderBy("table_id").collect()
    assert one.headers == [["Cu", "Sn"], ["From", ""]] and one.context == "Title | Foot" and two.headers == [["own"]] and two.context == ""
    assert cells(ts) == {0: [["1", "2"]], 1: [["x"]]}
    config = api.PipelineConfig(pdf_parser=drawn_parser, detector=fake_model, normalizer_chain=[])
    ts = api.extract_tables(spark, str(tmp_path / "a.pdf"), config)
    assert ts.tables.orderBy("table_id").first().headers == [["Cu", "Sn"]] and cells(ts) == {0: [["From", ""], ["1", "2"]], 1: [["x"]]}
    # a model that fails leaves the table as it is
    ts = api.extract_tables(spark, str(tmp_path / "b.pdf"), config)
    assert ts.tables.orderBy("table_id").first().headers == [["Cu", "Sn"], ["From", ""]] and cells(ts) == {0: [["1", "2"]], 1: [["x"]]}


DETECTED = "table_id long, label string, score double, x0 double, y0 double, x1 double, y1 double"
PLACED = "table_id long, word_ord long, text string, x0 double, x1 double, top double, bottom double"
FRAMES = "table_id long, x0 double, y0 double, x1 double, y1 double, image_w int, image_h int"
ROW, COLUMN, HEAD = "table row", "table column", "table column header"


def boxes_searched(boxes, words, frames):
    """Every word compared with every cell; null and NaN are in no order."""
    key = lambda b: [(v is not None, v) for v in b]
    within = lambda lo, x, hi: None not in (lo, x, hi) and lo <= x <= hi
    half = lambda a, b: None if a is None or b is None else (a + b) / 2
    out = {}
    for t, fx0, fy0, fx1, fy1, w, h in frames:
        sx, sy = (fx1 - fx0) / w, (fy1 - fy0) / h
        put = lambda b: tuple(None if v is None else o + v * k for v, o, k in zip(b, (fx0, fy0, fx0, fy0), (sx, sy, sx, sy), strict=True))  # noqa: B023, E731
        own = lambda kind, by: [b for _, b in sorted(((b[3 + by], put(b[3:])) for b in boxes if b[0] == t and b[1] == kind and b[2] is not None and b[2] >= 0.5), key=lambda x: key((x[0], *x[1])))]  # noqa: B023, E731
        rows, cols, heads = own(ROW, 1), own(COLUMN, 0), own(HEAD, 1)
        if not rows or not cols:
            continue
        said = sorted(((key((o, s)), s, half(x0, x1), half(y0, y1)) for i, o, s, x0, x1, y0, y1 in words if i == t), key=lambda w: w[0])
        hit = lambda r, c, x, y: within(r[1], y, r[3]) and within(c[0], x, c[2]) and within(r[0], x, r[2]) and within(c[1], y, c[3])
        grid = [[" ".join(s for _, s, x, y in said if hit(r, c, x, y) and s is not None).strip() for c in cols] for r in rows]  # noqa: B023
        top = [any(within(a[1], half(r[1], r[3]), a[3]) for a in heads) for r in rows]
        top = top if any(top) else [i == 0 for i in range(len(rows))]
        out[t] = ([g for g, k in zip(grid, top, strict=True) if k], [g for g, k in zip(grid, top, strict=True) if not k])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_grids_of_boxes_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    some = lambda a, b: rng.choice([None, math.inf, -math.inf]) if rng.random() < 0.03 else float(rng.randint(a, b))
    boxes, words, frames = [], [], []
    for t in range(12):
        frames.append((t, 10.0 * t, 5.0, 10.0 * t + 50, 105.0, 100, 200))
        for kind, most in ((ROW, 6), (COLUMN, 5), (HEAD, 1), ("table", 1)):
            for _ in range(rng.randint(0, most)):
                a, b = some(0, 180), some(0, 90)
                across_it = (some(0, 10), a, some(60, 100), None if a is None else a + rng.randint(-2, 70))
                down_it = (b, some(0, 30), None if b is None else b + rng.randint(-2, 60), some(120, 200))
                boxes.append((t, kind, rng.choice([0.9, 0.9, 0.9, 0.5, 0.4, None]), *(down_it if kind == COLUMN else across_it)))
        for _ in range(rng.choice([0, 1, 40])):
            x, y = some(10 * t - 2, 10 * t + 52), some(3, 107)
            words.append((t, rng.choice([None, rng.randint(0, 20)]), rng.choice([None, "", " ", f"w{rng.randint(0, 9)}"]), x, x, y, y))
    # equal boxes and words, a table without a frame, rows without a table
    boxes += [*boxes[:4], (99, ROW, 0.9, 0.0, 0.0, 9.0, 9.0), (99, COLUMN, 0.9, 0.0, 0.0, 9.0, 9.0), (None, ROW, 0.9, 0.0, 0.0, 9.0, 9.0)]
    words += [*words[:9], (99, 1, "w", 1.0, 1.0, 1.0, 1.0), (None, 1, "w", 1.0, 1.0, 1.0, 1.0)]
    got = pages.grids_from_boxes(spark.createDataFrame(boxes, DETECTED).repartition(5), spark.createDataFrame(words, PLACED).repartition(5), spark.createDataFrame(frames, FRAMES)).collect()
    want = boxes_searched(boxes, words, frames)
    assert {r.table_id: (r.headers, r["rows"]) for r in got} == want and len(got) == len(want) > 4


def test_boxes_and_words_of_a_table_are_moved_once(spark):
    boxes = spark.createDataFrame([(1, ROW, 0.9, 0.0, float(y), 20.0, y + 10.0) for y in (0, 10)] + [(1, COLUMN, 0.9, float(x), 0.0, x + 10.0, 20.0) for x in (0, 10)], DETECTED)
    words = spark.createDataFrame([(1, i, f"w{i}", 10.0 * (i % 2), 10.0 * (i % 2) + 8, 10.0 * (i // 2), 10.0 * (i // 2) + 8) for i in range(4)], PLACED)
    got = pages.grids_from_boxes(boxes, words, spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0, 20, 20)], FRAMES))
    assert [(r.headers, r["rows"]) for r in got.collect()] == [([["w0", "w1"]], [["w2", "w3"]])]
    # one exchange for boxes, one for words and one for frames
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 3


def test_staggered_tables_are_refined(spark):
    tables = spark.createDataFrame([(0, [["Cu", "Sn"], ["From", ""]], [["1", "2"]], (0.0, 0.0, 1.0, 1.0)), (1, [["a", "b"]], [["3", "4"]], None)], "table_id long, headers array<array<string>>, rows array<array<string>>, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    new = spark.createDataFrame([(0, [["Cu", "Sn"]], [["9", "9"]]), (1, [["z"]], [["z"]])], "table_id long, headers array<array<string>>, rows array<array<string>>")
    got = {r.table_id: r["rows"] for r in pages.refine(tables, new).collect()}
    assert got == {0: [["9", "9"]], 1: [["3", "4"]]}


def test_stream(spark, tmp_path):
    docs = [(i, f"| Key | Value |\n|---|---|\n| color | c{i} |\n| size | s{i} |\n") for i in range(4)] + [(9, "no table")]
    for n in range(2):
        spark.createDataFrame(docs[n::2], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), max_files=1)
    query.awaitTermination(240)
    gs, postings = ingest.stored_graphs(spark, str(tmp_path / "out"))
    assert gs.graphs.count() == 4
    got = api.retrieve_context(gs, "c3", postings=postings).first().context
    assert "c3" in got


def test_broken_settings_are_reported(tmp_path):
    (tmp_path / api.SETTINGS).write_text("{")
    with pytest.warns(UserWarning):
        assert api.PipelineConfig.load_default(str(tmp_path)).max_pages == 1000
    (tmp_path / api.SETTINGS).write_text('{"max_pages": 5, "other": 1}')
    assert api.PipelineConfig.load_default(str(tmp_path)).max_pages == 5
