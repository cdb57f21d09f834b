"""Literal tables through the whole engine: types, graphs, retrieval, exports."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabweave.operators import asof, build, classify, context, index, normalize, retrieve, sinks
from tabweave.plans import api, registry
from tabweave.schema import TableSet
from tabweave.sources import grids

KV = {"headers": [["Property", "Value"]], "rows": [["Color", "Blue"], ["Size", "Large"], ["Weight", "5kg"]]}
COMPARISON = {"headers": [["Trait", "Left", "Right"]], "rows": [["Depth", "4 m", "9 m"], ["Colour", "red", "grey"]]}
SERIES = {"headers": [["Metric", "2021", "2022", "2023"]], "rows": [["Revenue", "100", "120", "140"], ["Cost", "80", "90", "100"]]}
TREE = {"headers": [["Account", "Amount"]], "rows": [["Assets", "1"], ["  Current", "2"], ["    Cash", "3"], ["    Stock", "4"], ["  Fixed", "5"]]}
MATRIX = {"headers": [["", "A", "B", "C"]], "rows": [["A", "0", "10", "5"], ["B", "10", "0", "8"], ["C", "5", "8", "0"]]}
RELATIONAL = {"headers": [["boat_id", "title", "harbour_id"]], "rows": [["1", "Petrel", "10"], ["2", "Grebe", "20"]]}
PIVOT = {"headers": [["Category", "2023", "2023", "2024", "2024"], ["", "Q1", "Q2", "Q1", "Q2"]], "rows": [["X", "1", "2", "3", "4"], ["Y", "5", "6", "7", "8"]]}
ALL = {"key_value": KV, "comparison": COMPARISON, "time_series": SERIES, "hierarchical": TREE, "matrix": MATRIX, "relational": RELATIONAL, "pivot": PIVOT}


def one(spark, table, kind):
    ts = grids.from_lists(spark, [table])
    types = spark.createDataFrame([(0, kind, 1.0)], "table_id long, table_type string, confidence double")
    return build.build(ts, types, [kind])


@pytest.mark.parametrize(("kind", "nodes", "edges"), [("key_value", 4, 3), ("comparison", 4, 4), ("time_series", 5, 8), ("hierarchical", 6, 11), ("matrix", 3, 3), ("relational", 2, 0), ("pivot", 14, 28)])
def test_builders_make_the_expected_graphs(spark, kind, nodes, edges):
    gs = one(spark, ALL[kind], kind)
    n, e = gs.nodes.collect(), gs.edges.collect()
    assert (len(n), len(e)) == (nodes, edges)
    assert len({r.node_ord for r in n}) == nodes
    assert {x for r in e for x in (r.src, r.dst)} <= {r.node_id for r in n}


def test_hierarchy_edges(spark):
    gs = one(spark, TREE, "hierarchical")
    got = {(r.src, r.dst, r.label) for r in gs.edges.collect()}
    parents = {("root", "cat_0"), ("cat_0", "cat_1"), ("cat_1", "cat_2"), ("cat_1", "cat_3"), ("cat_0", "cat_4")}
    assert {(a, b) for a, b, k in got if k == "PARENT_OF"} == parents
    assert {(a, b) for a, b, k in got if k == "ANCESTOR_OF"} == {("root", "cat_1"), ("root", "cat_2"), ("cat_0", "cat_2"), ("root", "cat_3"), ("cat_0", "cat_3"), ("root", "cat_4")}


def test_matrix_is_undirected_with_first_weight(spark):
    gs = one(spark, MATRIX | {"rows": [["A", "0", "10", "nan"], ["B", "11", "0", "1_000"], ["C", "5", "1d", "0"]]}, "matrix")
    got = {(r.src, r.dst): {p.k: p.v for p in r.props} for r in gs.edges.collect()}
    assert got == {("A", "B"): {"weight": "10.0", "value": "10"}, ("A", "C"): {"weight": "nan", "value": "nan"}, ("B", "C"): {"weight": "1000.0", "value": "1_000"}}
    assert not gs.graphs.first().directed


def test_relational_takes_the_last_row_of_a_key_and_the_last_column(spark):
    rows = [["1", "2", "2"], ["2", "1", "9"], ["2", "", "2"], [None, "1", "x"]]
    gs = one(spark, {"headers": [["id", "a_id", "b_ref"]], "rows": rows}, "relational")
    got = {(r.src, r.dst): r.props[0].v for r in gs.edges.collect()}
    assert got == {("entity_0", "entity_2"): "b_ref", ("entity_1", "entity_0"): "a_id", ("entity_1", "entity_2"): "id", ("entity_3", "entity_0"): "a_id"}


def test_pivot_order_and_edges(spark):
    gs = one(spark, PIVOT, "pivot")
    labels = gs.nodes.groupBy("label").count().collect()
    assert {r.label: r["count"] for r in labels} == {"Dimension": 6, "Measure": 8}
    assert {r.label: r["count"] for r in gs.edges.groupBy("label").count().collect()} == {"AGGREGATED_BY": 24, "HAS_SUBDIMENSION": 4}
    ids = [r.node_id for r in gs.nodes.orderBy("node_ord").collect()]
    assert ids == ["dim_0", "dim_1", "dim_2", "dim_3", "rowdim_0_0", "rowdim_1_0"] + [f"measure_{i}" for i in range(8)]


def test_none_and_missing_cells(spark):
    gs = one(spark, {"headers": [["k", "v"]], "rows": [["a", None], ["b"], []]}, "key_value")
    got = {r.node_id: {p.k: p.v for p in r.props} for r in gs.nodes.collect()}
    assert got["prop_0"] == {"key": "a", "value": "None"} and got["prop_1"] == {"key": "b", "value": ""} and got["prop_2"] == {"key": "", "value": ""}


GOLDEN = [
    ({"headers": [["Quality", "Oak wood", "Pine wood"]], "rows": [["Grain", "Coarse", "Fine"], ["Tone", "Brown", "Pale"]]}, "comparison", None),
    (MATRIX, "matrix", 1.0),
    (PIVOT, "pivot", 1.0),
    (SERIES, "time_series", 1.0),
    ({"headers": [["Account", "Q", "Amount"]], "rows": [["Assets", "a", "1"], ["  Current", "b", "2"], ["    Cash", "c", "x"]]}, "hierarchical", None),
    ({"headers": [], "rows": []}, "unknown", 0.0),
]


def test_classifier(spark):
    ts = grids.from_lists(spark, [g[0] for g in GOLDEN])
    got = {r.table_id: r for r in classify.classify(ts).collect()}
    for i, (_, kind, confidence) in enumerate(GOLDEN):
        assert got[i].table_type == kind, (i, got[i])
        if confidence is not None:
            assert got[i].confidence == confidence
    custom = classify.classify(ts, only={"mine": F.lit(0.99)}).where("table_id = 1").first()
    assert (custom.table_type, custom.confidence) == ("mine", 0.99)


def test_score_order_of_addition(spark):
    # 0.1 + 0.2 is just over 0.3, so key_value is a secondary type
    ts = grids.from_lists(spark, [{"headers": [["Quality", "Oak wood", "Pine wood"]], "rows": [["Price", "$31", "$17"], ["Density", "7kg", "4kg"]]}])
    got = classify.classify(ts).first()
    assert got.table_type == "comparison" and got.scores["key_value"] == 0.2 + 0.1 + 0.2


def test_normalizers(spark):
    ts = grids.from_lists(spark, [{"headers": [["  Name  ", "Age "]], "rows": [["Alice\n Smith", "30"], [None, "31"], ["", ""]]}])
    done = api.normalize_tables(ts)
    rows = [[c.v for c in r["cells"]] for r in done.rows.orderBy("row_idx").collect()]
    assert rows == [["Alice Smith", "30"], ["Alice Smith", "31"], ["Alice Smith", "31"]]
    assert done.tables.first().headers == [["Name", "Age"]]
    kinds = normalize.data_types(grids.from_lists(spark, [{"headers": [["a"]], "rows": [["1,000", "2024-01-02", "x", "", None, 5, "$10", ","]]}])).rows.first().data_types
    assert kinds == ["numeric", "date", "text", "empty", "empty", "numeric", "text", "numeric"]


def test_stitch_compares_with_the_chain_head(spark):
    tables = [{"headers": [["A", "B"]], "rows": [[1, 2]], "page_number": 1}, {"headers": [["a ", "B"]], "rows": [[3, 4]], "page_number": 2}, {"headers": [["C", "D"]], "rows": [[5, 6]], "page_number": 3}]
    got = normalize.multipage_stitch(grids.from_lists(spark, tables))
    assert got.tables.count() == 2
    assert [r["cells"][0].v for r in got.rows.where("table_id = 0").orderBy("row_idx").collect()] == ["1", "3"]


@pytest.fixture(scope="module")
def store(spark):
    ts = grids.from_lists(spark, [KV | {"source_file": "kv"}, SERIES | {"source_file": "ts"}])
    types = spark.createDataFrame([(0, "key_value", 0.9), (1, "time_series", 1.0)], "table_id long, table_type string, confidence double")
    return api.GraphStore(build.build(ts, types, ["key_value", "time_series"]))


def test_search_and_ties(store):
    hits = store.search_nodes("what is the color blue").orderBy("rank").collect()
    assert (hits[0].node_id, hits[0].score) == ("entity_0", 1.0) or hits[0].node_id == "prop_0"
    # both ends of the edge carry its words; the property's own posting comes first
    assert {(h.node_id, h.score) for h in hits} == {("prop_0", 1.0), ("entity_0", 1.0)}
    assert store.search_nodes("the of and").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_equals_scoring_everything(spark, monkeypatch, seed):
    import random

    rnd = random.Random(seed)
    words = [f"w{i:02d}" for i in range(40)]
    place = {}
    posted = {}
    for n in range(150):
        graph, node = n % 3, f"n{n}"
        place[graph, node] = (rnd.randrange(2), n, 0, 0)
        for i, w in enumerate(words):
            if rnd.random() < 1 / (1 + i):
                posted[w, graph, node] = rnd.choice([1.0, 1.0, 0.5])
    rows = [(w, g, n, x, place[g, n]) for (w, g, n), x in posted.items()]
    lists = spark.createDataFrame(rows, "token string, graph_id long, node_id string, weight double, place struct<kind:int,ord:int,seq:int,end:int>")
    asked = [" ".join(rnd.choices(words, weights=[1 / (1 + i % 7) for i in range(40)], k=rnd.randint(1, 7))) for _ in range(25)] + ["nothing here", ""]
    monkeypatch.setattr(index, "RARE_NODES", rnd.choice([2, 6, 20]))
    got = {}
    for r in index.search(lists, api.as_queries(spark, asked), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.graph_id, r.node_id, r.score))
    want = {}
    for q, text in enumerate(asked):
        tokens = text.split()
        scored = []
        for g, n in place:
            met = [(tokens.index(w), posted[w, g, n]) for w in set(tokens) if (w, g, n) in posted]
            if met:
                scored.append((-sum(x for _, x in met), min(p for p, _ in met), g, place[g, n], n))
        for i, (minus, _, g, _, n) in enumerate(sorted(scored)[:4]):
            want.setdefault(q, []).append((i + 1, g, n, -minus / len(tokens)))
    assert {q: sorted(x) for q, x in got.items()} == want


def test_search_does_not_score_every_pair(spark):
    """Every query shares two words with every node; the nodes looked up for the shared words do not grow with the queries."""
    nodes = spark.range(500).select(F.lit(0).cast("long").alias("graph_id"), F.concat(F.lit("n"), "id").alias("node_id"), F.col("id"), F.explode(F.array(F.lit("balance"), F.lit("supplier"), F.concat(F.lit("id"), "id"))).alias("token"))
    lists = nodes.select("token", "graph_id", "node_id", F.lit(1.0).alias("weight"), F.struct(F.lit(0).alias("kind"), F.col("id").alias("ord"), F.lit(0).alias("seq"), F.lit(0).alias("end")).alias("place"))
    queries = spark.range(300).select(F.col("id").alias("query_id"), F.concat(F.lit("balance supplier id"), "id").alias("query"))
    found = index.search(lists, queries, 3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.node_id)
    assert got == {i: [f"n{i}", *[f"n{k}" for k in range(4) if k != i][:2]] for i in range(300)}


def test_latency_stats_equal_sorting(spark):
    import random

    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), float(rnd.randrange(30)) if rnd.random() < 0.95 else None) for _ in range(500)]
    got = {(r.kind, r.is_total): (r.n, round(r.mean, 9), r.median, r.p95) for r in api.latency_stats(spark.createDataFrame(rows, "kind string, t double"), "t", ["kind"]).collect()}
    want = {}
    for kind, total in (("a", 0), ("b", 0), (None, 0), (None, 1)):
        v = sorted(t for k, t in rows if t is not None and (total or k == kind))
        want[kind, total] = (len(v), round(sum(v) / len(v), 9), v[len(v) // 2], v[int(len(v) * 0.95)])
    assert got == want


def test_stitching_equals_a_plain_loop(spark):
    import random

    rnd = random.Random(6)
    kinds = [["A", "B"], ["a ", "B"], ["C", "D"], ["A", "B", "C", "D", "E"], ["A", "B", "C", "D"], None]
    tables = []
    for source in ("s", "t"):
        for page in range(25):
            head = rnd.choice(kinds)
            tables.append({"headers": [head] if head else [], "rows": [[f"{source}{page}.{k}"] for k in range(rnd.randrange(3))], "page_number": page, "source_file": source})
    got = normalize.multipage_stitch(grids.from_lists(spark, tables))
    chains, last = {}, {}
    for i, t in enumerate(tables):
        mine = {h.strip().lower() for h in t["headers"][0]} if t["headers"] else None
        head, theirs = last.get(t["source_file"], (None, None))
        if mine and theirs and len(mine & theirs) / len(mine | theirs) >= 0.8:
            chains[head] += t["rows"]
        else:
            last[t["source_file"]] = (i, mine)
            chains[i] = list(t["rows"])
    rows = {}
    for r in got.rows.orderBy("table_id", "row_idx").collect():
        rows.setdefault(r.table_id, []).append([c.v for c in r["cells"]])
    assert rows == {i: c for i, c in chains.items() if c} and {r.table_id for r in got.tables.collect()} == set(chains)


def test_held_tables_go_at_the_end_of_a_block(spark):
    import pathlib

    from tabweave.plans.shared import held_for_now, hold, shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    kept = hold(spark.range(3))
    before = set(folder.iterdir())
    with held_for_now():
        assert hold(spark.range(4)).count() == 4 and len(set(folder.iterdir())) == len(before) + 1
    assert set(folder.iterdir()) == before and kept.count() == 3


def test_suite_of_literal_queries(spark, tmp_path):
    import json

    from tabweave.plans import suite

    tables = [{"name": "plans", "headers": [["Property", "Value"]], "rows": [["Colour", "teal"], ["Width", "31 cm"]]}, {"name": "yearly", "headers": [["Metric", "2021", "2022", "2023"]], "rows": [["Revenue", "100", "120", "140"], ["Cost", "80", "90", "100"]]}]
    queries = [{"archetype": "key_value", "query": "What is the colour?", "targets": ["Teal"]}, {"archetype": "time_series", "query": "What was the revenue in 2022?", "targets": ["120"]}, {"archetype": "time_series", "query": "Which cost and revenue in 2021?", "targets": ["80", "100"]}, {"archetype": "time_series", "query": "revenue", "targets": ["not there"]}]
    (tmp_path / "suite.json").write_text(json.dumps({"tables": tables, "queries": queries}))
    found = suite.answers(*suite.load(spark, str(tmp_path / "suite.json")))
    assert [(r.graph_hit, r.flat_hit) for r in found.orderBy("query_id").collect()] == [(True, True), (True, True), (True, False), (False, False)]
    assert {r.archetype: (r.asked, r.graph_hits, r.flat_hits) for r in suite.rates(found).collect()} == {"key_value": (1, 1, 1), "time_series": (3, 2, 1), None: (4, 3, 2)}


def questions(tables):
    """Queries made from the cells of one table of each type, by a form of question for each, with the cell's text as what must be found."""
    out = []
    ask = lambda kind, text, *targets: out.append({"archetype": kind, "query": text, "targets": list(targets)})
    for kind, t in tables.items():
        head, rows = t["headers"], t["rows"]
        for row in rows:
            if kind == "key_value":
                ask(kind, f"What is the {row[0]}?", row[1])
            elif kind == "hierarchical":
                ask(kind, f"Amount of {row[0].strip()}", row[1])
            elif kind == "relational":
                ask(kind, f"Where does {row[1]} lie?", row[2])
            elif kind == "pivot":
                for i in range(1, len(row)):
                    ask(kind, f"{row[0]} in {head[0][i]} {head[1][i]}", row[i])
            else:
                for i in range(1, len(row)):
                    if row[i] != "0":
                        ask(kind, f"{row[0]} of {head[0][i]}", row[i])
                if kind in ("time_series", "comparison"):
                    ask(kind, f"All values of {row[0]}", *row[1:])
    return out


def test_suite_of_questions_on_every_type(spark, tmp_path):
    """A suite of own making, on own tables: graph retrieval answers all of it, and no worse than single rows do."""
    import json

    from tabweave.plans import suite

    tables = {
        "key_value": {"headers": [["Property", "Value"]], "rows": [["Mast", "spruce"], ["Hull", "larch"], ["Keel", "lead"], ["Built", "Arendal"]]},
        "comparison": {"headers": [["Trait", "Gull", "Tern", "Skua"]], "rows": [["Wing", "long", "slim", "broad"], ["Call", "harsh", "shrill", "gruff"], ["Nest", "ledge", "shingle", "moor"]]},
        "time_series": {"headers": [["Metric", "2017", "2018", "2019", "2020"]], "rows": [["Landings", "411", "398", "402", "377"], ["Berths", "55", "56", "58", "61"], ["Wages", "930", "955", "978", "1004"]]},
        "hierarchical": {"headers": [["Ledger", "Amount"]], "rows": [["Port", "9100"], ["  Docks", "5200"], ["    Cranes", "1900"], ["    Quays", "3300"], ["  Pilots", "3900"]]},
        "matrix": {"headers": [["", "Bergen", "Tromso", "Bodo"]], "rows": [["Bergen", "0", "1471", "1002"], ["Tromso", "1471", "0", "327"], ["Bodo", "1002", "327", "0"]]},
        "relational": RELATIONAL | {"rows": [["1", "Petrel", "Lista"], ["2", "Grebe", "Mandal"], ["3", "Fulmar", "Vardo"]]},
        "pivot": {"headers": [["Fish", "2021", "2021", "2022", "2022"], ["", "Spring", "Autumn", "Spring", "Autumn"]], "rows": [["Cod", "14", "28", "37", "46"], ["Hake", "53", "62", "71", "85"]]},
    }
    asked = questions(tables)
    (tmp_path / "suite.json").write_text(json.dumps({"tables": [{"name": k, **t} for k, t in tables.items()], "queries": asked}))
    got = {r.archetype: r for r in suite.rates(suite.answers(*suite.load(spark, str(tmp_path / "suite.json")))).collect()}
    assert set(got) == {*tables, None} and got[None].asked == len(asked) >= 50
    assert got[None].graph_hits == got[None].asked and got[None].flat_hits <= got[None].graph_hits, got


def test_induced_edges_equal_a_plain_loop(spark):
    import random

    rnd = random.Random(8)
    pairs = {(rnd.randrange(2), "hub", f"n{i}") for i in range(20)} | {(rnd.randrange(2), f"n{rnd.randrange(20)}", f"n{rnd.randrange(20)}") for _ in range(30)}
    edges = spark.createDataFrame([(g, a, b, "x") for g, a, b in pairs], "graph_id long, src string, dst string, label string")
    reached = {(q, g, n) for q in range(6) for g in (0, 1) for n in [*(f"n{rnd.randrange(20)}" for _ in range(6)), "hub"]}
    got = retrieve.induced(spark.createDataFrame(sorted(reached), "q int, graph_id long, node_id string"), edges, ["q"]).collect()
    assert sorted((r.q, r.graph_id, r.src, r.dst) for r in got) == sorted((q, g, a, b) for g, a, b in pairs for q in range(6) if (q, g, a) in reached and (q, g, b) in reached)


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_reach_of_starts_that_are_alike_equals_a_plain_loop(spark, k):
    import random

    rnd = random.Random(k)
    # leaves of hubs are alike; some nodes have loops, repeated edges or none
    pairs = [(0, f"h{i % 3}", f"leaf{i}") for i in range(30)] + [(rnd.randrange(2), f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for _ in range(14)] + [(0, "leaf1", "leaf1"), (0, "h0", "h1"), (0, "h0", "h1"), (0, "h1", "n0")]
    names = sorted({(g, x) for g, a, b in pairs for x in (a, b)} | {(0, "alone")})
    near = {n: {b if a == n[1] else a for g, a, b in pairs if g == n[0] and n[1] in (a, b)} for n in names}

    def reach(n):
        seen, front = {n[1]: 0}, [n[1]]
        for d in range(1, k + 1):
            front = sorted({y for x in front for y in near[n[0], x]} - set(seen))
            seen.update(dict.fromkeys(front, d))
        return seen

    edges = spark.createDataFrame(pairs, "graph_id long, src string, dst string")
    starts = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "q int, graph_id long, node_id string")
    want = sorted((i, n[0], x, d) for i, n in enumerate(names) for x, d in reach(n).items())
    assert sorted(map(tuple, retrieve.expand(starts, edges, k, ["q"]).collect())) == want
    counted = Counter((q, d) for q, _, _, d in want)
    assert {(r.q, r.depth): r.n for r in retrieve.count_hops(starts, edges, k, ["q"]).collect()} == counted
    if k:
        asked = [(q, r, *rnd.choice(names)) for q in range(25) for r in (1, 2)]
        got = retrieve.beyond(spark.createDataFrame(asked, "query_id int, rank int, graph_id long, node_id string"), edges, k).collect()
        found = {(q, g, x) for q, _, g, n in asked for x in reach((g, n))}
        assert sorted(map(tuple, got)) == sorted(found - {(q, g, x) for q, _, g, n in asked for x in near[g, n] | {n}})


def test_hops_and_induced_edges(store):
    sizes = [api.GraphRetriever(store, 1, k).retrieve("metric_0 revenue").nodes.count() for k in (0, 1, 2)]
    assert sizes[0] == 1 and sizes[0] < sizes[1] <= sizes[2]
    found = api.GraphRetriever(store, 1, 0).retrieve("revenue")
    assert found.edges.count() == 0


def test_contexts(store):
    found = api.GraphRetriever(store, 3, 1).retrieve(["revenue 2022", "nothing here matches xyzzy", "blue"])
    for strategy in context.STRATEGIES:
        got = {r.query_id: r.context for r in context.render(found, strategy).collect()}
        assert got[0].startswith('## Graph Context (query: "revenue 2022")\nStrategy: ' + strategy)
        assert got[1] == 'No relevant graph context found for query: "nothing here matches xyzzy"'
        assert "Blue" in got[2]
    short = {r.query_id: r.context for r in context.render(found, "node-centric", 10).collect()}
    assert len(short[0]) <= 60 and short[0].endswith("\n... (truncated)")
    with pytest.raises(ValueError):
        context.render(found, "none")


def test_node_centric_text(spark):
    ts = grids.from_lists(spark, [KV])
    gs = build.build(ts, spark.createDataFrame([(0, "key_value", 0.5)], "table_id long, table_type string, confidence double"), ["key_value"])
    got = api.retrieve_context(gs, "blue", top_k=1).first().context
    assert got == (
        '## Graph Context (query: "blue")\nStrategy: node-centric | Nodes: 2 | Edges: 1\n\n'
        "### Property: Property 'Color' (value=Blue) (relevance: 1.00)\n  Connected to:\n"
        "    - Entity: Entity 'Property' via [HAS_PROPERTY (key=Color, value=Blue)] (inbound)\n"
    )


def test_exports(spark):
    gs = one(spark, KV | {"source_file": "a.csv", "context": "said"}, "key_value")
    md = sinks.export(gs, "markdown").first().text
    assert md.startswith("## Table Graph (from a.csv)\n**Context:** said\n\n**Type:** key_value (confidence: 1.00)\n\n### Nodes\n\n  - **Entity** `entity_0`: name: Property\n")
    assert "  - `entity_0` —[HAS_PROPERTY]→ `prop_0`: key: Color, value: Blue" in md
    short = sinks.export(gs, "markdown", 1).first().text
    assert "... (3 more nodes)" in short and "... (2 more relationships)" in short
    cy = sinks.export(gs, "cypher").first().text
    assert "MERGE (prop_0:Property {key: 'Color', value: 'Blue', _id: 'prop_0'})" in cy
    assert "MERGE (entity_0)-[:HAS_PROPERTY {key: 'Color', value: 'Blue'}]->(prop_0)" in cy
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(sinks.export(gs, "graphml").first().text.encode()).findall(".//{*}node")) == 4
    import json

    assert len(json.loads(sinks.export(gs, "json").first().text)["edges"]) == 3
    assert "4 nodes, 3 edges" in sinks.export(gs, "summary").first().text
    with pytest.raises(KeyError):
        sinks.export(gs, "nope")


def test_facade(spark):
    import pandas as pd

    df = pd.DataFrame({"Property": ["Color", "Size"], "Value": ["Blue", None]})
    ts = api.extract_tables(spark, df)
    gs = api.build_graphs(ts, spark.createDataFrame([(0, "key_value", 1.0)], "table_id long, table_type string, confidence double"))
    assert "Blue" in api.retrieve_context(gs, "color").first().context
    with pytest.raises(ValueError):
        api.extract_tables(spark, object())
    assert "Table Graph" in api.joined(api.export_graphs(spark, "| a | b |\n|---|---|\n| x | 1 |\n"))
    with pytest.raises(KeyError):
        api.build_graphs(grids.from_nested(spark, []))
    with api.monitor(spark, "count") as m:
        ts.rows.count()
    assert m.seconds > 0 and m.jobs >= 1
    assert isinstance(registry.classifiers.get("heuristic")(), registry.TableClassifier)
    with pytest.raises(KeyError):
        registry.builders.get("nope")
    assert registry.serializers.available() == ["cypher", "graphml", "json", "markdown", "summary"]
    assert [r.Value for r in TableSet(ts.tables, ts.rows).to_wide(0).collect()] == ["Blue", "Blue"]


def test_every_cell_of_the_wide_table(spark):
    duckdb = pytest.importorskip("duckdb")
    from tabweave.plans.oracles import ORACLES
    from tabweave.plans.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view orders as from '{sf_dir}/orders.parquet'")
    got = QUERIES["wide_table_cells"](spark, sf_dir)
    rows = db.execute(ORACLES["wide_table_cells"])
    assert got.columns == [x[0] for x in rows.description]
    assert sorted(map(tuple, got.collect())) == sorted(rows.fetchall())


def test_public_names():
    import tabweave

    assert all(getattr(tabweave, n) is not None for n in tabweave.__all__)
    assert tabweave.extract_tables is api.extract_tables
    with pytest.raises(AttributeError):
        tabweave.nope  # noqa: B018


def test_flat_chunks(spark):
    ts = grids.from_lists(spark, [KV | {"source_file": "kv"}, SERIES | {"source_file": "ts"}])
    chunks = index.flat_chunks(ts.tables, ts.rows)
    got = index.best_chunk(chunks, api.as_queries(spark, ["revenue in 2022", "large size"])).collect()
    assert {r.query_id: r.chunk for r in got} == {0: "[ts Row 0] Metric | 2021 | 2022 | 2023 => Revenue | 100 | 120 | 140", 1: "[kv Row 1] Property | Value => Size | Large"}


def test_shortest_paths(spark):
    e = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "c", "d"), (0, "a", "e"), (0, "e", "d")], "query_id long, u string, v string")
    both = e.unionByName(e.selectExpr("query_id", "v as u", "u as v"))
    got = retrieve.shortest_paths(both, spark.createDataFrame([(0, "a")], "query_id long, start string"), ["query_id"])
    assert {r.node: r.path for r in got.collect()}["d"] == ["a", "e", "d"]


def test_shortest_paths_of_many_hops(spark):
    both = spark.range(66).selectExpr("0L as query_id", "id as u", "id + 1 as v")
    both = both.unionByName(both.selectExpr("query_id", "v as u", "u as v")).selectExpr("query_id", "cast(u as string) as u", "cast(v as string) as v")
    got = retrieve.shortest_paths(both, spark.createDataFrame([(0, "0")], "query_id long, start string"), ["query_id"])
    assert {r.node: len(r.path) for r in got.collect()} == {str(i): i + 1 for i in range(67)}


def test_two_sided_paths_equal_one_sided_ones(spark):
    import random

    rnd = random.Random(4)
    edges = {(q, *rnd.sample(range(14), 2)) for q in (0, 1) for _ in range(17)} | {(2, i, i + 1) for i in range(30)}
    both = spark.createDataFrame([(q, f"n{a:02d}", f"n{b:02d}") for q, u, v in edges for a, b in ((u, v), (v, u))], "q int, u string, v string")
    pairs = [(q, f"n{a:02d}", f"n{b:02d}") for q in (0, 1) for a in range(14) for b in range(a, 14)] + [(2, "n00", "n30"), (2, "n03", "n04"), (3, "n00", "n01")]
    asked = spark.createDataFrame(pairs, "q int, a string, b string")
    got = {(r.q, r.a, r.b): r.path for r in retrieve.pair_paths(both, asked, ["q"]).collect()}
    starts = asked.select("q", F.col("a").alias("start")).distinct()
    every = {(r.q, r.start, r.node): r.path for r in retrieve.shortest_paths(both, starts, ["q"]).collect()}
    assert got == {p: every[p] for p in pairs if p in every} and len(got[2, "n00", "n30"]) == 31


@pytest.mark.parametrize("part_rows", [1, 3, 1000])
def test_fills_and_trees_in_parts_equal_plain_loops(spark, part_rows):
    import random

    rnd = random.Random(part_rows)
    tables = [[[rnd.choice([None, "", "a", "b", 0]) for _ in range(rnd.randint(0, 4))] for _ in range(rnd.randint(1, 20))] for _ in range(6)]
    ts = grids.from_lists(spark, [{"headers": [["h"]], "rows": rows} for rows in tables])
    got = {(r.table_id, r.row_idx): [c.v for c in r.cells] for r in normalize.merged_cells(ts, part_rows).rows.collect()}
    for t, rows in enumerate(tables):
        last, first = {}, {}
        for i, row in enumerate(rows):
            for c, v in enumerate(row):
                first.setdefault(c, v)
                if v not in (None, ""):
                    last[c] = v
            assert got[t, i] == [None if (v := last.get(c, first[c])) is None else str(v) for c in range(len(row))]
    depths = [(t, i, rnd.choice([0, 2, 2, 4, 7])) for t in range(4) for i in range(25)]
    tree = build.ancestors(spark.createDataFrame(depths, "table_id long, row_idx long, depth int"), part_rows=part_rows)
    above = {}
    for r in tree.collect():
        above.setdefault((r.table_id, r.row_idx), []).append((r.above, r.ancestor))
    for t in range(4):
        chain = []
        for _, i, d in depths[t * 25 : t * 25 + 25]:
            chain = [(e, k) for e, k in chain if e < d]
            assert [k for _, k in sorted(above[t, i])] == [k for _, k in reversed(chain)] + [-1]
            chain.append((d, i))


def a_graph(spark, ids):
    ts = grids.from_lists(spark, [{"headers": [["Key", "Value"]], "rows": [[f"size {i}", f"blue {i % 2}"], ["colour", f"w{i}"]], "source_file": f"s{i}", "table_id": i} for i in ids])
    types = ts.tables.select("table_id", F.lit("key_value").alias("table_type"), F.lit(1.0).alias("confidence"))
    return build.build(ts, types, ["key_value"])


def test_a_store_in_parts_equals_one_build(spark, tmp_path):
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = api.GraphStore(a_graph(spark, [0, 1, 2, 3, 4]))
    parts = api.GraphStore(path=str(tmp_path / "store"), spark=spark)
    assert len(parts) == 0 and parts.add_all([a_graph(spark, [0]), a_graph(spark, [1, 2]), a_graph(spark, [3, 4])]) == [0, 0, 0]
    asked = ["blue 1 size", "colour w3", "nothing", "entity"]
    columns = sorted(whole.postings.columns)
    assert rows(parts.postings.select(columns)) == rows(whole.postings.select(columns)) and len(parts) == 5
    assert rows(parts.search_nodes(asked, 7)) == rows(whole.search_nodes(asked, 7)) == rows(api.index.search(api.index.postings(a_graph(spark, [0, 1, 2, 3, 4])), api.as_queries(spark, asked), 7))
    # ids that are taken are moved on
    assert parts.add(a_graph(spark, [4])) == 1 and {r.graph_id for r in parts.graphs.graphs.collect()} == set(range(6))
    parts.remove([1, 5])
    left = api.GraphStore(a_graph(spark, [0, 2, 3, 4]))
    assert rows(parts.search_nodes(asked, 7)) == rows(left.search_nodes(asked, 7))
    again = api.GraphStore.open(spark, str(tmp_path / "store"))
    assert rows(again.search_nodes(asked, 7)) == rows(left.search_nodes(asked, 7)) and len(again) == 4
    again.compact()
    assert rows(again.postings.select(columns)) == rows(left.postings.select(columns)) and again.index.removed is None
    once_more = api.GraphStore.open(spark, str(tmp_path / "store"))
    assert rows(once_more.search_nodes(asked, 7)) == rows(left.search_nodes(asked, 7))
    assert rows(api.retrieve_context(once_more.graphs, asked, postings=once_more.index)) == rows(api.retrieve_context(left.graphs, asked))
    with pytest.raises(ValueError):
        api.GraphStore.open(spark, str(tmp_path / "none"))


def test_a_search_reads_its_buckets_only(spark):
    store = api.GraphStore(a_graph(spark, range(12)), buckets=32)
    words = spark.createDataFrame([("w3",), ("colour",)], "token string")
    found, sizes = store.index.find(words)
    assert {(r.token, r.nodes) for r in sizes.collect()} == {(r.token, r["count"]) for r in store.postings.join(words, "token").groupBy("token").count().collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(token" in plan
    folders = lambda df: {r.p.split("bucket=")[1].split("/")[0] for r in df.select(F.col("_metadata.file_path").alias("p")).distinct().collect()}
    assert len(folders(store.index._pruned(words)(store.index.postings))) <= 2 < len(folders(store.index.postings))
    many = spark.range(600).select(F.concat(F.lit("w"), "id").alias("token"))
    assert {r.token for r in store.index.find(many)[0].collect()} == {f"w{i}" for i in range(12) if len(f"w{i}") > 1}
    assert store.index.find(words.limit(0))[0].count() == 0


@pytest.mark.parametrize("by", [[], ["k"]])
def test_as_of_equals_a_plain_loop(spark, by):
    import random

    rnd = random.Random(len(by))
    left = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(40)])) for i in range(80)]
    right = [(100 + i, rnd.choice(["a", "a", "c", None]), rnd.choice([None, *range(5, 40)]), i % 3) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "rid int, k string, since int, found int")
    got = {r.id: r.found and r.found.rid for r in asof.as_of(a.repartition(5), b.repartition(3), "t", "since", by, ["rid"]).collect()}
    for i, k, t in left:
        fits = [(since, rid) for rid, own, since, _ in right if since is not None and t is not None and since <= t and (not by or k is not None and own == k)]
        assert got[i] == (max(fits)[1] if fits else None), (i, k, t)
    assert asof.as_of(a, b.limit(0), "t", "since", by).where("found is not null").count() == 0 and asof.as_of(a.limit(0), b, "t", "since", by).count() == 0
