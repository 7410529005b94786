"""The graph queries over whole tables against brute force on a small fixture."""

from itertools import permutations

import pytest
from compare import DATA

from loomgraph.plans import registry
from loomgraph.schemas import BUILTINS
from loomgraph.sources import corpus


def result(spark, name):
    return {tuple(r) for r in registry.QUERIES[name](spark, DATA).collect()}


@pytest.fixture(scope="module")
def tpch(spark):
    g = corpus.tpch_graph(spark, DATA)
    return {r["id"]: r for r in g.nodes.collect()}, {tuple(r) for r in g.edges.select("src", "edge", "target", "line").collect()}


def levels(edges, start, depth):
    far, frontier = {start: 0}, {start}
    for d in range(1, depth + 1):
        frontier = {t for s in frontier for t in edges.get(s, ()) if t not in far}
        far |= dict.fromkeys(frontier, d)
    return far


def test_shortest_ways_from_every_order(spark, tpch):
    nodes, edges = tpch
    out = {}
    for s, _, t, _ in edges:
        out.setdefault(s, set()).add(t)
    sinks = {i for i, r in nodes.items() if r["label"] == "Nation" or any(x in (r["name"] or "") for x in ("NATION_7", "EUROPE", "ASIA"))}
    want = {(s, t, d) for s, r in nodes.items() if r["label"] == "Order" for t, d in levels(out, s, 4).items() if d and t in sinks}
    assert result(spark, "taint_shortest") == want


def test_what_no_urgent_order_leads_to(spark, tpch):
    nodes, edges = tpch
    out = {}
    for s, _, t, _ in edges:
        out.setdefault(s, set()).add(t)
    urgent = [f"Order::{r[0]}" for r in spark.read.parquet(f"{DATA}/orders.parquet").where("o_orderpriority = '1-URGENT'").select("o_orderkey").collect()]
    live = set().union(*(levels(out, s, 15) for s in urgent))
    assert result(spark, "dead_reachability") == {(i, r["label"]) for i, r in nodes.items() if r["label"] in ("Customer", "Part", "Supplier", "Nation") and i not in live}


def test_all_edges_whose_ends_exist(spark, tpch):
    nodes, edges = tpch
    classes = {r[0] for r in spark.read.parquet(f"{DATA}/class_nodes.parquet").select("id").collect()}
    current = {}
    for r in spark.read.parquet(f"{DATA}/inheritance_map.parquet").orderBy("ingest_seq").collect():
        current[r["child_id"]] = r["parent_id"]
    links = {(c, "INHERITS_FROM", p, None) for c, p in current.items()}
    ids = set(nodes) | classes
    want = {x for x in {(s, e, t, n if e == "HAS_ITEM" else None) for s, e, t, n in edges} | links if x[0] in ids and x[2] in ids}
    columns = ["src", "edge", "target", "line"]
    assert {tuple(r) for r in registry.QUERIES["edge_ingest_inner_dedupe"](spark, DATA).select(*columns).collect()} == want
    assert not links <= want


def test_raw_calls_of_every_file(spark):
    rows = spark.read.parquet(f"{DATA}/import_nodes.parquet").select("file_path", "module").collect()
    dull = lambda x: x.startswith("__") and x.endswith("__") or x in BUILTINS
    want = {(f, m) for f, m in rows if f is not None and m is not None and not dull(m)}
    assert result(spark, "raw_calls") == want


def test_cycles_of_up_to_six(spark):
    edges = {tuple(r) for r in corpus.event_graph(spark, DATA).collect()}
    groups = {}
    for x in {x for e in edges for x in e}:
        groups.setdefault(x.rpartition("#")[2], []).append(x)
    want = {p for ids in groups.values() for n in range(2, 7) for p in permutations(sorted(ids), n) if p[0] == min(p) and all(e in edges for e in zip(p, p[1:] + p[:1]))}
    assert result(spark, "simple_cycles") == {(" -> ".join(p), len(p)) for p in want}
    assert max(map(len, want)) > 4
    label = lambda x: "Class" if x[0] == "c" else "Function" if x[0] == "p" else "File"
    kinds = [{label(x) for x in p} for p in want]
    kind = {"File": "file_import", "Function": "function_call", "Class": "class_instantiation"}
    names = ["heterogeneous" if len(k) > 1 else kind[next(iter(k))] for k in kinds]
    assert result(spark, "cycle_types") == {(k, names.count(k)) for k in names}
