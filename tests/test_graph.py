import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cycles, dead, graph, traverse

NODE = "id string, label string, name string, file_path string"
EDGE = "src string, edge string, target string, line int"


def golden(spark):
    nodes = [("loaders.py::save_characters", "Function", "save_characters", "loaders.py"), ("save_characters", "Target", "save_characters", None), ("player.py::import::m::save_characters", "Import", None, "player.py")]
    nodes += [("player.py", "File", "player.py", "player.py"), ("player.py::create_character_form", "Function", "create_character_form", "player.py"), ("player.py::display_character_list", "Function", "display_character_list", "player.py")]
    edges = [("player.py", "IMPORTS", "player.py::import::m::save_characters", None), ("player.py::create_character_form", "CALLS", "save_characters", 3), ("player.py::create_character_form", "CALLS", "save_characters", 9), ("player.py::display_character_list", "CALLS", "save_characters", 5)]
    return graph.PropertyGraph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE))


def test_golden_blast_radius(spark):
    g = golden(spark)
    start = traverse.anchors(g.nodes, ["save_characters"])
    found = traverse.bfs(g, start, "incoming", None, 30, True, expand_raw=True).join(g.nodes, "id")
    assert found.count() == 6
    assert found.agg(F.countDistinct(F.coalesce("file_path", F.lit("unknown")))).first()[0] == 3


def test_null_names_vanish_with_boilerplate(spark):
    g = golden(spark)
    hop = traverse.one_hop(g, g.nodes.where("id = 'player.py'"), "outgoing", None, None, True)
    assert hop.count() == 0
    assert traverse.one_hop(g, g.nodes.where("id = 'player.py'"), "outgoing", None, None, False).count() == 1


def test_normalize_symbols():
    assert traverse.normalize_symbols("a, 'b' a\"c") == ["a", "b", 'a"c']
    assert traverse.normalize_symbols([]) == traverse.normalize_symbols(" , ") == traverse.normalize_symbols(None) == ["unknown"]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, target string")


def test_cycles_on_hand_made_graphs(spark):
    e = edges(spark, [("a", "a"), ("b", "c"), ("c", "b"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "y"), ("x", "z"), ("y", "w"), ("z", "w"), ("c", "d"), ("b", "c"), (None, "q")])
    found = {r["id"]: r["component"] for r in cycles.components(e).collect()}
    assert found["b"] == found["c"] == "b" and found["d"] == found["e"] == found["f"] == "d" and found["a"] == "a" and found["w"] == "w"
    assert {tuple(r) for r in cycles.cyclic_components(e).collect()} == {("a", 1), ("b", 2), ("d", 3)}
    assert {tuple(r) for r in cycles.simple_cycles(e, 5).collect()} == {("b -> c", 2), ("d -> e -> f", 3)}


def test_cycles_of_nothing(spark):
    e = edges(spark, [("a", "b")])
    assert cycles.cyclic_components(e).count() == 0 and cycles.simple_cycles(e).count() == 0
    assert cycles.components(e.where("false")).count() == 0


def test_nested_component_within_colour(spark):
    # The colour of the smallest id covers nodes that do not lead back to it.
    e = edges(spark, [("a", "m"), ("m", "n"), ("n", "m"), ("n", "z"), ("z", "y"), ("y", "z")])
    found = {r["id"]: r["component"] for r in cycles.components(e).collect()}
    assert found == {"a": "a", "m": "m", "n": "m", "y": "y", "z": "y"}


def test_components_have_no_last_round(spark, monkeypatch):
    # Each pair frees one round later than the one before it, whatever number of rounds a counted loop may have.
    monkeypatch.setattr(cycles, "range", lambda n: range(min(n, 1)), raising=False)
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "e")])
    assert {tuple(r) for r in cycles.cyclic_components(e).collect()} == {("a", 2), ("c", 2), ("e", 2)}


def test_dead_entities(spark):
    g = golden(spark)
    assert {r["id"] for r in dead.dead_by_degree(g, ["CALLS", "IMPORTS"], ["Function"]).collect()} == {"loaders.py::save_characters", "player.py::create_character_form", "player.py::display_character_list"}
    live = g.nodes.where("id = 'player.py::create_character_form'").select("id")
    assert dead.dead_by_reach(g, live, ["CALLS"], ["Target", "File"]).count() == 1


def test_upsert_takes_last_and_its_nulls(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), (None, 9, "z")], "id string, seq int, v string")
    assert [tuple(r) for r in graph.upsert_nodes(rows, "id", ["seq"]).collect()] == [("a", 3, None)]


def test_ingest_keeps_lines_of_calls_only(spark):
    g = golden(spark)
    assert graph.ingest_edges(g.edges, g.nodes).count() == 4
    assert graph.duplicate_ids(g.nodes).count() == 0
    assert graph.placeholders(g.edges, g.nodes.where("label <> 'Target'"), "CALLS").collect()[0]["name"] == "save_characters"


def test_layered_ways_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    keys = {"a": range(150), "b": range(40), "c": range(30), "d": range(60)}
    kinds = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d"), ("b", "d")]
    drawn = [(a, b, [(rng.choice(keys[a]), rng.choice(keys[b])) for _ in range(70)]) for a, b in kinds]
    starts = {(x, k) for x in "abd" for k in keys[x] if k % 2}
    wanted = {"b": [1, 2, 3], "d": [*range(0, 50, 3), 999]}
    want = set()
    for s in starts:
        far, frontier = {s: 0}, {s}
        for n in (1, 2, 3):
            frontier = {(b, t) for a, b, links in drawn for f, t in links if (a, f) in frontier} - set(far)
            far |= dict.fromkeys(frontier, n)
        want |= {(f"{s[0]}{s[1]}", x, k, n) for (x, k), n in far.items() if n and k in wanted.get(x, ())}
    frame = lambda rows: spark.createDataFrame(rows, "src bigint, target bigint")
    links = [(a, b, frame(x + x[:9])) for a, b, x in drawn]
    sources = spark.createDataFrame([(f"{x}{k}", x, k) for x, k in starts] + [("a1", "a", 1)], "id string, label string, key bigint")
    sinks = {x: spark.createDataFrame([(k,) for k in [*v, v[0]]], "key bigint") for x, v in wanted.items()}
    for few in (10_000, 1):  # in the second round sources lie in many partitions and nothing is broadcast
        monkeypatch.setattr(traverse, "FEW", few)
        monkeypatch.setattr(traverse, "FEW_NODES", few)
        got = [tuple(r) for r in traverse.layered_paths(sources.repartition(3), sinks, links, 3).collect()]
        assert set(got) == want and len(got) == len(want) and {r[3] for r in want} == {1, 2, 3}
    with pytest.raises(ValueError, match="cycle"):
        traverse.layered_paths(sources, sinks, [*links, ("d", "a", frame([(1, 1)]))], 3)
    assert traverse.layered_paths(sources.where("false"), sinks, links, 3).count() == 0
