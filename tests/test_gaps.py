"""Scopes, orders, lineage, quotas and judging against brute force and fixed cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators import agent, cycles, evaluate, extract, graph, resolve, search, traverse
from loomgraph.streaming import quota

NODE = "id string, label string, name string, file_path string"
EDGE = "src string, edge string, target string, line int"


def first_above(bases, attributes, cls, name, seen=()):
    if name in attributes.get(cls, ()):
        return cls
    for b in bases.get(cls, ()):
        if b not in seen and (found := first_above(bases, attributes, b, name, (*seen, b))):
            return found
    return None


@pytest.mark.parametrize("hot_rows", [3])
def test_attributes_of_bases_in_their_order(spark, hot_rows):
    rng = random.Random(7)
    bases = {f"f::C{i}": [f"f::C{j}" for j in rng.sample(range(i), min(i, rng.randrange(4)))] for i in range(40)}
    bases |= {f"f::D{i}": [f"f::D{i - 1}"] for i in range(1, 36)} | {"f::L": ["f::M", "f::C3"], "f::M": ["f::L"]}
    attributes = {c: [a for a in "xyz" if rng.random() < 0.15] for c in [*bases, "f::D0"]} | {"f::D0": ["deep"]}
    uses = [(f"{c}.run", "USES_INSTANCE_ATTRIBUTE", a, None) for c in bases for a in ("x", "y", "z", "deep")]
    inherits = spark.createDataFrame([(c, b, i) for c, bs in bases.items() for i, b in enumerate(bs)], "src string, target string, position int")
    held = spark.createDataFrame([(f"{c}::inst_attr::{a}", a, c) for c, names in attributes.items() for a in names], "id string, name string, class_id string")
    got = {(r["src"], r["target"]) for r in resolve.attribute_uses(spark.createDataFrame(uses, EDGE), inherits, held, hot_rows).collect()}
    want = {(s, f"{c}::inst_attr::{a}") for s, _, a, _ in uses if (c := first_above(bases, attributes, s[:-4], a))}
    assert got == want and ("f::D35.run", "f::D0::inst_attr::deep") in got


def test_parameters_without_annotation_or_default_are_local(spark):
    files = spark.createDataFrame([("a.py", b"class A(B, metaclass = M): pass\ndef f(a, b: int, c=1, *d, e, g=2, **h):\n    return a, b, c, d, e, g, h\n")], "file_path string, content binary")
    tagged = extract.extract(files)
    assert {r["target"] for r in extract.edge_table(tagged).where("edge = 'USES_VARIABLE' and src = 'a.py::f'").collect()} == {"b", "c", "d", "g", "h"}
    assert extract.node_table(tagged, "Class").first()["signature"] == "(B, metaclass = M)"


def test_anchors_are_all_or_of_a_file(spark):
    nodes = spark.createDataFrame([(f"f{i}.py::go", "Function", "go", f"f{i}.py") for i in range(150)], NODE)
    assert traverse.anchors(nodes, ["go"]).count() == 150 and traverse.anchors(nodes, ["go"], limit=100).count() == 100
    assert [r["id"] for r in traverse.anchors(nodes, ["go"], file_path="f7.py").collect()] == ["f7.py::go"]
    assert traverse.anchors(nodes, ["go"], ["Class"]).count() == 0


def test_traversal_by_labels_and_without_raw_names(spark):
    nodes = spark.createDataFrame([("a", "Function", "a", None), ("b", "Class", "b", None), ("c", "Function", "c", None), ("t", "Target", "t", None), ("__x__", "Function", "__x__", None)], NODE)
    edges = spark.createDataFrame([("a", "CALLS", x, 1) for x in ("b", "c", "t", "__x__", "gone")] + [("b", "CALLS", "c", 2), ("t", "CALLS", "a", 3)], EDGE)
    walk = lambda **k: {r["id"] for r in traverse.bfs(graph.PropertyGraph(nodes, edges), nodes.where("id = 'a'"), "outgoing", **k).collect()}
    assert walk() == {"a", "b", "c", "t", "__x__"} and walk(labels=["Function"]) == {"a", "c", "__x__"}
    assert walk(include_raw=False, exclude_boilerplate=True) == {"a", "b", "c"}


def test_lineage_over_many_calls(spark):
    nodes = spark.createDataFrame([(x, "Function", x, None) for x in "fghk"], NODE)
    edges = spark.createDataFrame([("g", "RESOLVED_CALLS", "f", None), ("h", "RESOLVED_CALLS", "g", None), ("f", "RESOLVED_CALLS", "h", None), ("g", "CALLS", "m.f", 4), ("g", "CALLS", "f", 9)], EDGE)
    rows = {tuple(r) for r in traverse.parameter_lineage(graph.PropertyGraph(nodes, edges), nodes.where("id = 'f'")).collect()}
    assert rows == {("f", "g", 1, 4, "positional/inferred"), ("f", "g", 1, 9, "positional/inferred"), ("f", "h", 2, None, None)}


def test_cycles_of_a_symbol(spark):
    nodes = spark.createDataFrame([(x, "Function", n, None) for x, n in (("a", "Alpha"), ("b", "b"), ("c", "c"), ("d", "d"), ("e", "__init__"), ("r", "r"))], NODE)
    links = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("d", "e"), ("e", "d"), ("a", "r")]
    g = graph.PropertyGraph(nodes, spark.createDataFrame([(s, "RESOLVED_CALLS", t, None) for s, t in links], EDGE))
    pairs = cycles.cycle_input(g, ["RESOLVED_CALLS"])
    assert ("d", "e") not in {tuple(r) for r in pairs.collect()}
    found, wanted = cycles.components(pairs), cycles.matching(nodes, "ALPH")
    own = cycles.components_of(found, wanted)
    assert {r["id"] for r in own.collect()} == {"a", "b", "c"}
    every = cycles.simple_cycles(pairs, 6, own)
    assert {r["cycle"] for r in every.collect()} == {"a -> b", "b -> c"}
    assert {r["cycle"] for r in cycles.through(every, wanted).collect()} == {"a -> b"}
    assert cycles.components_of(found, cycles.matching(nodes, "nowhere")).count() == 0


def test_ids_that_occur_twice_are_an_error(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    with pytest.raises(ValueError, match="a"):
        graph.checked_ids(nodes)
    assert graph.checked_ids(nodes.distinct()).count() == 2
    with pytest.raises(ValueError, match="more than 2"):
        storage.bounded(nodes, 2)
    assert storage.bounded(nodes, 3).count() == 3


def test_usage_over_buckets_of_time(spark):
    rng = random.Random(3)
    times = [0, 60_000_000, 59_999_999, 119_999_999, 86_400_000_000, 86_399_999_999] + [rng.randrange(3 * 86_400_000_000) for _ in range(60)] + [rng.randrange(200_000_000) for _ in range(200)]
    rows = [(i, "k" if i % 3 else "m", t, rng.randrange(-2, 50)) for i, t in enumerate(times)] + [(999, None, 5, 1), (1000, "k", None, 1)]
    events = spark.createDataFrame(rows, "event_id bigint, key string, us bigint, n bigint")
    got = {r["event_id"]: (r["rpm"], r["tpm"], r["rpd"], r["oldest"]) for r in quota.usage(events, "key", F.col("n")).collect()}
    for i, k, t, _ in rows[:-1]:
        minute = [(u, max(n, 1)) for _, x, u, n in rows[:-1] if x == k and t - 60_000_000 < u <= t]
        day = [u for _, x, u, _ in rows[:-1] if x == k and t - 86_400_000_000 < u <= t]
        assert got[i] == (len(minute), sum(n for _, n in minute), len(day), min(u for u, _ in minute))
    assert set(got) == {r[0] for r in rows[:-1]}


def test_running_figures_over_ranges(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else "b", rng.random() < 0.5, rng.random() if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "i bigint, k string, ok boolean, s double").repartition(7)
    got = {r["i"]: (r["accuracy"], r["mean_latency"]) for r in evaluate.running(df, "i", "k", "ok", "s").collect()}
    for i, k, _, _ in rows:
        own = [r for r in rows[: i + 1] if r[1] == k]
        late = [r[3] for r in own if r[3] is not None]
        assert got[i][0] == pytest.approx(sum(r[2] for r in own) / len(own))
        assert got[i][1] == (pytest.approx(sum(late) / len(late)) if late else None)
    assert evaluate.running(df.where("false"), "i", "k", "ok", "s").count() == 0


def test_router_waits_cools_down_and_gives_up():
    now, slept, asked = [0], [], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += int(seconds * 1e6)

    def call(model, prompt):
        asked.append(model)
        if model == "b-lite" and len(asked) == 1:
            raise RuntimeError("429 RESOURCE_EXHAUSTED")
        return f"{model} says", 10

    router = quota.Router({"a": (1, 1000, 10), "b-lite": (5, 1000, 10)}, call, lambda m: "lite" in m, lambda: now[0], sleep)
    # The preferred model stays the first choice while it cools down, and no model has to be waited for: it is asked again.
    assert router.generate("hello", 10) == "b-lite says" and asked == ["b-lite", "b-lite"]
    busy = quota.Router({"a": (1, 1000, 10)}, lambda m, p: ("x", 5), clock=lambda: now[0], sleep=sleep)
    slept.clear()
    assert busy.generate("x", 1) == "x" and busy.generate("x", 1) == "x" and slept == [pytest.approx(60.1)]
    failing = quota.Router({"a": (5, 1000, 10)}, lambda m, p: 1 / 0, clock=lambda: now[0], sleep=sleep)
    with pytest.raises(RuntimeError):
        failing.generate("x")
    tracker = quota.Tracker(2, 100, 5)
    tracker.failed(0, "oops")
    assert tracker.capacity(5_000_000) == 0 and tracker.wait(4_000_000) == 6 and not tracker.can(9_999_999, 1) and tracker.can(10_000_000, 1)
    tracker.record(10_000_000, 50)
    assert tracker.capacity(10_000_001) == pytest.approx(0.5)


def test_judging_by_a_model_and_by_words(spark):
    def model(prompt):
        if "Q1" in prompt:
            return '```json\n{"is_correct": true, "confidence_score": 0.9, "verdict_reason": "same", "key_entities_matched": ["a"], "missing_or_incorrect": []}\n```'
        if "Q2" in prompt:
            raise RuntimeError("down")
        return "no idea"

    rows = spark.createDataFrame([("Q1", "`x`", "y"), ("Q2", "`load` and `save`", "Load it, SAVE it"), ("Q3", "`load`", None)], "q string, t string, a string")
    got = {r["q"]: r["verdict"] for r in evaluate.judge_with_model(rows, "q", "t", "a", model).collect()}
    assert (got["Q1"]["is_correct"], got["Q1"]["judged_by"], got["Q1"]["matched_entities"]) == (True, "model", ["a"])
    assert (got["Q2"]["is_correct"], got["Q2"]["judged_by"], got["Q2"]["matched_entities"]) == (True, "words", ["load", "save"])
    assert (got["Q3"]["is_correct"], got["Q3"]["missing"]) == (False, ["load"])
    traces = spark.createDataFrame([("Q1", 2, "b"), ("Q1", 1, "a"), ("Q2", 1, None)], "q string, step int, tool string")
    assert {r["q"]: r["tools_called"] for r in evaluate.records(rows, traces, "q", "step", "tool").collect()} == {"Q1": ["a", "b"], "Q2": [], "Q3": []}
    assert evaluate.with_version(rows, "/").first()["version"] == "latest_unversioned"


def test_evaluations_in_words():
    assert agent.parse_evaluation('Sure:\n```json\n{"sufficient": false, "failed_steps": [1, "2"], "missing": ["x"]}\n```') == {"sufficient": False, "failed_steps": [1, 2], "missing": ["x"]}
    assert agent.parse_evaluation("no") is None and agent.parse_evaluation('{"sufficient": "yes"}') is None and agent.parse_evaluation(None) is None
    said = iter(['{"sufficient": false, "failed_steps": [1], "missing": ["the caller"]}', "unusable"])
    asked = []
    a = agent.Agent({"t": lambda: {"results": [{"name": "f"}]}}, lambda q, bad: asked.append(list(bad)) or '{"steps": [{"tool": "t"}]}', lambda q, r: next(said))
    a.ask("?")
    assert [t["status"] for t in a.trace] == ["PRUNED", "VERIFIED"] and "missing: the caller" in asked[1]


def test_stored_index_scores_as_the_texts_do(spark):
    docs = spark.createDataFrame([(1, "Load the rows, load them"), (2, "rows"), (3, ""), (4, None), (5, "other words here")], "id bigint, text string")
    index = search.postings(docs, "id", "text")
    texts, words = 5, sum(r["len"] for r in index.select("id", "len").distinct().collect())
    plain = {tuple(r) for r in search.bm25(docs, "id", "text", ["load", "ROWS"]).collect()}
    assert {tuple(r) for r in search.bm25_index(index, "id", ["load", "ROWS"], texts, words).collect()} == plain and len(plain) == 2
    own = search.embed(docs, "text", model=lambda batch: np.array([[len(t), 1.0] for t in batch]))
    assert {r["id"]: list(r["vector"]) for r in own.collect()}[2] == [4.0, 1.0]
