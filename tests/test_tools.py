import json

import pytest

from loomgraph.operators.evaluate import summary  # noqa: F401
from loomgraph.plans import tools
from loomgraph.sources import sinks

APP = '''import os
from lib.store import Store, load

LIMIT = 3


class Cached(Store):
    def fetch(self, key):
        return load(self.path, LIMIT)


@api.get("/items")
def request_items(key):
    return Cached().fetch(key)


def main():
    request_items(os.getenv("APP_KEY", "none"))


def unused():
    pass
'''
STORE = '''from app import main


class Store:
    def __init__(self):
        self.path = "x"


def load(path, limit):
    """Loads the rows of a path."""
    return execute(path)


def execute(path):
    return execute_more(path)


def execute_more(path):
    return execute(path)


def test_load():
    load("a", 1)
'''


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("src"), str(tmp_path_factory.mktemp("out"))
    (root / "lib").mkdir()
    (root / "app.py").write_text(APP)
    (root / "lib" / "store.py").write_text(STORE)
    (root / "broken.py").write_text("def f(:")
    assert tools.ingest(spark, str(root), out) == {"processed": 2, "failed": 1}
    return out


@pytest.fixture(scope="module")
def g(spark, folder):
    return tools.CodeGraph.load(spark, folder)


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_calls_cross_files(g):
    got = rows(tools.traverse_call_graph(g, "load"), "id", "distance")
    assert ("lib/store.py::load", 0) in got and ("lib/store.py::test_load", 1) in got and ("app.py::Cached.fetch", 1) in got
    assert ("lib/store.py", "app.py") in rows(g.edges.where("edge = 'FILE_IMPORTS'"), "src", "target")


def test_blast_radius(g):
    files = rows(tools.calculate_blast_radius(g, "load"), "file")
    assert ("app.py",) in files and ("lib/store.py",) in files


def test_lineage_and_state(g):
    assert rows(tools.trace_parameter_lineage(g, "load", "limit"), "caller") == {("app.py::Cached.fetch",), ("lib/store.py::test_load",)}
    assert rows(tools.trace_parameter_lineage(g, "load", "none"), "caller") == set()
    assert rows(tools.query_state_references(g, "APP_KEY"), "kind", "user") == {("EnvVar", "app.py::main")}
    assert rows(tools.query_state_references(g, "path"), "kind", "user") == {("InstanceAttribute", "app.py::Cached.fetch"), ("InstanceAttribute", "lib/store.py::Store.__init__")}
    assert ("Variable", "app.py::Cached.fetch") in rows(tools.query_state_references(g, "LIMIT"), "kind", "user")
    assert rows(tools.query_state_references(g, "nothing"), "kind") == set()


def test_types_snippets_endpoints(g):
    assert rows(tools.inspect_type_hierarchy(g, "Cached"), "relation", "id") == {("ancestor", "lib/store.py::Store"), ("method", "app.py::Cached.fetch")}
    assert rows(tools.get_symbol_code_snippet(g, "Cached"), "node_id", "chunk_type") == {("app.py::Cached", "class")}
    assert rows(tools.get_symbol_code_snippet(g, "zzz"), "node_id") == set()
    assert rows(tools.query_api_endpoints(g, "/it", "get"), "id", "http_method") == {("app.py::request_items", "GET")}


def test_cycles_dead_code_tests_and_paths(g):
    found = rows(tools.analyze_architecture_coupling(g), "cycle")
    assert ("app.py -> lib/store.py",) in found and ("lib/store.py::execute -> lib/store.py::execute_more",) in found
    assert ("app.py::unused",) in rows(tools.detect_dead_code(g, "function", by_reach=False), "id")
    assert rows(tools.detect_dead_code(g, "file"), "id") == set()
    assert ("app.py::request_items", "lib/store.py::execute", 2) not in rows(tools.trace_taint_paths(g), "source", "sink", "hops")
    assert ("lib/store.py::load", "lib/store.py::execute", 1) in rows(tools.trace_taint_paths(g, "load", "execute"), "source", "sink", "hops")
    assert rows(tools.query_test_traceability(g, "execute"), "id") == {("lib/store.py::test_load",)}


def test_search(g):
    assert tools.search_codebase(g, "loads the rows of a path", 3).first()["node_id"] in {"lib/store.py::load", "lib/store.py"}
    assert tools.search_codebase(g, "42").count() <= 5


def test_clear_and_reports(spark, folder, tmp_path):
    items = [{"id": "Q1", "is_correct": True, "reason": "a|b" + "x" * 100, "question": "q"}]
    sinks.write_report({"total": 1}, items, str(tmp_path / "r.json"), str(tmp_path / "r.md"))
    assert json.loads((tmp_path / "r.json").read_text())["summary"] == {"total": 1}
    text = (tmp_path / "r.md").read_text()
    assert "| Q1 | PASS | a\\|b" in text and "..." in text
    sinks.write_tables({"t": spark.range(3)}, str(tmp_path / "w"))
    assert sinks.clear(spark, str(tmp_path / "w"), ["t", "u"]) == ["t"]
