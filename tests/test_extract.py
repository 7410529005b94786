from loomgraph.operators import extract, resolve
from loomgraph.sources import code

SOURCE = '''"""Module."""
# top
import os, sys as system
from a.b import c as d, e
x, (y, *z) = 1, (2, 3)
if x:
    w = 1
else:
    v: int = 2


@deco(x)
class K(Base, meta.M, metaclass=T):
    """Doc."""
    p = q = 1

    async def m(self, a, /, *args, k=1, **kw):
        """Method."""
        self.t, other = a, 2  # inside
        def inner():
            return self.t
        return os.environ["E1"], os.getenv("E2", default="z"), os.environ.get("E3", "d")
'''


def rows(spark, *sources):
    files = spark.createDataFrame([(f"f{i}.py", s) for i, s in enumerate(sources)], "file_path string, content binary")
    return extract.extract(files)


def test_nodes_of_a_file(spark):
    t = rows(spark, SOURCE.encode()).cache()
    names = lambda label: sorted(r["name"] for r in extract.node_table(t, label).collect())
    assert names("Variable") == ["v", "w", "x", "y", "z"]
    assert names("Parameter") == ["**kw", "*args", "a", "k", "self"]
    assert names("ClassAttribute") == ["p", "q"] and names("InstanceAttribute") == ["t"]
    cls = extract.node_table(t, "Class").first()
    assert cls["bases"] == ["Base", "meta.M"] and cls["signature"] == "(Base, meta.M, metaclass=T)"
    assert {r["id"] for r in extract.node_table(t, "Function").collect()} == {"f0.py::K.m", "f0.py::K.inner"}
    assert {(r["env_name"], r["default_value"]) for r in extract.node_table(t, "EnvVarUsage").collect()} == {("E1", None), ("E2", "z"), ("E3", "d")}
    assert {(r["module"], r["imported_symbol"], r["alias"]) for r in extract.node_table(t, "Import").collect()} == {("os", None, None), ("sys", None, "system"), ("a.b", "c", "d"), ("a.b", "e", None)}
    assert extract.comments_of(t, "Function").where("id = 'f0.py::K.m'").first()["comments"] == ["inside"]


def test_bad_files_are_errors_and_empty_ones_are_files(spark):
    t = rows(spark, b"def f(:\n", b"", None, "x = 'é'\r\n".encode("latin-1"), b"\x00")
    assert {r["file_path"] for r in t.where("kind = '_error'").collect()} == {"f0.py", "f4.py"}
    assert {r["id"] for r in extract.node_table(t, "File").collect()} == {"f1.py", "f2.py", "f3.py"}
    assert rows(spark).count() == 0


def test_resolution_of_self_and_aliases(spark):
    edges = spark.createDataFrame([("f.py::K.m", "CALLS", "self.n", 1), ("f.py::g", "CALLS", "self.n", 2), ("f.py::g", "CALLS", "h", 3), ("f.py", "CALLS", "local", 4), ("f.py::g", "CALLS", "mod.fn", 5)], "src string, edge string, target string, line int")
    imports = spark.createDataFrame([("f.py", "pkg.x", "h", None), ("f.py", "pkg.y", None, "mod")], "file_path string, module string, imported_symbol string, alias string")
    aliases = resolve.alias_targets(imports, strict_reference=True)
    got = {r["line"]: r["resolved"] for r in resolve.resolved_targets(edges, aliases).collect()}
    assert got == {1: "f.py::K.n", 2: None, 3: "pkg/x.py::h", 4: "f.py::local", 5: "pkg/y.py::fn"}


def test_attribute_lookup_ends_in_cyclic_bases(spark):
    edges = spark.createDataFrame([("f::A.m", "USES_INSTANCE_ATTRIBUTE", "x", None), ("f::A.m", "USES_INSTANCE_ATTRIBUTE", "none", None)], "src string, edge string, target string, line int")
    inherits = spark.createDataFrame([("f::A", "f::B"), ("f::B", "f::A"), ("f::B", "f::C"), ("f::A", "f::A")], "src string, target string")
    attributes = spark.createDataFrame([("f::C::inst_attr::x", "x", "f::C")], "id string, name string, class_id string")
    assert [tuple(r) for r in resolve.attribute_uses(edges, inherits, attributes).collect()] == [("f::A.m", "RESOLVED_USES_INST_ATTR", "f::C::inst_attr::x")]


def test_scan_of_a_folder(spark, tmp_path):
    for p in ("a.py", "sub/b.py", "venv/c.py", "sub/d.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x = 1\r\ny = 2\n")
    found = code.scan(spark, str(tmp_path))
    assert {r["file_path"] for r in found.collect()} == {"a.py", "sub/b.py"}
    assert {r["line_count"] for r in code.with_lines(found).collect()} == {2}
    assert code.scan(spark, str(tmp_path / "missing")).count() == 0
