import random

from loomgraph.operators import hierarchy as H

CLASS = "id string, file_path string, bases array<string>, ingest_seq bigint"
LINK = "child_id string, parent_id string, ingest_seq bigint"
IMPORT = "file_path string, module string, imported_symbol string, alias string"


def brute(links):
    out = {}
    for x in {*links, *links.values()}:
        path, seen = [x], {x}
        while path[-1] in links and links[path[-1]] not in seen:
            path.append(links[path[-1]])
            seen.add(path[-1])
        out[x] = None if path[-1] in links else path[::-1]
    return out


def test_random_forests_with_cycles(spark):
    rng = random.Random(5)
    links = {}
    for i in range(1, 120):
        links[f"n{i}"] = f"n{rng.randrange(i)}" if rng.random() < 0.6 else f"n{i - 1}"
    links.update({"a": "b", "b": "c", "c": "a", "d": "a", "e": "d", "s": "s"})
    rows = {r["id"]: r for r in H.hierarchy(spark.createDataFrame(list(links.items()), "id string, parent string")).collect()}
    want = brute(links)
    assert set(rows) == set(want)
    for x, path in want.items():
        r = rows[x]
        if path is None:
            assert (r["root_id"], r["depth"], r["path"], r["first"]) == ("cycle", -1, None, None)
        else:
            below = {y for y, p in want.items() if p and x in p and y != x}
            assert (r["root_id"], r["depth"], r["path"]) == (path[0], len(path) - 1, path)
            assert r["descendants"] == len(below)
            assert below == {y for y in rows if rows[y]["root_id"] == r["root_id"] and rows[y]["first"] is not None and r["first"] < rows[y]["first"] <= r["last"]}


def test_roots_and_depths_without_paths(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")], "id string, parent string")
    assert {tuple(r) for r in H.hierarchy(links, paths=False).collect()} == {("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("x", "cycle", -1), ("y", "cycle", -1), ("z", "cycle", -1)}


def test_hot_parents_and_chains_are_spread(spark):
    rows = [(f"w{i}", "top") for i in range(60)] + [(f"c{i}", f"c{i - 1}" if i else "top") for i in range(60)] + [(f"v{i}", "c3") for i in range(40)] + [("l", "l2"), ("l2", "l")]
    links = spark.createDataFrame(rows, "id string, parent string")
    plain, spread = ({tuple(map(str, r)) for r in H.hierarchy(links, hot_rows=n).collect()} for n in (H.HOT_ROWS, 3))
    assert plain == spread and len(plain) == 163


def test_descendants_from_intervals(spark):
    rng = random.Random(9)
    links = {f"n{i}": f"n{rng.randrange(max(0, i - 40), i)}" for i in range(1, 700)} | {f"m{i}": "m" for i in range(50)} | {"l": "l"}
    want = {(a, x, len(p) - 1 - i) for x, p in brute(links).items() if p for i, a in enumerate(p[:-1])}
    found = H.descendant_pairs(H.hierarchy(spark.createDataFrame(list(links.items()), "id string, parent string"))).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_long_chain_and_wide_parent(spark):
    links = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, 70)] + [(f"w{i}", "c0") for i in range(300)], "id string, parent string")
    rows = {r["id"]: r for r in H.hierarchy(links).collect()}
    assert rows["c69"]["depth"] == 69 and rows["c0"]["descendants"] == 369
    assert sorted(r["first"] for r in rows.values()) == list(range(370))


def test_no_links(spark):
    empty = spark.createDataFrame([], "id string, parent string")
    assert H.hierarchy(empty).collect() == []
    assert [tuple(r)[:3] for r in H.hierarchy(empty, spark.createDataFrame([("a",), (None,), ("a",)], "id string")).collect()] == [("a", "a", 0)]
    assert H.hierarchy(empty, paths=False).collect() == [] and H.descendant_pairs(H.hierarchy(empty)).collect() == []


def test_parents_by_link_and_by_base(spark):
    classes = spark.createDataFrame(
        [
            ("r/a.py::A", "r/a.py", [], 1), ("r/a.py::B", "r/a.py", ["Unknown", "A"], 1), ("r/b.py::C", "r/b.py", ["A"], 1), ("r/b.py::D", "r/b.py", ["m.A"], 1), ("r/p/c.py::E", "r/p/c.py", ["X"], 1),
            ("r/b.py::F", "r/b.py", ["A"], 1), ("r/b.py::G", "r/b.py", None, 2), ("r/b.py::G", "r/b.py", ["A"], 1), ("r/p/d.py::X", "r/p/d.py", None, 1), (None, "r/b.py", ["A"], 1), ("r/b.py::H", "r/b.py", [None, "", "A"], 1),
        ], CLASS,
    )
    links = spark.createDataFrame([(".//r\\b.py::F ", "r/b.py::C", 3), ("r/b.py::F", None, 1), ("r/b.py::C", "gone.py::Z", 1), ("gone.py::Y", "r/a.py::A", 1), (None, "r/a.py::A", 1)], LINK)
    imports = spark.createDataFrame([("r/b.py", "a", "A", None), ("r/b.py", "a", None, "m"), ("r/p/c.py", ".d", "X", None), ("r/b.py", None, "A", None)], IMPORT)
    got = {tuple(r) for r in H.parent_links(classes, links, imports).collect()}
    assert got == {("r/a.py::B", "r/a.py::A"), ("r/b.py::C", "r/a.py::A"), ("r/b.py::D", "r/a.py::A"), ("r/p/c.py::E", "r/p/d.py::X"), ("r/b.py::F", "r/b.py::C"), ("r/b.py::H", "r/a.py::A")}
