"""Breadth-first traversal of property graphs, and the tools that are made of it.

Links that may be taken are written once; a level is one join of the frontier with them and one anti join with what was visited, over ids. Levels are checkpointed. The
frontier may be any size: Spark broadcasts it while it measures small and shuffles it otherwise.
"""

from __future__ import annotations

import re
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.schemas import BUILTINS, RAW_LABELS
from loomgraph.storage import checkpointed


def normalize_symbols(symbols: str | list[str] | None) -> list[str]:
    """Symbols from a list or a string with commas or blanks, each once and in order; ``["unknown"]`` if there are none."""
    parts = re.split(r"[,\s]+", symbols) if isinstance(symbols, str) else list(symbols or [])
    kept = dict.fromkeys(x for x in (p.strip(" ,'\"") for p in parts) if x)
    return list(kept) or ["unknown"]


def is_boilerplate(name: Column) -> Column:
    """Dunder names and common builtins. Null for a null name, so that a filter on its negation drops such rows."""
    return (name.startswith("__") & name.endswith("__")) | name.isin(*BUILTINS)


def anchors(nodes: DataFrame, symbols: list[str], labels: list[str] | None = None, limit: int | None = None, file_path: str | None = None) -> DataFrame:
    """The nodes that symbols mean: by name, by id, or by the end of an id after a dot or ``::``; all of them, or the first ``limit`` by id.

    ``file_path``: only nodes of that file, or whose id begins so.
    Symbols come from a caller, so they are few; an id's possible ends are compared as equalities, not as a theta join.
    """
    c = F.col("id")
    ends = F.filter(F.array(F.regexp_extract(c, r"\.([^.:]+)$", 1), F.regexp_extract(c, r"::([^:]+)$", 1), F.regexp_extract(c, r"::inst_attr::(.+)$", 1)), lambda x: x != "")
    hit = F.col("name").isin(*symbols) | c.isin(*symbols) | F.exists(ends, lambda x: x.isin(*symbols))
    for s in symbols:
        hit = hit | c.endswith("." + s) | c.endswith("::" + s)
    rows = nodes.where(hit)
    rows = rows.where(F.col("label").isin(*labels)) if labels else rows
    if file_path:
        rows = rows.where(F.coalesce(F.col("file_path") == file_path, F.lit(False)) | c.startswith(file_path))
    rows = rows.dropDuplicates(["id"])
    return rows.orderBy("id").limit(limit) if limit else rows


def one_hop(graph: PropertyGraph, frontier: DataFrame, direction: str, edge_types: list[str] | None = None, labels: list[str] | None = None, exclude_boilerplate: bool = True) -> DataFrame:
    """(id, edge, line, neighbor, neighbor_label, neighbor_name) of the edges into or out of the frontier (id)."""
    near, far = ("target", "src") if direction == "incoming" else ("src", "target")
    edges = graph.edges.where(F.col("edge").isin(*edge_types)) if edge_types else graph.edges
    nodes = graph.nodes.select(F.col("id").alias(far), F.col("label").alias("neighbor_label"), F.col("name").alias("neighbor_name"))
    rows = edges.join(frontier.select(F.col("id").alias(near)).distinct(), near).join(nodes, far)
    rows = rows.where(F.col("neighbor_label").isin(*labels)) if labels else rows
    rows = rows.where(~is_boilerplate(F.col("neighbor_name"))) if exclude_boilerplate else rows
    return rows.select(F.col(near).alias("id"), "edge", "line", F.col(far).alias("neighbor"), "neighbor_label", "neighbor_name")


def bfs(graph: PropertyGraph, start: DataFrame, direction: str = "incoming", edge_types: list[str] | None = None, max_depth: int = 4, exclude_boilerplate: bool = False, expand_raw: bool = False, labels: list[str] | None = None, include_raw: bool = True) -> DataFrame:
    """(id, distance, parent, edge): every node within ``max_depth`` (1 to 30) links of the start, once, at its least distance.

    parent and edge are those of the smallest (edge, parent id) that reaches it at that distance. Placeholders of names
    are reached but not passed, unless ``expand_raw``, and not even reached without ``include_raw``. With ``labels`` only nodes of these are reached. direction ``both`` is two traversals; a node in both takes the
    outgoing one's distance.
    """
    if direction == "both":
        inward = bfs(graph, start, "incoming", edge_types, max_depth, exclude_boilerplate, expand_raw, labels, include_raw)
        outward = bfs(graph, start, "outgoing", edge_types, max_depth, exclude_boilerplate, expand_raw, labels, include_raw)
        return outward.unionByName(inward.join(outward.select("id"), "id", "left_anti"))
    depth = max(1, min(max_depth, 30))
    none = F.lit(None).cast("string")
    seen = checkpointed(start.select("id").distinct().select("id", F.lit(0).alias("distance"), none.alias("parent"), none.alias("edge"), F.lit(False).alias("raw")))
    links, frontier = checkpointed(_links(graph, direction, edge_types, exclude_boilerplate, labels, include_raw)), seen
    for level in range(1, depth + 1):
        new = frontier.where("not raw").select("id").join(links, "id").join(seen.select(F.col("id").alias("neighbor")), "neighbor", "left_anti")
        best = F.min(F.struct("edge", "id", "raw")).alias("m")
        raw = F.lit(False) if expand_raw else F.col("m.raw")
        frontier = checkpointed(new.groupBy("neighbor").agg(best).select(F.col("neighbor").alias("id"), F.lit(level).alias("distance"), F.col("m.id").alias("parent"), F.col("m.edge").alias("edge"), raw.alias("raw")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % 8 == 0:
            seen = checkpointed(seen)
    return seen.select("id", "distance", "parent", "edge")


def _links(graph: PropertyGraph, direction: str, edge_types: list[str] | None, exclude_boilerplate: bool, labels: list[str] | None, include_raw: bool) -> DataFrame:
    """(id, neighbor, edge, raw): the links that a traversal may take. Labels and names are looked up here, once, so that levels join ids alone."""
    near, far = ("target", "src") if direction == "incoming" else ("src", "target")
    edges = graph.edges.where(F.col("edge").isin(*edge_types)) if edge_types else graph.edges
    raw = F.coalesce(F.col("label").isin(*RAW_LABELS), F.lit(False))
    nodes = graph.nodes.where(F.col("label").isin(*labels)) if labels else graph.nodes
    nodes = nodes.where(~is_boilerplate(F.col("name"))) if exclude_boilerplate else nodes
    nodes = nodes if include_raw else nodes.where(~raw)
    return edges.select(F.col(near).alias("id"), F.col(far).alias("neighbor"), "edge").join(nodes.select(F.col("id").alias("neighbor"), raw.alias("raw")), "neighbor").select("id", "neighbor", "edge", "raw")


def chains(found: DataFrame) -> DataFrame:
    """(id, distance, chain): the ids from each node of ``bfs`` back to the start, joined by `` -> ``."""
    levels = found.agg(F.max("distance")).first()[0]
    out = current = found.where("distance = 0").select("id", "distance", F.col("id").alias("chain"))
    for level in range(1, (levels or 0) + 1):
        above = current.select(F.col("id").alias("parent"), F.col("chain").alias("above"))
        current = found.where(F.col("distance") == level).join(above, "parent").select("id", "distance", F.concat_ws(" -> ", "id", "above").alias("chain"))
        out = out.unionByName(current)
    return out


def raw_calls(graph: PropertyGraph, frontier: DataFrame, direction: str = "outgoing") -> DataFrame:
    """(caller_id, line, target_name): links between the frontier and names that are no nodes, each once."""
    rows = one_hop(graph, frontier, direction, None, list(RAW_LABELS), True)
    caller, name = (F.col("id"), F.col("neighbor_name")) if direction == "outgoing" else (F.col("neighbor"), F.col("id"))
    return rows.select(caller.alias("caller_id"), "line", name.alias("target_name")).distinct()


def file_index(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, entries, symbols): what was found by file, as ``label name (hop n)`` in order; ``unknown`` without a file.

    The entries of a file are one row of output, so they are gathered; ``file_counts`` gives their number alone.
    """
    rows = found.join(nodes.select("id", "label", "name", "file_path"), "id")
    text = F.concat(F.col("label"), F.lit(" "), F.coalesce("name", F.lit("")), F.lit(" (hop "), F.col("distance").cast("string"), F.lit(")"))
    return rows.groupBy(F.coalesce("file_path", F.lit("unknown")).alias("file")).agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("entries"), F.count("*").alias("symbols"))


def blast_radius(graph: PropertyGraph, symbols: str | list[str], max_depth: int = 30, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What a change of symbols affects: the nodes with distances (anchors at 0 count), and (symbols, files) of them."""
    found = bfs(graph, anchors(graph.nodes, normalize_symbols(symbols)), "incoming", edge_types, max_depth, True)
    rows = found.join(graph.nodes, "id")
    file = F.coalesce("file_path", F.lit("unknown")) if "file_path" in graph.nodes.columns else F.lit("unknown")
    return rows, rows.agg(F.count("*").alias("symbols"), F.countDistinct(file).alias("files"))


def shortest_paths(graph: PropertyGraph, sources: DataFrame, sinks: DataFrame, edge_types: list[str], max_depth: int = 5) -> DataFrame:
    """(source, sink, hops) of the shortest way from each source to each sink that it reaches within ``max_depth`` links.

    All sources go level by level together; a (source, node) pair is visited once.
    """
    edges = graph.edges.where(F.col("edge").isin(*edge_types)).select("src", "target").distinct()
    seen = checkpointed(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct())
    frontier = seen
    for level in range(1, max_depth + 1):
        new = frontier.select("source", F.col("node").alias("src")).join(edges, "src").select("source", F.col("target").alias("node")).distinct()
        frontier = checkpointed(new.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0").join(sinks.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("source", F.col("node").alias("sink"), "hops")


#: Sources that are sent to all tasks, and nodes on the way that are.
FEW, FEW_NODES = 10_000, 100_000


def layered_paths(sources: DataFrame, sinks: dict[str, DataFrame], links: list[tuple[str, str, DataFrame]], max_depth: int = 5) -> DataFrame:
    """(source, label, key, hops) as of ``shortest_paths``, where links lead from label to label without a cycle: each link is followed once, for all sources and levels.

    ``sources``: (id, label, key); ``sinks``: by label (key), null for none; ``links``: label of src, label of target, (src, target), in any number of copies. A node is told by its label and key.
    Labels are settled in the order of their links. A node has one row for each 64 sources: ``d0``, ``d1`` and so on are bits of those that some way of so many
    links leads from. So a link moves bits instead of pairs, and pairs are made of the bits of the sinks alone, without a shuffle.
    """
    order = list(TopologicalSorter({label: {a for a, b, _ in links if b == label} for x in links for label in x[:2]}).static_order())
    found = checkpointed(sources.where("key is not null").select("id", "label", "key").dropDuplicates(["label", "key"]))
    few = found.limit(FEW + 1).count() <= FEW
    numbered = (found.coalesce(1) if few else found).withColumn("n", F.monotonically_increasing_id())
    numbered = checkpointed(numbered.select("id", "label", "key", F.expr("shiftright(n, 6)").alias("block"), F.expr("shiftleft(1L, cast(n & 63L as int))").alias("bit")))
    starting = {r[0] for r in numbered.select("label").distinct().collect()}
    states: dict[str, DataFrame] = {}
    levels: dict[str, list[int]] = {}
    pairs = found.limit(0).select(F.col("id").alias("source"), F.col("label"), "key", F.lit(0).alias("hops"))
    for label in order:
        steps = [(a, df) for a, b, df in links if b == label and levels[a]]
        here = levels[label] = sorted({n + 1 for a, _ in steps for n in levels[a] if n < max_depth} | ({0} if label in starting else set()))
        if not here:
            continue
        rows = _with_levels(numbered.where(F.col("label") == label), "key", {0: "bit"}, here)
        for a, df in steps:
            ways = df.join(states[a].withColumnRenamed("key", "src"), "src")
            rows = rows.unionByName(_with_levels(ways, "target", {n + 1: f"d{n}" for n in levels[a]}, here))
        merged = lambda df: df.groupBy("key", "block").agg(*[F.bit_or(f"d{n}").alias(f"d{n}") for n in here])  # noqa: B023, E731
        if any(a == label for a, _, _ in links):
            rows = checkpointed(merged(rows))
            states[label] = F.broadcast(rows) if rows.limit(FEW_NODES + 1).count() <= FEW_NODES else rows
        if label in sinks and here != [0]:
            # An inner join, since Spark would push a semi join down to each link and shuffle links once more.
            ends = merged(rows.join(sinks[label].select("key").distinct(), "key"))
            of = numbered.select(F.col("id").alias("source"), "block", "bit")
            has = lambda n: F.col(f"d{n}").bitwiseAND(F.col("bit")) != 0
            hops = F.coalesce(*[F.when(has(n), F.lit(n)) for n in here])
            met = ends.join(F.broadcast(of) if few else of, "block").select("source", F.lit(label).alias("label"), "key", hops.alias("hops"))
            pairs = pairs.unionByName(met.where("hops > 0"))
    return pairs


def _with_levels(rows: DataFrame, key: str, bits: dict[int, str], levels: list[int]) -> DataFrame:
    """(key, block, one column of bits for each of ``levels``): those of ``bits``, else none."""
    return rows.select(F.col(key).alias("key"), "block", *[(F.col(bits[n]) if n in bits else F.lit(0).cast("bigint")).alias(f"d{n}") for n in levels])


def parameter_lineage(graph: PropertyGraph, functions: DataFrame, max_depth: int = 30) -> DataFrame:
    """(function, caller, hops, line, bound_argument): who calls each function (id), directly or through others.

    line is that of a direct call, for which the argument is bound by position as far as edges tell; callers of callers have none.
    """
    back = PropertyGraph(graph.nodes, graph.edges.where("edge = 'RESOLVED_CALLS'").select(F.col("target").alias("src"), "edge", F.col("src").alias("target"), "line"))
    found = shortest_paths(back, functions, graph.nodes, ["RESOLVED_CALLS"], max_depth).select(F.col("source").alias("function"), F.col("sink").alias("caller"), "hops")
    last = lambda c: F.regexp_extract(c, r"([^.:]+)$", 1)
    calls = graph.edges.where("edge = 'CALLS'").select(F.col("src").alias("caller"), last("target").alias("called"), "line").distinct()
    lines = found.where("hops = 1").withColumn("called", last("function")).join(calls, ["caller", "called"], "left")
    direct = lines.select("function", "caller", "hops", "line", F.lit("positional/inferred").alias("bound_argument"))
    none = F.lit(None)
    return direct.unionByName(found.where("hops > 1").select("function", "caller", "hops", none.cast("int").alias("line"), none.cast("string").alias("bound_argument")))


def reaching_tests(graph: PropertyGraph, target: DataFrame, edge_types: list[str], max_depth: int = 3) -> DataFrame:
    """(id, distance): functions named ``test_*`` or in a path with ``test`` that reach the target within ``max_depth`` links."""
    found = bfs(graph, target, "incoming", edge_types, max_depth).join(graph.nodes, "id")
    return found.where((F.col("distance") > 0) & (F.col("name").startswith("test_") | F.coalesce(F.col("file_path").contains("test"), F.lit(False)))).select("id", "distance")
