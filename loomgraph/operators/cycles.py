"""Strongly connected components and elementary cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.storage import checkpointed


def cycle_input(graph: PropertyGraph, edge_types: list[str], labels: tuple[str, ...] = ("File", "Function", "Class")) -> DataFrame:
    """(src, target): the links of the types between nodes of the labels, dunder names left out. All of them, unlike a sample of the first."""
    name = F.coalesce("name", F.lit(""))
    kept = graph.nodes.where(F.col("label").isin(*labels) & ~(name.startswith("__") & name.endswith("__"))).select("id").distinct()
    links = graph.edges.where(F.col("edge").isin(*edge_types)).select("src", "target").distinct()
    links = links.join(kept.withColumnRenamed("id", "src"), "src", "left_semi")
    return links.join(kept.withColumnRenamed("id", "target"), "target", "left_semi")


def matching(nodes: DataFrame, symbol: str) -> DataFrame:
    """(id): nodes whose name or id holds a symbol, whatever the case."""
    part = symbol.lower()
    return nodes.where(F.lower(F.coalesce("name", F.lit(""))).contains(part) | F.lower("id").contains(part)).select("id").distinct()


def components_of(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``found`` (id, component) the components that hold any of ``wanted`` (id)."""
    own = found.join(wanted.select("id").distinct(), "id", "left_semi").select("component").distinct()
    return found.join(own, "component", "left_semi").select("id", "component")


def through(cycles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``cycles`` (cycle, length) those with any of ``wanted`` (id) among their nodes."""
    members = cycles.select("cycle", F.explode(F.split("cycle", " -> ")).alias("id"))
    return cycles.join(members.join(wanted.select("id").distinct(), "id", "left_semi").select("cycle").distinct(), "cycle", "left_semi")


def _trimmed(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Edges without those at nodes that have no way in or no way out, again and again."""
    edges, before = checkpointed(edges), -1
    for _ in range(rounds):
        n = edges.count()
        if n == before or n == 0:
            break
        before = n
        edges = edges.join(edges.select(F.col("target").alias("src")).distinct(), "src", "left_semi")
        edges = checkpointed(edges.join(edges.select(F.col("src").alias("target")).distinct(), "target", "left_semi"))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of (src, target); component is its smallest id.

    Colouring: colours (ids) spread forward and the smallest wins; the nodes of a colour that reach its own node
    backward are its component, and the rest goes round again until nothing is left; each round frees a component. Nodes that can be on no cycle are trimmed first.
    """
    edges = edges.where("src is not null and target is not null").select("src", "target").distinct()
    every = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    left = _trimmed(edges.where("src <> target"))
    done = None
    while not left.isEmpty():
        color = checkpointed(left.select(F.col("src").alias("id")).distinct().withColumn("color", F.col("id")))
        while True:
            pushed = left.join(color.withColumnRenamed("id", "src"), "src").groupBy(F.col("target").alias("id")).agg(F.min("color").alias("pushed"))
            new = checkpointed(color.join(pushed, "id", "left").select("id", F.least("color", F.coalesce("pushed", "color")).alias("color"), (F.col("pushed") < F.col("color")).alias("moved")))
            color = new.select("id", "color")
            if new.where("moved").isEmpty():
                break
        within = left.join(color.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src").join(color.select(F.col("id").alias("target"), F.col("color").alias("c2")), "target").where("c1 = c2").select("src", "target", F.col("c1").alias("color"))
        within = checkpointed(within)
        found = frontier = checkpointed(color.where("id = color").select("id", "color"))
        while True:
            back = within.join(frontier.select(F.col("id").alias("target"), "color"), ["target", "color"]).select(F.col("src").alias("id"), "color").distinct()
            frontier = checkpointed(back.join(found, ["id", "color"], "left_anti"))
            if frontier.isEmpty():
                break
            found = checkpointed(found.unionByName(frontier))
        part = found.select("id", F.col("color").alias("component"))
        done = part if done is None else done.unionByName(part)
        left = _trimmed(within.select("src", "target").join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("target")), "target", "left_anti"))
    if done is None:
        return every.withColumn("component", F.col("id"))
    return every.join(done, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cyclic_components(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(component, size): components of more than one node, or of a node with a link to itself."""
    found = components(edges) if found is None else found
    loops = edges.where("src = target").select(F.col("src").alias("id")).distinct()
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    own = found.join(loops, "id", "left_semi").select("component").distinct().withColumn("own", F.lit(True))
    return sizes.join(own, "component", "left").where("size > 1 or own").select("component", "size")


def simple_cycles(edges: DataFrame, max_length: int = 6, found: DataFrame | None = None) -> DataFrame:
    """(cycle, length): elementary cycles of 2 to ``max_length`` (2 to 25) nodes, as ids from the smallest on joined by `` -> ``.

    Paths start at their smallest node and stay in its component. There are exponentially many cycles, and all are given.
    """
    length = max(2, min(max_length, 25))
    found = components(edges) if found is None else found
    edges = edges.where("src <> target").select("src", "target").distinct()
    edges = edges.join(found.select(F.col("id").alias("src"), F.col("component").alias("c1")), "src").join(found.select(F.col("id").alias("target"), F.col("component").alias("c2")), "target")
    edges = checkpointed(edges.where("c1 = c2").select("src", "target"))
    paths = edges.where("target > src").select(F.col("src").alias("start"), F.array("src", "target").alias("path"), F.col("target").alias("end"))
    out = None
    for n in range(2, length + 1):
        paths = checkpointed(paths)
        closed = paths.join(edges.select(F.col("src").alias("end"), F.col("target").alias("start")), ["end", "start"], "left_semi").select(F.array_join("path", " -> ").alias("cycle"), F.lit(n).alias("length"))
        out = closed if out is None else out.unionByName(closed)
        if n < length:
            paths = paths.join(edges.withColumnRenamed("src", "end"), "end").where("target > start and not array_contains(path, target)").select("start", F.concat("path", F.array("target")).alias("path"), F.col("target").alias("end"))
    return out


def cycle_kinds(cycles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, cycles): cycles by the labels of their nodes: of files, of functions, of classes, or of several."""
    members = cycles.select("cycle", F.explode(F.split("cycle", " -> ")).alias("id")).join(nodes.select("id", "label"), "id")
    labels = members.groupBy("cycle").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    one = F.element_at("labels", 1)
    kind = F.when(F.size("labels") > 1, "heterogeneous").when(one == "File", "file_import").when(one == "Function", "function_call").when(one == "Class", "class_instantiation").otherwise(F.lower(one))
    return labels.groupBy(kind.alias("kind")).agg(F.count("*").alias("cycles"))
