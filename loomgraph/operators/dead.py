"""Entities that nothing uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.operators.traverse import bfs

# Names and files that programs start from, names that are never reported, labels by entity type, edges that keep a target alive, edges that count as use.
ENTRY_NAMES = ("main", "app", "cli", "run", "start", "serve")
ENTRY_FILES = ("main.py", "app.py", "setup.py", "manage.py")
RESERVED = ("main", "app", "setup.py", "__init__.py", "manage.py")
ENTITY_LABELS = {"function": ["Function"], "functions": ["Function"], "class": ["Class"], "classes": ["Class"], "file": ["File"], "files": ["File"], "variable": ["Variable"], "variables": ["Variable"], "env": ["EnvVar"], "all": ["Function", "Class", "File", "EnvVar", "Variable"]}
LIVE_EDGES = ("RESOLVED_CALLS", "IMPORTS", "INSTANTIATES", "HAS_METHOD", "RESOLVED_INHERITS", "USES_ENV", "CONTAINS_VARIABLE")
USE_EDGES = ("RESOLVED_CALLS", "CALLS", "IMPORTS", "INSTANTIATES", "RESOLVED_INHERITS", "INHERITS_FROM")


def is_entry(name: Column, file_path: Column) -> Column:
    """Whether a file or function is one that programs start from."""
    by_name = name.isin(*ENTRY_NAMES) | name.rlike("^(?:main|cli|run)_")
    by_file = F.lit(False)
    for f in ENTRY_FILES:
        by_file = by_file | file_path.endswith(f)
    return F.coalesce(by_name, F.lit(False)) | F.coalesce(by_file, F.lit(False))


def dead_by_reach(graph: PropertyGraph, entries: DataFrame, edge_types: list[str], labels: list[str] | None = None, max_depth: int = 15) -> DataFrame:
    """Nodes that no way of at most ``max_depth`` links leads to from the entries (id), which are live themselves."""
    live = bfs(graph, entries, "outgoing", edge_types, max_depth)
    nodes = graph.nodes.where(F.col("label").isin(*labels)) if labels else graph.nodes
    return nodes.join(live.select("id"), "id", "left_anti")


def dead_by_degree(graph: PropertyGraph, edge_types: list[str], labels: list[str] | None = None) -> DataFrame:
    """Nodes that no edge of the types leads to."""
    used = graph.edges.where(F.col("edge").isin(*edge_types)).select(F.col("target").alias("id")).distinct()
    nodes = graph.nodes.where(F.col("label").isin(*labels)) if labels else graph.nodes
    return nodes.join(used, "id", "left_anti")


def reportable(dead: DataFrame, scope: str | None = None) -> DataFrame:
    """Without dunder and test names, test paths and reserved names; with ``scope`` only paths or ids that hold it."""
    test = F.col("name").rlike(r"^__.*__$") | F.col("name").startswith("test_") | F.col("name").isin(*RESERVED)
    path = F.coalesce(F.col("file_path"), F.lit(""))
    rows = dead.where(~F.coalesce(test, F.lit(False)) & ~path.contains("test"))
    return rows.where(path.contains(scope) | F.col("id").contains(scope)) if scope else rows


def bucketed(dead: DataFrame, reason: str = "not reachable from any entry point") -> DataFrame:
    """(label, dead, reason): numbers by label, and the total with a null label."""
    return dead.rollup("label").agg(F.count("*").alias("dead")).withColumn("reason", F.lit(reason))
