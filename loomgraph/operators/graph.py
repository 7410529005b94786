"""Property graphs as two DataFrames, and how rows get into them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.schemas import BY_NAME
from loomgraph.storage import fresh


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id, label, name and any others; edges: src, edge, target, line."""

    nodes: DataFrame
    edges: DataFrame

    def persist(self) -> PropertyGraph:
        """Both parts kept for the queries that follow."""
        return PropertyGraph(self.nodes.persist(), self.edges.persist())


def upsert_nodes(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``; its nulls overwrite. Null keys are left out.

    The ranking is cut within input partitions first, so a key with a third of the rows sends one row a partition.
    """
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    rank = fresh(*rows.columns)
    return rows.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(last)).where(F.col(rank) == 1).drop(rank)


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """(id, rows): ids that occur more than once, the check that stands for a uniqueness constraint."""
    return nodes.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")


def checked_ids(nodes: DataFrame) -> DataFrame:
    """``nodes`` after a check that no id occurs twice, as a uniqueness constraint would make at writing."""
    if twice := duplicate_ids(nodes).limit(3).collect():
        raise ValueError(f"ids that occur more than once: {', '.join(str(r['id']) for r in twice)}")
    return nodes


def ingest_edges(edges: DataFrame, nodes: DataFrame, by_name: tuple[str, ...] = BY_NAME) -> DataFrame:
    """Edges whose ends exist, each once: src must be a node; target too, but for the types that make their target by name.

    Only CALLS keeps its line, which is part of its key. Nulls in src, edge or target match nothing.
    """
    ids = nodes.select("id").distinct()
    rows = edges.select("src", "edge", "target", F.when(F.col("edge").isin("CALLS", "HAS_ITEM"), F.col("line")).alias("line")).distinct()
    rows = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    named = rows.where(F.col("edge").isin(*by_name) & F.col("target").isNotNull())
    rest = rows.where(~F.col("edge").isin(*by_name)).join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return named.unionByName(rest)


def placeholders(edges: DataFrame, nodes: DataFrame, edge: str, label: str = "Target") -> DataFrame:
    """(id, label, name): the names that edges of a type lead to and that are no node's id."""
    names = edges.where((F.col("edge") == edge) & F.col("target").isNotNull()).select(F.col("target").alias("name")).distinct()
    return names.join(nodes.select(F.col("id").alias("name")).distinct(), "name", "left_anti").select(F.col("name").alias("id"), F.lit(label).alias("label"), "name")


def structural_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """The containment edges that the node tables imply."""

    def edge(df: DataFrame, src, kind: str, target, line=None) -> DataFrame:
        return df.select(src.alias("src"), F.lit(kind).alias("edge"), target.alias("target"), (F.lit(None) if line is None else line).cast("int").alias("line"))

    c = F.col
    fn, cls = tables["Function"], tables["Class"]
    parts = [
        edge(tables["Import"], c("file_path"), "IMPORTS", c("id")),
        edge(cls, c("file_path"), "CONTAINS_CLASS", c("id")),
        edge(cls.select("id", F.explode("bases").alias("base")), c("id"), "INHERITS_FROM", c("base")),
        edge(fn.where("not is_method"), c("file_path"), "CONTAINS_FUNCTION", c("id")),
        edge(fn.where("is_method"), F.concat_ws("::", "file_path", "class_name"), "HAS_METHOD", c("id")),
        edge(tables["Variable"], c("file_path"), "CONTAINS_VARIABLE", c("id")),
        edge(tables["Parameter"], c("function_id"), "HAS_PARAMETER", c("id")),
        edge(tables["ClassAttribute"], c("class_id"), "HAS_CLASS_ATTRIBUTE", c("id")),
        edge(tables["InstanceAttribute"], c("class_id"), "HAS_INSTANCE_ATTRIBUTE", c("id")),
        edge(tables["EnvVarUsage"], c("scope_id"), "USES_ENV", F.concat(F.lit("ENV::"), c("env_name"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
