"""Small graphs and a corpus of Python modules made from relational tables, on which operators have a known result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.storage import table

MODULE = '''import os
import shared.base as base
from shared.base import Base%(base)s as Root
from .peer import helper_0

LIMIT_%(key)s = %(nation)s
RATES = [%(key)s]


class Supplier%(key)s(Root):
    """Supplier %(key)s."""

    rate = %(key)s

    def __init__(self, name, *args):
        self.name = name
        self.total = LIMIT_%(key)s

    @app.get("/suppliers/%(key)s")
    def charge(self, amount=0):
        # adds the amount of %(key)s
        return helper_%(key)s(self.total, self.region)


def helper_%(key)s(total, amount):
    """Helper %(key)s."""
    # reads the region
    made = Supplier%(key)s(total)
    return os.getenv("SUPPLIER_%(key)s", "%(nation)s")


def test_%(key)s():
    return helper_%(key)s(1, 2)
'''
BASE = '''class Base%(key)s:
    def __init__(self):
        self.region = %(key)s
'''


#: A module with two bases whose order tells, parameters of all kinds, and the name of a standard module that the scan has too.
NATION = '''import queue
import lib.parts as parts
from lib.parts import Zeta, Alpha


class Node%(key)s(
    Zeta, Alpha,  # in this order
    metaclass=type,
):
    def show(self, plain, width: int, height=1, *rest, depth: int = 2, bare):
        local = plain + width + bare
        for item in rest:
            local += height
        return self.color + self.shape + depth + local


async def order_%(key)s(node: Node%(key)s = None):
    return node.show(queue, parts)
'''
PARTS = '''class Top:
    def __init__(self):
        self.shape = 1


class Zeta(Top):
    def __init__(self):
        self.color = 1


class Alpha:
    def __init__(self):
        self.color = 2
        self.shape = 2
'''


def _filled(template: str, **columns):
    parts = []
    rest = template
    for m in re.finditer(r"%\((\w+)\)s", template):
        parts += [F.lit(template[len(template) - len(rest) : m.start()]), columns[m[1]].cast("string")]
        rest = template[m.end() :]
    return F.concat(*parts, F.lit(rest))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, content): a module for each supplier, one file of base classes (one for each region), one that does not parse, one pruned."""
    supplier = table(spark, sf_dir, "supplier")
    base = F.pmod(F.col("s_suppkey"), F.lit(5))
    files = supplier.select(F.concat(F.lit("suppliers/supplier_"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("file_path"), _filled(MODULE, key=F.col("s_suppkey"), nation=F.col("s_nationkey"), base=base).alias("text"))
    bases = table(spark, sf_dir, "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r_regionkey")), lambda k: _filled(BASE, key=k)), "\n\n").alias("text"))
    extra = spark.createDataFrame([("suppliers/broken.py", "def f(:\n"), ("venv/lib.py", "x = 1\n"), ("suppliers/notes.txt", "text")], "file_path string, text string")
    every = files.unionByName(bases.select(F.lit("shared/base.py").alias("file_path"), "text")).unionByName(extra)
    return every.select("file_path", F.encode("text", "UTF-8").alias("content"))


def nation_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, content): a module for each nation, the classes that they inherit from, and a file named like a standard module."""
    nation = table(spark, sf_dir, "nation")
    files = nation.select(F.concat(F.lit("nations/nation_"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("file_path"), _filled(NATION, key=F.col("n_nationkey")).alias("text"))
    extra = spark.createDataFrame([("lib/parts.py", PARTS), ("lib/queue.py", "x = 1\n"), ("queue.py", "x = 1\n")], "file_path string, text string")
    return files.unionByName(extra).select("file_path", F.encode("text", "UTF-8").alias("content"))


#: Edge type, table, label and key of src, label and key of target.
_TPCH_LINKS = (
    ("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey"), ("CUST_NATION", "customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
    ("SUPP_NATION", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"), ("PLACED_BY", "orders", "Order", "o_orderkey", "Customer", "o_custkey"),
    ("HAS_ITEM", "lineitem", "Order", "l_orderkey", "Part", "l_partkey"), ("SUPPLIED_BY", "lineitem", "Part", "l_partkey", "Supplier", "l_suppkey"),
)


def tpch_links(spark: SparkSession, sf_dir: str, edge_types: list[str]) -> list[tuple[str, str, DataFrame]]:
    """The links of ``tpch_graph`` by type: label of src, label of target, and (src, target), which are keys instead of ids. Links may be repeated."""
    key = lambda name, alias: F.col(name).cast("bigint").alias(alias)
    return [(a, b, table(spark, sf_dir, name).where(F.col(ak).isNotNull() & F.col(bk).isNotNull()).select(key(ak, "src"), key(bk, "target"))) for edge, name, a, ak, b, bk in _TPCH_LINKS if edge in edge_types]


def tpch_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, orders and parts, linked by their keys."""
    t = lambda name: table(spark, sf_dir, name)
    no_file = F.lit(None).cast("string").alias("file_path")

    def node(label: str, df: DataFrame, key: str, name) -> DataFrame:
        return df.select(F.concat(F.lit(f"{label}::"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), name.alias("name"), no_file)

    def edge(kind: str, df: DataFrame, a: str, ak: str, b: str, bk: str, line=None) -> DataFrame:
        at = lambda label, key: F.concat(F.lit(f"{label}::"), F.col(key).cast("string"))
        rows = df.where(F.col(ak).isNotNull() & F.col(bk).isNotNull())
        return rows.select(at(a, ak).alias("src"), F.lit(kind).alias("edge"), at(b, bk).alias("target"), (F.lit(None) if line is None else F.col(line)).cast("int").alias("line"))

    c = F.col
    nodes = [
        node("Region", t("region"), "r_regionkey", c("r_name")), node("Nation", t("nation"), "n_nationkey", c("n_name")), node("Customer", t("customer"), "c_custkey", c("c_name")),
        node("Supplier", t("supplier"), "s_suppkey", c("s_name")), node("Order", t("orders"), "o_orderkey", F.concat(F.lit("Order#"), c("o_orderkey").cast("string"))), node("Part", t("part"), "p_partkey", c("p_name")),
    ]
    items = t("lineitem")
    edges = [
        edge("IN_REGION", t("nation"), "Nation", "n_nationkey", "Region", "n_regionkey"), edge("CUST_NATION", t("customer"), "Customer", "c_custkey", "Nation", "c_nationkey"),
        edge("SUPP_NATION", t("supplier"), "Supplier", "s_suppkey", "Nation", "s_nationkey"), edge("PLACED_BY", t("orders"), "Order", "o_orderkey", "Customer", "o_custkey"),
        edge("HAS_ITEM", items, "Order", "l_orderkey", "Part", "l_partkey", "l_linenumber"), edge("SUPPLIED_BY", items.select("l_partkey", "l_suppkey").distinct(), "Part", "l_partkey", "Supplier", "l_suppkey"),
    ]
    n, e = nodes[0], edges[0]
    for x in nodes[1:]:
        n = n.unionByName(x)
    for x in edges[1:]:
        e = e.unionByName(x)
    return PropertyGraph(n, e)


def import_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Files and the modules that they import, which are placeholders of names."""
    rows = table(spark, sf_dir, "import_nodes").where("file_path is not null and module is not null")
    files = rows.select(F.col("file_path").alias("id")).distinct().select("id", F.lit("File").alias("label"), F.element_at(F.split("id", "/"), -1).alias("name"), F.col("id").alias("file_path"))
    names = rows.select(F.col("module").alias("id")).distinct().select("id", F.lit("Target").alias("label"), F.col("id").alias("name"), F.lit(None).cast("string").alias("file_path"))
    edges = rows.select(F.col("file_path").alias("src"), F.lit("CALLS").alias("edge"), F.col("module").alias("target"), F.lit(None).cast("int").alias("line")).distinct()
    return PropertyGraph(files.unionByName(names), edges)


def event_graph(spark: SparkSession, sf_dir: str, users: int = 20) -> DataFrame:
    """(src, target): which type of event follows which, in ``users`` separate groups of users; links seen in one order of ids only are kept sparse.

    Links from a type to one earlier in the alphabet stay only in even groups, so odd groups have loops but no cycles.
    """
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    group = F.pmod(F.col("user_id"), F.lit(users))
    rows = table(spark, sf_dir, "events").withColumn("next", F.lead("event_type").over(by_user)).where("next is not null").withColumn("g", group)
    rows = rows.where((F.col("event_type") <= F.col("next")) | (F.col("g") % 2 == 0))
    at = lambda x: F.concat(F.col(x), F.lit("#"), F.col("g").cast("string"))
    return rows.select(at("event_type").alias("src"), at("next").alias("target")).distinct()
