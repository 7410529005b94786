"""A code graph made from source files, and the questions that tools ask of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import cycles, dead, extract, graph, resolve, search, traverse
from loomgraph.schemas import TRAVERSED
from loomgraph.sources import code, sinks
from loomgraph.storage import checkpointed

LABELS = ("File", "Variable", "Class", "ClassAttribute", "Function", "Parameter", "InstanceAttribute", "EnvVar", "Import")
TABLES = ("nodes", "edges", "chunks", "endpoints", "errors", "postings")
#: Links among which cycles are looked for: the fixed ones, and imports between files.
CYCLE_EDGES = ("RESOLVED_CALLS", "IMPORTS", "INSTANTIATES", "HAS_METHOD", "RESOLVED_INHERITS", "FILE_IMPORTS")
#: Edges that keep a target alive besides the fixed ones: what a live file holds, what live code reads, and imports between files.
_MORE_LIVE = ["CONTAINS_CLASS", "CONTAINS_FUNCTION", "RESOLVED_USES_VARIABLE", "FILE_IMPORTS"]


@dataclass(frozen=True)
class CodeGraph:
    """The tables of an ingested code base. nodes: id, label, name, file_path, start_line; edges: src, edge, target, line; chunks with vector and words."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    endpoints: DataFrame
    errors: DataFrame
    postings: DataFrame

    @staticmethod
    def of(files: DataFrame, model: Callable | None = None) -> CodeGraph:
        """From ``files`` (file_path, content). Files that do not parse are in ``errors`` and nowhere else.

        Each file is parsed once: what was found is written to the checkpoint folder and read from there. ``model``
        embeds the chunks (``search.embed``), here and once.
        """
        tagged = checkpointed(extract.extract(files), costly=True)
        files = tagged.where("kind in ('File', '_error')").select("file_path")
        tables = {x: extract.node_table(tagged, x) for x in LABELS} | {"EnvVarUsage": extract.node_table(tagged, "EnvVarUsage")}
        tables["Import"] = extract.with_internal(tables["Import"], files)
        rows = None
        for label in LABELS:
            t = tables[label]
            has = lambda c, kind, t=t: (F.col(c) if c in t.columns else F.lit(None)).cast(kind).alias(c)
            part = t.select("id", F.lit(label).alias("label"), has("name", "string"), has("file_path", "string"), has("start_line", "int"))
            rows = part if rows is None else rows.unionByName(part)
        seen = extract.edge_table(tagged)
        structure = graph.structural_edges(tables)
        aliases = resolve.alias_targets(tables["Import"], files)
        named = seen.unionByName(structure.where("edge = 'INHERITS_FROM'"))
        resolved = resolve.resolved_edges(named, aliases, tables["Function"], tables["Class"], tables["Variable"])
        uses = resolve.attribute_uses(seen, resolve.ordered_bases(tables["Class"], aliases), tables["InstanceAttribute"])
        imports = aliases.select(F.col("file_path").alias("src"), F.lit("FILE_IMPORTS").alias("edge"), F.split("target", "::")[0].alias("target")).distinct()
        none = F.lit(None).cast("int").alias("line")
        raw = seen.where("edge = 'CALLS'")
        names = graph.placeholders(raw, rows, "CALLS").select("id", "label", "name", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("start_line"))
        more = resolved.unionByName(uses).unionByName(imports).select("src", "edge", "target", none)
        edges = graph.ingest_edges(structure.unionByName(raw).unionByName(more), rows)
        text = F.concat_ws(" ", "node_id", "file_path", "name", "docstring", F.array_join("inline_comments", " "), "content")
        chunks = extract.code_chunks(tagged).withColumn("text", text)
        index = search.postings(chunks, "node_id", "text")
        chunks = search.embed(chunks, "text", model=model).withColumn("words", F.size(search.tokens(F.col("text")))).drop("text")
        return CodeGraph(rows.unionByName(names), edges, chunks, extract.endpoints(tagged), tagged.where("kind = '_error'").select("file_path", F.col("a").alias("error")), index)

    @property
    def property_graph(self) -> graph.PropertyGraph:
        return graph.PropertyGraph(self.nodes, self.edges)

    def save(self, folder: str) -> dict[str, int]:
        """Writes the tables; gives the numbers of files that were processed and that failed. Nodes that share an id are an error."""
        sinks.write_tables({t: getattr(self, t) for t in TABLES}, folder)
        spark = self.nodes.sparkSession
        kept = CodeGraph.load(spark, folder)
        graph.checked_ids(kept.nodes.where("label <> 'Target'"))
        return {"processed": kept.nodes.where("label = 'File'").count(), "failed": kept.errors.count()}

    @staticmethod
    def load(spark: SparkSession, folder: str) -> CodeGraph:
        return CodeGraph(**sinks.read_tables(spark, folder, list(TABLES)))


def ingest(spark: SparkSession, root: str, folder: str, model: Callable | None = None) -> dict[str, int]:
    """Scans a folder of Python source, writes its graph, and gives the numbers of processed and failed files."""
    return CodeGraph.of(code.scan(spark, root), model).save(folder)


def traverse_call_graph(g: CodeGraph, symbols, direction: str = "incoming", max_depth: int = 30, exclude_boilerplate: bool = True, limit: int = 50, file_path: str | None = None, include_raw: bool = True, source_labels: list[str] | None = None, target_labels: list[str] | None = None) -> DataFrame:
    """What leads to symbols, or what they lead to: (id, distance, parent, edge), nearest first.

    ``file_path`` and ``source_labels`` narrow what the symbols mean, ``target_labels`` what is reached; without
    ``include_raw`` names that are no nodes are left out.
    """
    start = traverse.anchors(g.nodes, traverse.normalize_symbols(symbols), source_labels, file_path=file_path)
    found = traverse.bfs(g.property_graph, start, direction, list(TRAVERSED), max_depth, exclude_boilerplate, labels=target_labels, include_raw=include_raw)
    return found.orderBy("distance", "id").limit(limit)


def calculate_blast_radius(g: CodeGraph, symbols, max_depth: int = 30) -> DataFrame:
    """(label, file, symbols): how many symbols of each file a change affects, the changed ones included."""
    rows, _ = traverse.blast_radius(g.property_graph, symbols, max_depth, list(TRAVERSED))
    return rows.groupBy("label", F.coalesce("file_path", F.lit("unknown")).alias("file")).agg(F.count("*").alias("symbols"))


def trace_parameter_lineage(g: CodeGraph, function: str, parameter: str, max_depth: int = 30) -> DataFrame:
    """(function, caller, hops, line, bound_argument): callers of the functions of that name that have the parameter, direct ones first, by line."""
    own = traverse.anchors(g.nodes, [function], ["Function"]).select(F.col("id").alias("src"))
    has = g.edges.where("edge = 'HAS_PARAMETER'").join(own, "src").where(F.col("target").endswith(f"::param::{parameter}")).select(F.col("src").alias("id")).distinct()
    return traverse.parameter_lineage(g.property_graph, has, max_depth).orderBy("hops", "line", "caller")


def query_state_references(g: CodeGraph, symbol: str) -> DataFrame:
    """(kind, name, user): readers of environment variables whose name holds the symbol, if it is in capitals or has an underscore; else of instance attributes of that name, else of global variables."""
    is_name, nodes = F.col("name") == symbol, g.nodes
    env = nodes.where((F.col("label") == "EnvVar") & F.col("name").contains(symbol)) if symbol.isupper() or "_" in symbol else nodes.where("false")
    attribute = nodes.where((F.col("label") == "InstanceAttribute") & (is_name | F.col("id").endswith(f"::inst_attr::{symbol}") | F.col("id").endswith(f".{symbol}")))
    out = None
    for rank, (label, edge, ids) in enumerate((("EnvVar", "USES_ENV", env), ("InstanceAttribute", "RESOLVED_USES_INST_ATTR", attribute), ("Variable", "RESOLVED_USES_VARIABLE", nodes.where((F.col("label") == "Variable") & is_name)))):
        part = g.edges.where(F.col("edge") == edge).join(ids.select(F.col("id").alias("target"), "name").distinct(), "target").select(F.lit(label).alias("kind"), "name", F.col("src").alias("user"), F.lit(rank).alias("rank"))
        out = part if out is None else out.unionByName(part)
    first = out.agg(F.min("rank")).first()[0]  # one row
    return out.where(F.col("rank") == F.lit(first)).select("kind", "name", "user").distinct()


def inspect_type_hierarchy(g: CodeGraph, symbol: str, max_depth: int = 30) -> DataFrame:
    """(relation, id, distance): ancestors, descendants and methods of the classes of that name."""
    start = traverse.anchors(g.nodes, [symbol], ["Class"]).select("id")
    up = traverse.bfs(g.property_graph, start, "outgoing", ["RESOLVED_INHERITS"], max_depth).where("distance > 0").select(F.lit("ancestor").alias("relation"), "id", "distance")
    down = traverse.bfs(g.property_graph, start, "incoming", ["RESOLVED_INHERITS"], max_depth).where("distance > 0").select(F.lit("descendant").alias("relation"), "id", "distance")
    methods = g.edges.where("edge = 'HAS_METHOD'").join(start.select(F.col("id").alias("src")), "src", "left_semi").select(F.lit("method").alias("relation"), F.col("target").alias("id"), F.lit(1).alias("distance"))
    return up.unionByName(down).unionByName(methods)


def get_symbol_code_snippet(g: CodeGraph, symbol: str) -> DataFrame:
    """The chunk of a symbol, one row or none."""
    return search.snippet(g.chunks, symbol).drop("match")


def analyze_architecture_coupling(g: CodeGraph, symbol: str | None = None, module: str | None = None, max_depth: int = 6) -> DataFrame:
    """(cycle, length): cycles of files that import each other, functions that call each other, and so on.

    With ``module`` or ``symbol`` only those through a node whose name or id holds it; only the components that hold such a node are
    searched. A symbol that is nowhere gives none.
    """
    links = checkpointed(cycles.cycle_input(g.property_graph, list(CYCLE_EDGES)))
    found, target = cycles.components(links), module or symbol
    if not target:
        return cycles.simple_cycles(links, max_depth, found)
    wanted = cycles.matching(g.nodes, target)
    return cycles.through(cycles.simple_cycles(links, max_depth, cycles.components_of(found, wanted)), wanted)


def list_file_imports(g: CodeGraph) -> DataFrame:
    """(from_file, to_file): which file imports which."""
    return g.edges.where("edge = 'FILE_IMPORTS'").select(F.col("src").alias("from_file"), F.col("target").alias("to_file")).distinct()


def detect_dead_code(g: CodeGraph, entity_type: str = "all", scope: str | None = None, by_reach: bool = True, strict_reference: bool = False) -> DataFrame:
    """Entities that nothing reaches from an entry point, or (without ``by_reach``) that nothing refers to.

    ``strict_reference`` leaves out containment and imports between files, so functions of a live file may be dead.
    """
    labels = dead.ENTITY_LABELS.get(entity_type, dead.ENTITY_LABELS["all"])
    if not by_reach:
        return dead.reportable(dead.dead_by_degree(g.property_graph, list(dead.USE_EDGES), labels), scope)
    entries = g.nodes.where(F.col("label").isin("File", "Function") & dead.is_entry(F.col("name"), F.col("file_path"))).select("id")
    return dead.reportable(dead.dead_by_reach(g.property_graph, entries, [*dead.LIVE_EDGES, *([] if strict_reference else _MORE_LIVE)], labels), scope)


def trace_taint_paths(g: CodeGraph, source_pattern: str = "request", sink_pattern: str = "execute|eval|exec|query|system", max_depth: int = 5) -> DataFrame:
    """(source, sink, hops): shortest chains of calls from functions that match one pattern to those that match the other."""
    functions = g.nodes.where("label = 'Function'")
    hit = lambda p: functions.where(F.col("name").rlike(p) | F.col("file_path").rlike(p))
    return traverse.shortest_paths(g.property_graph, hit(source_pattern), hit(sink_pattern), ["RESOLVED_CALLS"], max_depth)


def search_codebase(g: CodeGraph, query: str, limit: int = 5, embed_query: Callable[[str], list[float]] = search.embed_query) -> DataFrame:
    """The chunks nearest to a query by embedding and BM25 over names, docstrings, comments and contents; BM25 alone if no vector is near.

    Vectors and the inverted index are the stored ones; ``embed_query`` has to be of the model that made the vectors.
    """
    q = F.array(*[F.lit(float(x)) for x in embed_query(query)])
    score = F.round(search.cosine(F.col("vector"), q), 6)
    dense = g.chunks.select("node_id", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "node_id").limit(4 * limit)
    terms = [w for w in query.replace("_", " ").split() if w.isalpha()]
    if terms:
        texts, words = g.chunks.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()  # one row
        best = search.fuse(dense, search.bm25_index(g.postings, "node_id", terms, texts, words, 4 * limit), "node_id", 0.5, limit)
    else:
        best = dense.limit(limit)
    fields = ["node_id", "file_path", "name", "chunk_type", "docstring", "start_line", "end_line", "content"]
    return best.join(g.chunks.select(*fields), "node_id").orderBy(F.col("score").desc(), "node_id")


def query_test_traceability(g: CodeGraph, symbol: str, max_depth: int = 3) -> DataFrame:
    """(id, distance): tests that reach a symbol by calls."""
    return traverse.reaching_tests(g.property_graph, traverse.anchors(g.nodes, [symbol]).select("id"), ["RESOLVED_CALLS", "CALLS"], max_depth)


def query_api_endpoints(g: CodeGraph, route: str | None = None, method: str | None = None) -> DataFrame:
    rows = g.endpoints.where(F.col("route_path").contains(route)) if route else g.endpoints
    return rows.where(F.col("http_method") == method.upper()) if method else rows


TOOLS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (traverse_call_graph, calculate_blast_radius, trace_parameter_lineage, query_state_references, inspect_type_hierarchy, get_symbol_code_snippet, analyze_architecture_coupling, list_file_imports, detect_dead_code, trace_taint_paths, search_codebase, query_test_traceability, query_api_endpoints)
}
