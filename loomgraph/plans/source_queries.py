"""Queries of the source-code operators, over modules made from tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import extract, graph, resolve, traverse
from loomgraph.sources import code, corpus
from loomgraph.plans import tools
from loomgraph.storage import checkpointed, current_rows, table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.modules(spark, sf_dir).where(code.kept_path(F.col("file_path")))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_files(spark, sf_dir))


def _kept(files: DataFrame) -> DataFrame:
    """Tagged rows that are read more than once: each file is parsed once, and what was found is written and read again."""
    return checkpointed(extract.extract(files), costly=True)


def _code_graph(spark: SparkSession, sf_dir: str) -> tools.CodeGraph:
    return tools.CodeGraph.of(_files(spark, sf_dir))


def _nodes(spark, sf_dir, label):
    return extract.node_table(_tagged(spark, sf_dir), label)


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    for a in arrays:
        df = df.withColumn(a, F.array_join(a, ","))
    return df


def source_scan_prune(spark, sf_dir):
    return _files(spark, sf_dir).select("file_path")


def source_lines(spark, sf_dir):
    return code.with_lines(_files(spark, sf_dir)).select("file_path", "name", "line_count")


def ast_errors(spark, sf_dir):
    return _tagged(spark, sf_dir).where("kind = '_error'").select("file_path")


def ast_functions(spark, sf_dir):
    return _joined(_nodes(spark, sf_dir, "Function"), "parameters")


def ast_classes(spark, sf_dir):
    return _joined(_nodes(spark, sf_dir, "Class"), "bases", "attributes")


def ast_params(spark, sf_dir):
    return _nodes(spark, sf_dir, "Parameter")


def ast_vars(spark, sf_dir):
    return _nodes(spark, sf_dir, "Variable")


def ast_class_attrs(spark, sf_dir):
    return _nodes(spark, sf_dir, "ClassAttribute")


def ast_inst_attrs(spark, sf_dir):
    return _nodes(spark, sf_dir, "InstanceAttribute")


def ast_env_usages(spark, sf_dir):
    return _nodes(spark, sf_dir, "EnvVarUsage")


def ast_env_vars(spark, sf_dir):
    return _nodes(spark, sf_dir, "EnvVar")


def ast_imports(spark, sf_dir):
    return extract.with_internal(_nodes(spark, sf_dir, "Import"), _files(spark, sf_dir))


def ast_calls(spark, sf_dir):
    return extract.edge_table(_tagged(spark, sf_dir)).where("edge = 'CALLS'").select("src", "target", "line")


def ast_uses_variable(spark, sf_dir):
    return extract.edge_table(_tagged(spark, sf_dir)).where("edge = 'USES_VARIABLE'").select("src", "target")


def ast_uses_inst_attr(spark, sf_dir):
    return extract.edge_table(_tagged(spark, sf_dir)).where("edge = 'USES_INSTANCE_ATTRIBUTE'").select("src", "target")


def struct_edges(spark, sf_dir):
    tagged = _kept(_files(spark, sf_dir))
    labels = ("Import", "Class", "Function", "Variable", "Parameter", "ClassAttribute", "InstanceAttribute", "EnvVarUsage")
    rows = graph.structural_edges({x: extract.node_table(tagged, x) for x in labels})
    return rows.groupBy("edge").agg(F.count("*").alias("edges"))


def _chunks(kind):
    def query(spark, sf_dir):
        rows = extract.code_chunks(_kept(_files(spark, sf_dir))).where(F.col("chunk_type") == kind)
        return rows.select("node_id", "name", "docstring", "start_line", "end_line", F.array_join("inline_comments", ",").alias("comments"), "content")

    return query


def comment_range_join(spark, sf_dir):
    return _joined(extract.comments_of(_tagged(spark, sf_dir), "Function"), "comments")


def _resolved(spark, sf_dir, files=None):
    files = _files(spark, sf_dir) if files is None else files
    tagged = _kept(files)
    tables = {x: extract.node_table(tagged, x) for x in ("Function", "Class", "Variable", "Import")}
    aliases = resolve.alias_targets(tables["Import"], tagged.where("kind in ('File', '_error')"))
    bases = tables["Class"].select(F.col("id").alias("src"), F.lit("INHERITS_FROM").alias("edge"), F.explode("bases").alias("target"), F.lit(None).cast("int").alias("line"))
    edges = extract.edge_table(tagged).unionByName(bases)
    return tagged, edges, tables["Class"], aliases, lambda: resolve.resolved_edges(edges, aliases, tables["Function"], tables["Class"], tables["Variable"])


def _resolved_kind(kind: str):
    def query(spark, sf_dir):
        return _resolved(spark, sf_dir)[4]().where(F.col("edge") == kind).select("src", "target")

    return query


def _attributes(spark, sf_dir, files=None):
    tagged, edges, classes, aliases, _ = _resolved(spark, sf_dir, files)
    return resolve.attribute_uses(edges, resolve.ordered_bases(classes, aliases), extract.node_table(tagged, "InstanceAttribute")).select("src", "target")


def resolve_attr_hierarchy(spark, sf_dir):
    return _attributes(spark, sf_dir)


def resolve_attr_order(spark, sf_dir):
    """Attributes that several bases have: those of the first base, and of all above it, count."""
    return _attributes(spark, sf_dir, corpus.nation_modules(spark, sf_dir))


def ast_scope_variables(spark, sf_dir):
    """Names read in functions whose parameters are of all kinds."""
    rows = extract.edge_table(extract.extract(corpus.nation_modules(spark, sf_dir))).where("edge = 'USES_VARIABLE' and src like 'nations/%'")
    return rows.select("src", "target")


def ast_class_signatures(spark, sf_dir):
    rows = extract.node_table(extract.extract(corpus.nation_modules(spark, sf_dir)), "Class")
    return rows.select("id", "signature", F.array_join("bases", ",").alias("bases"), "start_line", "end_line")


def ast_imports_standard(spark, sf_dir):
    """A standard module stays external beside a scanned file of its name."""
    files = corpus.nation_modules(spark, sf_dir)
    rows = extract.with_internal(extract.node_table(extract.extract(files), "Import"), files)
    return rows.select("id", "module", "is_internal")


def param_lineage(spark, sf_dir):
    """Callers of every function that has a parameter ``amount``."""
    g = _code_graph(spark, sf_dir)
    has = g.nodes.where("label = 'Parameter' and name = 'amount'").select(F.regexp_replace("id", "::param::[^:]*$", "").alias("id"))
    return traverse.parameter_lineage(g.property_graph, has)


def state_refs(spark, sf_dir):
    """Where each symbol of three is read: environment, else instance attribute, else global variable."""
    g, out = _code_graph(spark, sf_dir), None
    for symbol in ("SUPPLIER_1", "total", "LIMIT_2"):
        rows = tools.query_state_references(g, symbol).withColumn("symbol", F.lit(symbol))
        out = rows if out is None else out.unionByName(rows)
    return out


def test_trace(spark, sf_dir):
    """The tests that reach any helper by calls."""
    g = _code_graph(spark, sf_dir)
    return traverse.reaching_tests(g.property_graph, g.nodes.where("label = 'Function' and name like 'helper%'").select("id"), ["RESOLVED_CALLS", "CALLS"], 3)


def type_hierarchy(spark, sf_dir):
    """What inherits from a class, what it inherits from, and its methods."""
    g = _code_graph(spark, sf_dir)
    return tools.inspect_type_hierarchy(g, "Base1").unionByName(tools.inspect_type_hierarchy(g, "Supplier1"))


def coupling_cycles(spark, sf_dir):
    return tools.analyze_architecture_coupling(_code_graph(spark, sf_dir))


def coupling_of_symbol(spark, sf_dir):
    return tools.analyze_architecture_coupling(_code_graph(spark, sf_dir), "SUPPLIER1")


def file_imports(spark, sf_dir):
    return tools.list_file_imports(_code_graph(spark, sf_dir))


def call_graph_in_file(spark, sf_dir):
    """What leads to a method of one file, names that are no nodes left out."""
    g = _code_graph(spark, sf_dir)
    return tools.traverse_call_graph(g, "charge", file_path="suppliers/supplier_1.py", include_raw=False, limit=10_000).select("id", "distance")


def _source_files(spark, sf_dir):
    """Current Python files of the whole source_files table."""
    rows = current_rows(table(spark, sf_dir, "source_files").select("file_path", "content", "commit_seq"), "file_path", "commit_seq")
    return rows.where("file_path like '%.py'")


def source_chunks(spark, sf_dir):
    """The chunks of all current files that parse."""
    return extract.code_chunks(_kept(_source_files(spark, sf_dir)))


def source_resolved(spark, sf_dir):
    """The resolved edges of all current files that parse."""
    return _resolved(spark, sf_dir, _source_files(spark, sf_dir))[4]()


def endpoints(spark, sf_dir):
    return extract.endpoints(_tagged(spark, sf_dir), "/suppliers", "get")


def source_ast_counts(spark, sf_dir):
    """Over the whole source_files table: current Python files, and what is found in each that parses."""
    rows = current_rows(table(spark, sf_dir, "source_files").select("file_path", "content", "commit_seq"), "file_path", "commit_seq").where("file_path like '%.py'")
    tagged = extract.extract(rows)
    return tagged.where("kind in ('Class', 'Function', 'Import', 'Variable', 'EnvVarUsage', '_error')").groupBy("file_path", "kind").agg(F.count("*").alias("found"))


_NAMES = (source_scan_prune, source_lines, ast_errors, ast_functions, ast_classes, ast_params, ast_vars, ast_class_attrs, ast_inst_attrs, ast_env_usages, ast_env_vars, ast_imports, ast_calls, ast_uses_variable, ast_uses_inst_attr, struct_edges, comment_range_join, resolve_attr_hierarchy, resolve_attr_order, ast_scope_variables, ast_class_signatures, ast_imports_standard, param_lineage, state_refs, test_trace, type_hierarchy, coupling_cycles, coupling_of_symbol, file_imports, call_graph_in_file, endpoints, source_ast_counts, source_chunks, source_resolved)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMES} | {
    "chunk_file": _chunks("file"),
    "chunk_function": _chunks("function"),
    "chunk_class": _chunks("class"),
    "resolve_calls": _resolved_kind("RESOLVED_CALLS"),
    "resolve_instantiations": _resolved_kind("INSTANTIATES"),
    "resolve_inherits": _resolved_kind("RESOLVED_INHERITS"),
    "resolve_variables": _resolved_kind("RESOLVED_USES_VARIABLE"),
}

_S = "WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 5 AS b, 'suppliers/supplier_' || s_suppkey || '.py' AS f FROM supplier), r AS (SELECT r_regionkey AS k, 'shared/base.py' AS f, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region) "
_NULL = "NULL::VARCHAR"
_N = "WITH n AS (SELECT n_nationkey AS k, 'nations/nation_' || n_nationkey || '.py' AS f FROM nation) "


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The texts of the modules by line: k is null for the file of base classes.
_TEXTS = (
    _S
    + f""", filled AS (SELECT f, k, replace(replace(replace({_quoted(corpus.MODULE)}, '%(key)s', CAST(k AS VARCHAR)), '%(nation)s', CAST(n AS VARCHAR)), '%(base)s', CAST(b AS VARCHAR)) AS text FROM s
  UNION ALL SELECT 'shared/base.py', NULL, string_agg(replace({_quoted(corpus.BASE)}, '%(key)s', CAST(k AS VARCHAR)), chr(10) || chr(10) ORDER BY k) FROM r),
 texts AS (SELECT f, k, string_split(rtrim(text, chr(10)), chr(10)) AS lines FROM filled) """
)
SQL: dict[str, str] = {
    "source_scan_prune": _S + "SELECT f AS file_path FROM s UNION ALL SELECT 'shared/base.py' UNION ALL SELECT 'suppliers/broken.py'",
    "source_lines": _S + "SELECT f AS file_path, 'supplier_' || k || '.py' AS name, 33 AS line_count FROM s UNION ALL SELECT 'shared/base.py', 'base.py', CAST(count(*) * 3 + (count(*) - 1) * 2 AS INT) FROM region UNION ALL SELECT 'suppliers/broken.py', 'broken.py', 1",
    "ast_errors": "SELECT 'suppliers/broken.py' AS file_path",
    "ast_functions": _S + f"""
      SELECT f || '::Supplier' || k || '.__init__' AS id, '__init__' AS name, '(self, name, *args)' AS signature, f AS file_path, 'Supplier' || k AS class_name, 'self,name,*args' AS parameters, 15 AS start_line, 17 AS end_line, true AS is_method FROM s
      UNION ALL SELECT f || '::Supplier' || k || '.charge', 'charge', '(self, amount=0)', f, 'Supplier' || k, 'self,amount', 20, 22, true FROM s
      UNION ALL SELECT f || '::helper_' || k, 'helper_' || k, '(total, amount)', f, {_NULL}, 'total,amount', 25, 29, false FROM s
      UNION ALL SELECT f || '::test_' || k, 'test_' || k, '()', f, {_NULL}, '', 32, 33, false FROM s
      UNION ALL SELECT f || '::Base' || k || '.__init__', '__init__', '(self)', f, 'Base' || k, 'self', CAST(i * 5 + 2 AS INT), CAST(i * 5 + 3 AS INT), true FROM r""",
    "ast_classes": _S + "SELECT f || '::Supplier' || k AS id, 'Supplier' || k AS name, '(Root)' AS signature, f AS file_path, 'Root' AS bases, 'rate' AS attributes, 10 AS start_line, 22 AS end_line FROM s UNION ALL SELECT f || '::Base' || k, 'Base' || k, '()', f, '', '', CAST(i * 5 + 1 AS INT), CAST(i * 5 + 3 AS INT) FROM r",
    "ast_params": _S + """, fn AS (SELECT f || '::Supplier' || k || '.__init__' AS id, unnest(['self', 'name', '*args']) AS p FROM s UNION ALL SELECT f || '::Supplier' || k || '.charge', unnest(['self', 'amount']) FROM s
      UNION ALL SELECT f || '::helper_' || k, unnest(['total', 'amount']) FROM s UNION ALL SELECT f || '::Base' || k || '.__init__', 'self' FROM r) SELECT id || '::param::' || p AS id, p AS name, id AS function_id FROM fn""",
    "ast_vars": _S + "SELECT f || '::LIMIT_' || k AS id, 'LIMIT_' || k AS name, f AS file_path, 6 AS start_line FROM s UNION ALL SELECT f || '::RATES', 'RATES', f, 7 FROM s",
    "ast_class_attrs": _S + "SELECT f || '::Supplier' || k || '::class_attr::rate' AS id, 'rate' AS name, f || '::Supplier' || k AS class_id, 'Supplier' || k AS class_name, f AS file_path, 13 AS start_line FROM s",
    "ast_inst_attrs": _S + "SELECT f || '::Supplier' || k || '::inst_attr::' || a AS id, a AS name, f || '::Supplier' || k AS class_id, 'Supplier' || k AS class_name, f AS file_path, l AS start_line FROM s, (VALUES ('name', 16), ('total', 17)) t(a, l) UNION ALL SELECT f || '::Base' || k || '::inst_attr::region', 'region', f || '::Base' || k, 'Base' || k, f, CAST(i * 5 + 3 AS INT) FROM r",
    "ast_env_usages": _S + "SELECT 'SUPPLIER_' || k AS env_name, CAST(n AS VARCHAR) AS default_value, f || '::helper_' || k AS scope_id, 29 AS line FROM s",
    "ast_env_vars": _S + "SELECT 'ENV::SUPPLIER_' || k AS id, 'SUPPLIER_' || k AS name, CAST(n AS VARCHAR) AS default_value FROM s",
    "ast_imports": _S + f"""SELECT f || '::import::os' AS id, f AS file_path, 'os' AS module, {_NULL} AS imported_symbol, {_NULL} AS alias, false AS is_from_import, false AS is_internal FROM s
      UNION ALL SELECT f || '::import::shared.base', f, 'shared.base', NULL, 'base', false, true FROM s UNION ALL SELECT f || '::import::shared.base::Base' || b, f, 'shared.base', 'Base' || b, 'Root', true, true FROM s
      UNION ALL SELECT f || '::import::.peer::helper_0', f, '.peer', 'helper_0', NULL, true, true FROM s""",
    "ast_calls": _S + """SELECT f || '::Supplier' || k || '.charge' AS src, 'helper_' || k AS target, 22 AS line FROM s UNION ALL SELECT f || '::Supplier' || k, 'app.get', 19 FROM s
      UNION ALL SELECT f || '::helper_' || k, 'Supplier' || k, 28 FROM s UNION ALL SELECT f || '::helper_' || k, 'os.getenv', 29 FROM s UNION ALL SELECT f || '::test_' || k, 'helper_' || k, 33 FROM s""",
    "ast_uses_variable": _S + """SELECT f || p || m AS src, t AS target FROM s, LATERAL (VALUES ('', '', 'LIMIT_' || k), ('', '', 'RATES'), ('::Supplier' || k, '', 'rate'), ('::Supplier' || k, '', 'app'), ('::Supplier' || k, '', 'get'),
      ('::Supplier' || k, '.__init__', 'LIMIT_' || k), ('::Supplier' || k, '.__init__', 'total'), ('::Supplier' || k, '.charge', 'helper_' || k), ('::Supplier' || k, '.charge', 'total'), ('::Supplier' || k, '.charge', 'region'),
      ('::helper_' || k, '', 'Supplier' || k), ('::helper_' || k, '', 'os'), ('::helper_' || k, '', 'getenv'), ('::test_' || k, '', 'helper_' || k)) v(p, m, t) UNION ALL SELECT f || '::Base' || k || '.__init__', 'region' FROM r""",
    "ast_uses_inst_attr": _S + "SELECT f || '::Supplier' || k || '.__init__' AS src, a AS target FROM s, (VALUES ('name'), ('total')) t(a) UNION ALL SELECT f || '::Supplier' || k || '.charge', a FROM s, (VALUES ('total'), ('region')) t(a) UNION ALL SELECT f || '::Base' || k || '.__init__', 'region' FROM r",
    "struct_edges": """WITH n AS (SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM region) AS r) SELECT unnest(['IMPORTS', 'CONTAINS_CLASS', 'INHERITS_FROM', 'CONTAINS_FUNCTION', 'HAS_METHOD', 'CONTAINS_VARIABLE', 'HAS_PARAMETER', 'HAS_CLASS_ATTRIBUTE', 'HAS_INSTANCE_ATTRIBUTE', 'USES_ENV']) AS edge,
      unnest([4 * s, s + r, s, 2 * s, 2 * s + r, 2 * s, 7 * s + r, s, 2 * s + r, s]) AS edges FROM n""",
    "chunk_file": _TEXTS + """SELECT f AS node_id, regexp_extract(f, '([^/]*)$', 1) AS name, NULL::VARCHAR AS docstring, 1 AS start_line, CAST(len(lines) AS INT) AS end_line, '' AS comments,
      '# File: ' || f || chr(10) || chr(10) || '# Code:' || chr(10) || array_to_string(lines, chr(10)) AS content FROM texts""",
    "chunk_function": _TEXTS + """, defs AS (SELECT f || '::Supplier' || k || '.__init__' AS node_id, f, lines, '__init__' AS name, NULL AS docstring, '' AS comments, '(self, name, *args)' AS sig, 15 AS a, 17 AS b FROM texts WHERE k IS NOT NULL
      UNION ALL SELECT f || '::Supplier' || k || '.charge', f, lines, 'charge', NULL, 'adds the amount of ' || k, '(self, amount=0)', 20, 22 FROM texts WHERE k IS NOT NULL
      UNION ALL SELECT f || '::helper_' || k, f, lines, 'helper_' || k, 'Helper ' || k || '.', 'reads the region', '(total, amount)', 25, 29 FROM texts WHERE k IS NOT NULL
      UNION ALL SELECT f || '::test_' || k, f, lines, 'test_' || k, NULL, '', '()', 32, 33 FROM texts WHERE k IS NOT NULL
      UNION ALL SELECT t.f || '::Base' || r.k || '.__init__', t.f, lines, '__init__', NULL, '', '(self)', CAST(i * 5 + 2 AS INT), CAST(i * 5 + 3 AS INT) FROM texts t JOIN r ON t.f = r.f)
      SELECT node_id, name, docstring, a AS start_line, b AS end_line, comments, '# File: ' || f || chr(10) || '# Function: ' || name || chr(10) || '# Signature: ' || name || sig
      || coalesce(chr(10) || '# Docstring: ' || docstring, '') || CASE WHEN comments <> '' THEN chr(10) || '# Comments: ' || comments ELSE '' END || chr(10) || chr(10) || '# Code:' || chr(10) || array_to_string(lines[a:b], chr(10)) AS content FROM defs""",
    "chunk_class": _TEXTS + """, defs AS (SELECT f || '::Supplier' || k AS node_id, f, lines, 'Supplier' || k AS name, 'Supplier ' || k || '.' AS docstring, 'adds the amount of ' || k AS comments, 'Root' AS bases, 10 AS a, 22 AS b FROM texts WHERE k IS NOT NULL
      UNION ALL SELECT t.f || '::Base' || r.k, t.f, lines, 'Base' || r.k, NULL, '', '', CAST(i * 5 + 1 AS INT), CAST(i * 5 + 3 AS INT) FROM texts t JOIN r ON t.f = r.f)
      SELECT node_id, name, docstring, a AS start_line, b AS end_line, comments, '# File: ' || f || chr(10) || '# Class: ' || name || chr(10) || '# Bases: ' || bases
      || coalesce(chr(10) || '# Docstring: ' || docstring, '') || CASE WHEN comments <> '' THEN chr(10) || '# Comments: ' || comments ELSE '' END || chr(10) || chr(10) || '# Code:' || chr(10) || array_to_string(lines[a:b], chr(10)) AS content FROM defs""",
    "comment_range_join": _S + "SELECT f || '::Supplier' || k || '.charge' AS id, 'adds the amount of ' || k AS comments FROM s UNION ALL SELECT f || '::helper_' || k, 'reads the region' FROM s",
    "resolve_calls": _S + "SELECT f || '::Supplier' || k || '.charge' AS src, f || '::helper_' || k AS target FROM s UNION ALL SELECT f || '::test_' || k, f || '::helper_' || k FROM s",
    "resolve_instantiations": _S + "SELECT f || '::helper_' || k AS src, f || '::Supplier' || k AS target FROM s",
    "resolve_inherits": _S + "SELECT f || '::Supplier' || k AS src, 'shared/base.py::Base' || b AS target FROM s",
    "resolve_variables": _S + "SELECT f || '::Supplier' || k || '.__init__' AS src, f || '::LIMIT_' || k AS target FROM s UNION ALL SELECT f, f || '::LIMIT_' || k FROM s UNION ALL SELECT f, f || '::RATES' FROM s",
    "resolve_attr_hierarchy": _S + """SELECT f || '::Supplier' || k || '.__init__' AS src, f || '::Supplier' || k || '::inst_attr::' || a AS target FROM s, (VALUES ('name'), ('total')) t(a)
      UNION ALL SELECT f || '::Supplier' || k || '.charge', f || '::Supplier' || k || '::inst_attr::total' FROM s UNION ALL SELECT f || '::Supplier' || k || '.charge', 'shared/base.py::Base' || b || '::inst_attr::region' FROM s
      UNION ALL SELECT f || '::Base' || k || '.__init__', f || '::Base' || k || '::inst_attr::region' FROM r""",
    "resolve_attr_order": _N + """SELECT f || '::Node' || k || '.show' AS src, t AS target FROM n, (VALUES ('lib/parts.py::Zeta::inst_attr::color'), ('lib/parts.py::Top::inst_attr::shape')) v(t)
      UNION ALL SELECT 'lib/parts.py::' || c || '.__init__', 'lib/parts.py::' || c || '::inst_attr::' || a FROM (VALUES ('Top', 'shape'), ('Zeta', 'color'), ('Alpha', 'color'), ('Alpha', 'shape')) v(c, a)""",
    "ast_scope_variables": _N + """SELECT f || '::Node' || k || '.show' AS src, t AS target FROM n, (VALUES ('width'), ('item'), ('rest'), ('height'), ('color'), ('shape'), ('depth')) v(t)
      UNION ALL SELECT f || '::order_' || k, t FROM n, (VALUES ('node'), ('show'), ('queue'), ('parts')) v(t)""",
    "ast_class_signatures": _N + """SELECT f || '::Node' || k AS id, '(' || chr(10) || '    Zeta, Alpha,  # in this order' || chr(10) || '    metaclass=type,' || chr(10) || ')' AS signature, 'Zeta,Alpha' AS bases, 6 AS start_line, 14 AS end_line FROM n
      UNION ALL SELECT 'lib/parts.py::' || c, g, CASE WHEN g = '()' THEN '' ELSE 'Top' END, a, b FROM (VALUES ('Top', '()', 1, 3), ('Zeta', '(Top)', 6, 8), ('Alpha', '()', 11, 14)) v(c, g, a, b)""",
    "ast_imports_standard": _N + "SELECT f || '::import::' || i AS id, m AS module, x AS is_internal FROM n, (VALUES ('queue', 'queue', false), ('lib.parts', 'lib.parts', true), ('lib.parts::Zeta', 'lib.parts', true), ('lib.parts::Alpha', 'lib.parts', true)) v(i, m, x)",
    "param_lineage": _S + "SELECT f || '::Supplier' || k || '.charge' AS caller, f || '::helper_' || k AS \"function\", 22 AS line, 'positional/inferred' AS bound_argument, 1 AS hops FROM s UNION ALL SELECT f || '::test_' || k, f || '::helper_' || k, 33, 'positional/inferred', 1 FROM s",
    "state_refs": _S + """SELECT 'SUPPLIER_1' AS symbol, 'EnvVar' AS kind, 'SUPPLIER_' || k AS name, f || '::helper_' || k AS "user" FROM s WHERE 'SUPPLIER_' || k LIKE 'SUPPLIER\\_1%' ESCAPE '\\'
      UNION ALL SELECT 'total', 'InstanceAttribute', 'total', f || '::Supplier' || k || m FROM s, (VALUES ('.__init__'), ('.charge')) t(m)
      UNION ALL SELECT 'LIMIT_2', 'Variable', 'LIMIT_2', f || x FROM s, (VALUES ('::Supplier2.__init__'), ('')) t(x) WHERE k = 2""",
    "test_trace": _S + "SELECT f || '::test_' || k AS id, 1 AS distance FROM s",
    "type_hierarchy": _S + """SELECT 'descendant' AS relation, f || '::Supplier' || k AS id, 1 AS distance FROM s WHERE b = 1 UNION ALL SELECT 'method', f || '::Base1.__init__', 1 FROM r WHERE k = 1
      UNION ALL SELECT 'ancestor', 'shared/base.py::Base' || b, 1 FROM s WHERE k = 1 UNION ALL SELECT 'method', f || '::Supplier1' || m, 1 FROM s, (VALUES ('.__init__'), ('.charge')) t(m) WHERE k = 1""",
    "coupling_cycles": _S + "SELECT f || '::Supplier' || k || ' -> ' || f || '::Supplier' || k || '.charge -> ' || f || '::helper_' || k AS cycle, 3 AS length FROM s",
    "coupling_of_symbol": _S + "SELECT f || '::Supplier' || k || ' -> ' || f || '::Supplier' || k || '.charge -> ' || f || '::helper_' || k AS cycle, 3 AS length FROM s WHERE 'Supplier' || k LIKE 'Supplier1%'",
    "file_imports": _S + "SELECT f AS from_file, 'shared/base.py' AS to_file FROM s",
    "call_graph_in_file": _S + """SELECT f || '::Supplier' || k || '.charge' AS id, 0 AS distance FROM s WHERE k = 1""",
    "endpoints": _S + "SELECT f || '::Supplier' || k || '.charge' AS id, '/suppliers/' || k AS route_path, 'GET' AS http_method, 20 AS line FROM s",
}
