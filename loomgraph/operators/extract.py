"""Nodes, edges and texts from Python source: one parse of each file, one tagged row for each thing found."""

from __future__ import annotations

import ast
import io
import re
import sys
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGGED = "kind string, id string, name string, file_path string, a string, b string, c string, items array<string>, more array<string>, start_line int, end_line int, flag boolean, text string"
_COLUMNS = [x.split()[0] for x in TAGGED.split(", ")]
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_VERBS = ("get", "post", "put", "delete", "patch", "route", "websocket", "head", "options")


def _names(target: ast.AST) -> Iterator[ast.Name]:
    if isinstance(target, ast.Name):
        yield target
    elif isinstance(target, (ast.Tuple, ast.List)):
        for x in target.elts:
            yield from _names(x)
    elif isinstance(target, ast.Starred):
        yield from _names(target.value)


def _targets(stmt: ast.stmt) -> list[ast.AST]:
    if isinstance(stmt, ast.Assign):
        return list(stmt.targets)
    if isinstance(stmt, (ast.AugAssign, ast.AnnAssign)):
        return [stmt.target]
    return [stmt.name] if isinstance(stmt, ast.TypeAlias) else []


def _env(node: ast.AST) -> tuple[str, str | None] | None:
    """Name and default of a read of the environment, whose first argument must be a literal."""
    if isinstance(node, ast.Subscript) and ast.unparse(node.value) == "os.environ" and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
        return node.slice.value, None
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and ast.unparse(node.func) in ("os.getenv", "os.environ.get", "os.environ.setdefault"):
        args = node.args
        if args and isinstance(args[0], ast.Constant) and isinstance(args[0].value, str):
            given = args[1] if len(args) > 1 else next((k.value for k in node.keywords if k.arg == "default"), None)
            default = None if given is None else given.value if isinstance(given, ast.Constant) and isinstance(given.value, str) else ast.unparse(given)
            return args[0].value, default
    return None


class _File:
    """Collects the rows of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.rows, self.lines = path, [], re.split(r"\r\n|\r|\n", text)
        if self.lines and not self.lines[-1]:
            self.lines.pop()
        self.tree = ast.parse(text)
        self.text = text

    def add(self, kind: str, id: str | None, name: str | None, **more) -> None:
        row = dict.fromkeys(_COLUMNS)
        row.update(kind=kind, id=id, name=name, file_path=self.path, **more)
        self.rows.append(tuple(row[c] for c in _COLUMNS))

    def run(self) -> list[tuple]:
        p = self.path
        self.add("File", p, p.rpartition("/")[2], a=ast.get_docstring(self.tree), end_line=len(self.lines), text="\n".join(self.lines))
        self._module_variables(self.tree.body, set())
        for stmt in self.tree.body:
            self._import(stmt)
        self._definitions(self.tree, None)
        self._scope(self.tree.body, p, None, set())
        try:
            for t in tokenize.generate_tokens(io.StringIO(self.text).readline):
                if t.type == tokenize.COMMENT:
                    self.add("Comment", None, t.string.strip().lstrip("#").strip(), start_line=t.start[0], flag=t.start[1] == 0)
        except (tokenize.TokenError, IndentationError, SyntaxError):
            pass
        return self.rows

    def _module_variables(self, body: list[ast.stmt], seen: set[str]) -> None:
        for stmt in body:
            for target in _targets(stmt):
                for name in _names(target):
                    if name.id not in seen:
                        seen.add(name.id)
                        self.add("Variable", f"{self.path}::{name.id}", name.id, start_line=name.lineno)
            if isinstance(stmt, ast.If):
                self._module_variables([*stmt.body, *stmt.orelse], seen)

    def _import(self, stmt: ast.stmt) -> None:
        if isinstance(stmt, ast.Import):
            for x in stmt.names:
                self.add("Import", f"{self.path}::import::{x.name}", None, a=x.name, c=x.asname, flag=False)
        elif isinstance(stmt, ast.ImportFrom) and stmt.module != "__future__":
            module = "." * stmt.level + (stmt.module or "")
            for x in stmt.names:
                if x.name != "*":
                    self.add("Import", f"{self.path}::import::{module}::{x.name}", None, a=module, b=x.name, c=x.asname, flag=True)

    def _slice(self, node: ast.AST) -> str:
        return "\n".join(self.lines[node.lineno - 1 : node.end_lineno])

    def _bases(self, node: ast.ClassDef) -> str:
        """The list of bases and keywords in brackets as it is written."""
        args = [*node.bases, *node.keywords]
        if not args:
            return "()"
        source = "\n".join(self.lines).encode()
        starts = [0]
        for line in self.lines:
            starts.append(starts[-1] + len(line.encode()) + 1)
        at = lambda line, col: starts[line - 1] + col
        first = min(at(x.lineno, x.col_offset) for x in args)
        last = max(at(x.end_lineno, x.end_col_offset) for x in args)
        return source[source.rfind(b"(", at(node.lineno, node.col_offset), first) : source.find(b")", last) + 1].decode()

    def _definitions(self, node: ast.AST, cls: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                self._class(child)
                self._definitions(child, child.name)
            elif isinstance(child, _DEFS):
                self._function(child, cls)
                self._definitions(child, cls)
            else:
                self._definitions(child, cls)

    def _class(self, node: ast.ClassDef) -> None:
        id = f"{self.path}::{node.name}"
        bases = [ast.unparse(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        attributes: dict[str, int] = {}
        for stmt in node.body:
            for target in _targets(stmt):
                for name in _names(target):
                    attributes.setdefault(name.id, name.lineno)
        self.add("Class", id, node.name, a=self._bases(node), b=ast.get_docstring(node), items=bases, more=sorted(attributes), start_line=node.lineno, end_line=node.end_lineno, text=self._slice(node))
        for name, line in attributes.items():
            self.add("ClassAttribute", f"{id}::class_attr::{name}", name, a=id, b=node.name, start_line=line)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, cls: str | None) -> None:
        id = f"{self.path}::{cls}.{node.name}" if cls else f"{self.path}::{node.name}"
        args = node.args
        params = [x.arg for x in (*args.posonlyargs, *args.args)] + ([f"*{args.vararg.arg}"] if args.vararg else []) + [x.arg for x in args.kwonlyargs] + ([f"**{args.kwarg.arg}"] if args.kwarg else [])
        self.add("Function", id, node.name, a=f"({ast.unparse(args)})", b=cls, c=ast.get_docstring(node), items=params, start_line=node.lineno, end_line=node.end_lineno, flag=cls is not None, text=self._slice(node))
        for x in params:
            self.add("Parameter", f"{id}::param::{x}", x, a=id)
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in _VERBS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                self.add("Endpoint", id, node.name, a=d.args[0].value, b="ANY" if d.func.attr == "route" else d.func.attr.upper(), start_line=node.lineno)
        if cls:
            seen: set[str] = set()
            for x in ast.walk(node):
                if isinstance(x, ast.Attribute) and isinstance(x.ctx, ast.Store) and isinstance(x.value, ast.Name) and x.value.id == "self" and x.attr not in seen:
                    seen.add(x.attr)
                    self.add("InstanceAttribute", f"{self.path}::{cls}::inst_attr::{x.attr}", x.attr, a=f"{self.path}::{cls}", b=cls, start_line=x.lineno)

    def _scope(self, body: list[ast.stmt], scope: str, cls: str | None, local: set[str]) -> None:
        for stmt in body:
            self._visit(stmt, scope, cls, local)

    def _visit(self, node: ast.AST, scope: str, cls: str | None, local: set[str]) -> None:
        if isinstance(node, ast.ClassDef):
            for d in node.decorator_list:
                self._visit(d, scope, cls, local)
            self._scope(node.body, f"{self.path}::{node.name}", node.name, set())
            return
        if isinstance(node, _DEFS):
            for d in node.decorator_list:
                self._visit(d, scope, cls, local)
            plain = self._plain_parameters(node.args)
            shared = {n for x in ast.walk(node) if isinstance(x, (ast.Global, ast.Nonlocal)) for n in x.names}
            own = {n.id for s in node.body for t in _targets(s) for n in _names(t)}
            self._scope(node.body, f"{self.path}::{cls}.{node.name}" if cls else f"{self.path}::{node.name}", None, (plain | own) - shared)
            return
        env = _env(node)
        if env:
            self.add("EnvVarUsage", None, env[0], a=env[1], b=scope, start_line=node.lineno)
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, (ast.Name, ast.Attribute)):
                self._edge(scope, "CALLS", ast.unparse(f), node.lineno)
        if isinstance(node, ast.Name) and node.id not in local and node.id != "self":
            self._edge(scope, "USES_VARIABLE", node.id)
        if isinstance(node, ast.Attribute):
            if isinstance(node.value, ast.Name) and node.value.id == "self":
                self._edge(scope, "USES_INSTANCE_ATTRIBUTE", node.attr)
            if node.attr not in local:
                self._edge(scope, "USES_VARIABLE", node.attr)
        for child in ast.iter_child_nodes(node):
            self._visit(child, scope, cls, local)

    @staticmethod
    def _plain_parameters(args: ast.arguments) -> set[str]:
        """Parameters that are a name alone: without annotation, default or star."""
        before = [*args.posonlyargs, *args.args]
        bare = before[: len(before) - len(args.defaults)] + [a for a, d in zip(args.kwonlyargs, args.kw_defaults) if d is None]
        return {a.arg for a in bare if a.annotation is None}

    def _edge(self, src: str, edge: str, target: str, line: int | None = None) -> None:
        self.add("Edge", src, target, a=edge, start_line=line)


def extract(files: DataFrame) -> DataFrame:
    """Tagged rows (``TAGGED``) of ``files`` (file_path, content: bytes). A file that does not parse gives one ``_error`` row.

    Null content counts as an empty file. Files are independent, so nothing is shuffled. Read what is wanted with
    ``node_table``, ``edge_table`` and the chunk functions; keep the rows if several are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, content in zip(pdf["file_path"], pdf["content"]):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        rows += _File(path, bytes(content or b"").decode("utf-8", "replace").removeprefix("﻿")).run()
                except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                    rows.append(("_error", path, None, path, f"{type(e).__name__}: {e}", *[None] * 8))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.where("file_path is not null").select("file_path", "content").mapInPandas(run, TAGGED)


def node_table(tagged: DataFrame, label: str) -> DataFrame:
    """The node table of a label, with the columns of ``schemas.NODE_COLUMNS``; ids occur once."""
    rows, c = tagged.where(F.col("kind") == label), F.col
    if label == "File":
        return rows.select("id", "name", "file_path").distinct()
    if label == "Variable":
        return rows.groupBy("id", "name", "file_path").agg(F.min("start_line").alias("start_line"))
    if label == "Class":
        return _first(rows).select("id", "name", c("a").alias("signature"), "file_path", c("items").alias("bases"), c("more").alias("attributes"), "start_line", "end_line")
    if label in ("ClassAttribute", "InstanceAttribute"):
        return rows.groupBy("id", "name", c("a").alias("class_id"), c("b").alias("class_name"), "file_path").agg(F.min("start_line").alias("start_line"))
    if label == "Function":
        return _first(rows).select("id", "name", c("a").alias("signature"), "file_path", c("b").alias("class_name"), c("items").alias("parameters"), "start_line", "end_line", c("flag").alias("is_method"))
    if label == "Parameter":
        return rows.select("id", "name", c("a").alias("function_id")).distinct()
    if label == "EnvVarUsage":
        return rows.select(c("name").alias("env_name"), c("a").alias("default_value"), c("b").alias("scope_id"), c("start_line").alias("line"))
    if label == "EnvVar":
        uses = tagged.where("kind = 'EnvVarUsage'")
        first = F.min_by("a", F.struct("file_path", "start_line", F.coalesce("a", F.lit(""))))
        return uses.groupBy("name").agg(first.alias("default_value")).select(F.concat(F.lit("ENV::"), "name").alias("id"), "name", "default_value")
    if label == "Import":
        return rows.select("id", "file_path", c("a").alias("module"), c("b").alias("imported_symbol"), c("c").alias("alias"), c("flag").alias("is_from_import")).distinct()
    raise ValueError(f"no node table {label}")


def _first(rows: DataFrame) -> DataFrame:
    """Definitions that share an id: the first by line."""
    keep = F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct("start_line", "end_line")).alias("r")
    return rows.groupBy("id").agg(keep).select("id", "r.*")


def with_internal(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with is_internal: a leading dot, or, but for the standard library's modules, a scanned file or folder of that path (from the root or below one folder)."""
    parts = F.split("file_path", "/")
    stem = F.regexp_replace("file_path", r"(?:/__init__)?\.py$", "")
    stems = files.select(parts.alias("parts"), F.split(stem, "/").alias("s"))
    tails = stems.select(F.explode(F.array(F.col("s"), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(1))))).alias("s"))
    paths = tails.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.array_join(F.slice(F.col("s"), 1, n), "."))).alias("known")).distinct()
    known = paths.select(F.col("known").alias("module"), F.lit(True).alias("hit"))
    return imports.join(known, "module", "left").withColumn("is_internal", F.coalesce(F.col("module").startswith(".") | (F.col("hit") & ~F.split("module", r"\.")[0].isin(*sorted(sys.stdlib_module_names))), F.lit(False))).drop("hit")


def edge_table(tagged: DataFrame) -> DataFrame:
    """(src, edge, target, line) of the edges seen in code, each once."""
    return tagged.where("kind = 'Edge'").select(F.col("id").alias("src"), F.col("a").alias("edge"), F.col("name").alias("target"), F.col("start_line").alias("line")).distinct()


def endpoints(tagged: DataFrame, route: str | None = None, method: str | None = None) -> DataFrame:
    """(id, route_path, http_method, line) of functions that a decorator makes endpoints; filters are optional."""
    rows = tagged.where("kind = 'Endpoint'").select("id", F.coalesce("a", F.lit("unknown")).alias("route_path"), F.coalesce("b", F.lit("ANY")).alias("http_method"), F.col("start_line").alias("line"))
    rows = rows.where(F.col("route_path").contains(route)) if route else rows
    return rows.where(F.col("http_method") == method.upper()) if method else rows


def comments_of(tagged: DataFrame, kind: str) -> DataFrame:
    """(id, comments): the comments inside each definition of a kind, in order; definitions without any have no row.

    A range join of lines, made an equality: files are cut into spans of 64 lines, and a definition is looked for in the
    spans that it covers.
    """
    span = 64
    marks = tagged.where("kind = 'Comment' and name <> ''").select("file_path", F.col("start_line").alias("line"), F.col("name").alias("text")).withColumn("span", F.floor(F.col("line") / span))
    defs = tagged.where(F.col("kind") == kind).select("id", "file_path", "start_line", "end_line")
    defs = defs.withColumn("span", F.explode(F.sequence(F.floor(F.col("start_line") / span), F.floor(F.col("end_line") / span))))
    inside = defs.join(marks, ["file_path", "span"]).where("line between start_line and end_line").select("id", "line", "text").distinct()
    return inside.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("comments"))


def code_chunks(tagged: DataFrame) -> DataFrame:
    """(node_id, file_path, name, chunk_type, docstring, inline_comments, start_line, end_line, content) of files, functions and classes."""

    def section(title: str, value) -> F.Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"# {title}: "), value))

    none = F.array().cast("array<string>")
    top = tagged.where("kind = 'Comment' and flag and name <> ''").groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]).alias("comments"))
    files = tagged.where("kind = 'File'").join(top, "file_path", "left").withColumn("comments", F.coalesce("comments", none))
    code = lambda text: F.concat(F.lit("\n# Code:\n"), text)
    file_chunks = files.select(
        F.col("id").alias("node_id"), "file_path", "name", F.lit("file").alias("chunk_type"), F.col("a").alias("docstring"), F.col("comments").alias("inline_comments"), F.lit(1).alias("start_line"), "end_line",
        F.concat_ws("\n", F.concat(F.lit("# File: "), "file_path"), section("Module Docstring", F.col("a")), section("Top-Level Comments", F.array_join("comments", ", ")), code(F.col("text"))).alias("content"),
    )
    out = file_chunks
    for kind in ("Function", "Class"):
        rows = tagged.where(F.col("kind") == kind).join(comments_of(tagged, kind), "id", "left").withColumn("comments", F.coalesce("comments", none))
        doc = F.col("c") if kind == "Function" else F.col("b")
        extra = F.concat(F.lit("# Signature: "), "name", "a") if kind == "Function" else F.concat(F.lit("# Bases: "), F.array_join("items", ", "))
        out = out.unionByName(rows.select(
            F.col("id").alias("node_id"), "file_path", "name", F.lit(kind.lower()).alias("chunk_type"), doc.alias("docstring"), F.col("comments").alias("inline_comments"), "start_line", "end_line",
            F.concat_ws("\n", F.concat(F.lit("# File: "), "file_path"), F.concat(F.lit(f"# {kind}: "), "name"), extra, section("Docstring", doc), section("Comments", F.array_join("comments", ", ")), code(F.col("text"))).alias("content"),
        ))
    return out
