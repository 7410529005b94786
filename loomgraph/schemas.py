"""Columns of the node tables, one struct for each label, and of edges."""

from __future__ import annotations

NODE_COLUMNS = {
    "File": "id string, name string, file_path string",
    "Variable": "id string, name string, file_path string, start_line int",
    "Class": "id string, name string, signature string, file_path string, bases array<string>, attributes array<string>, start_line int, end_line int",
    "ClassAttribute": "id string, name string, class_id string, class_name string, file_path string, start_line int",
    "Function": "id string, name string, signature string, file_path string, class_name string, parameters array<string>, start_line int, end_line int, is_method boolean",
    "Parameter": "id string, name string, function_id string",
    "InstanceAttribute": "id string, name string, class_id string, class_name string, file_path string, start_line int",
    "EnvVar": "id string, name string, default_value string",
    "EnvVarUsage": "env_name string, default_value string, scope_id string, line int",
    "Import": "id string, file_path string, module string, imported_symbol string, alias string, is_from_import boolean, is_internal boolean",
}
EDGE_COLUMNS = "src string, edge string, target string, line int"
# Edge types followed by default, and those that lead to a name instead of a node.
TRAVERSED = ("RESOLVED_CALLS", "CALLS", "IMPORTS", "RESOLVED_INHERITS", "INHERITS_FROM", "INSTANTIATES", "USES_ENV", "HAS_INSTANCE_ATTRIBUTE", "CONTAINS_VARIABLE")
BY_NAME = ("CALLS", "USES_VARIABLE", "USES_INSTANCE_ATTRIBUTE", "INHERITS_FROM")
RAW_LABELS = ("Target", "RawVariable", "RawInstanceAttribute")
BUILTINS = ("print", "len", "range", "isinstance", "str", "int", "dict", "list", "set", "repr", "super", "type", "getattr", "setattr", "hasattr")
