"""Schemas of the property graph's tables; a missing field reads as null."""

from __future__ import annotations

from pyspark.sql.types import StructType

PARAM = "struct<name: string, annotation: string, default: string, kind: string>"
NODES = f"""id string, name string, kind string, file_path string, module string, parent string, start_byte long, end_byte long,
start_line int, end_line int, params array<{PARAM}>, returns string, signature string, docstring string, decorators array<string>,
bases array<string>, is_async boolean, complexity int, line_count int, locals array<string>, stub string, code string"""
EDGE_SITES = "source string, target string, edge_type string, line int, confidence string, call_type string, alias string, control array<string>, certain boolean, seq long"
EDGES = """source string, target string, type string, types array<string>, count long, lines array<int>, confidence string,
call_types array<string>, aliases array<string>, controls array<array<string>>, certains array<boolean>"""
CALL_SITES = "caller string, module string, file_path string, root string, attr_path array<string>, line int, control array<string>, certain boolean, seq long"
IMPORTS = "module string, alias string, target_module string, target_symbol string, is_relative boolean, level int, is_wildcard boolean, is_package boolean, line int"
REFERENCES = "owner string, module string, root string, attr_path array<string>, position string, line int"
ACCESSES = "owner string, module string, root string, attr string, kind string, line int"
OCCURRENCES = "owner string, module string, file_path string, kind string, text string, mode string, line int"
LOCALS = "scope string, module string, name string, source string, path string, line int"
DIAGNOSTICS = "file_path string, kind string, detail string, line int"
MANIFEST = "path string, mtime_ns long"

EDGE_TYPES = ("IMPORTS", "CALLS", "REFERENCES", "READS", "WRITES", "CONTAINS")
KINDS = ("module", "class", "function", "method", "variable", "attribute", "external")
CALL_KINDS, CALLABLE_KINDS, STATE_KINDS = ("function", "method", "class"), ("function", "method"), ("variable", "attribute")


def struct(ddl: str):
    """The StructType of a schema above."""
    return StructType.fromDDL(ddl)
