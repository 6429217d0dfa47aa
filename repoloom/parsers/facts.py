"""One parse per file: every fact of a file as a row of one wide table.

``fact`` says what a row is (function, class, method, import, global_variable, local_variable, execution_variable,
class_variable, instance_variable, decorator, function_call, method_call, class_instantiation, import_usage,
control_flow, warning, declared_global, sql_table, sql_column, sql_relationship, endpoint); ``seq`` is the order in
which the parser found it. Tables are filters over this one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from repoloom.session import spread

_TEXT = ("fact", "name", "qualified", "class_name", "module", "alias", "kind", "caller", "returns", "docstring", "type", "source", "condition", "target", "iter", "call_name", "call_label", "action_label", "severity", "message", "from_table", "from_column", "to_table", "to_column", "error")
_FLAGS = ("is_async", "is_nested", "is_method", "is_static", "is_react_component", "has_else", "has_except", "has_finally", "has_value", "is_primary_key", "is_foreign_key", "is_unique", "is_not_null")
_LISTS = ("parameters", "decorators", "bases", "exceptions")
_INTS = ("line", "previous_line", "global_line")

ARROW_SCHEMA = pa.schema(
    [pa.field("project_id", pa.string()), pa.field("path", pa.string()), pa.field("language", pa.string()), pa.field("seq", pa.int32())]
    + [pa.field(n, pa.string()) for n in _TEXT]
    + [pa.field(n, pa.int32()) for n in _INTS]
    + [pa.field(n, pa.bool_()) for n in _FLAGS]
    + [pa.field(n, pa.list_(pa.string())) for n in _LISTS]
    + [pa.field("items", pa.list_(pa.struct([("var", pa.string()), ("context", pa.string()), ("label", pa.string())])))]
)
SPARK_SCHEMA = ", ".join(
    ["project_id string", "path string", "language string", "seq int", *(f"{n} string" for n in _TEXT), *(f"{n} int" for n in _INTS), *(f"{n} boolean" for n in _FLAGS), *(f"{n} array<string>" for n in _LISTS), "items array<struct<var:string,context:string,label:string>>"]
)


def parse_text(language: str, content: str, path: str = "") -> list[dict]:
    """The facts of one text as dictionaries; a text that cannot be parsed is one row with its ``error``."""
    from repoloom.parsers import braces, python, sql, universal

    try:
        if language == "python":
            return python.facts(content)
        if language == "javascript":
            return braces.javascript(content)
        if language == "java":
            return braces.java(content)
        if language == "sql":
            return sql.facts(content)
        return universal.facts(content, language)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return [{"fact": "error", "error": str(problem)}]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        for project, path, language, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for seq, fact in enumerate(parse_text(language or "text", content or "", path or "")):
                rows.append({"project_id": project, "path": path, "language": language, "seq": seq, **fact})
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)


def parse_files(files: DataFrame) -> DataFrame:
    """Facts of files given as ``project_id, path, language, content``.

    A null or empty content has no facts; a null language is parsed as plain text; a file that fails gives one row with
    ``fact = 'error'`` and the scan goes on. Other columns are ignored. A narrow map: no shuffle.
    """
    return spread(files.select("project_id", "path", "language", "content"), "path").mapInArrow(_parse, SPARK_SCHEMA)
