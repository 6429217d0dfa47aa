"""Queries over ``file_details``: nested records as flat tables (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repoloom.operators import nested
from repoloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.found(table(spark, sf_dir, "file_details"))


def _flat(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.flat_table(table(spark, sf_dir, "file_details"), kind)

    return query


def p1_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the records and whether the declared schema has it."""
    return nested.fields(table(spark, sf_dir, "file_details"), graph=nested.FILE_DETAIL)


QUERIES = {"p1_found": p1_found} | {f"p1_{kind}": _flat(kind) for kind in nested.FILE_DETAIL.tables()} | {"p1_fields": p1_fields}
ORACLES: dict[str, str] = {}


def _p1_ctes() -> tuple[str, list[tuple[str, str]]]:
    """The elements with JSON functions: unwrapped record, arrays normalised, one table per edge of the schema."""
    norm = lambda v: f"""CASE WHEN json_type({v}) = 'ARRAY' THEN from_json({v}, '["JSON"]') WHEN json_type({v}) = 'OBJECT' THEN [{v}]
        WHEN json_type({v}) = 'VARCHAR' AND json_valid({v} ->> '$') THEN CASE json_type(({v} ->> '$')::JSON) WHEN 'ARRAY' THEN from_json(({v} ->> '$')::JSON, '["JSON"]') WHEN 'OBJECT' THEN [({v} ->> '$')::JSON] ELSE [] END ELSE [] END"""  # noqa: E731
    plain, text = "json_type(v) = 'OBJECT'", "json_type(v) IN ('OBJECT', 'VARCHAR')"
    ctes, parts = [], []
    for label, kind in (("classes", "class"), ("functions", "function"), ("method_calls", "method_call"), ("control_flow", "control_flow")):
        value = norm(f"rec -> '$.{label}'")
        ctes.append(f"{kind} AS (SELECT detail_id, '$' AS parent_path, '{label}' AS label, '$.{label}[' || pos || ']' AS path, pos, v FROM (SELECT detail_id, unnest({value}) AS v, generate_subscripts({value}, 1) - 1 AS pos FROM r) WHERE {plain})")
        parts.append((kind, kind))
    for source, label, kind, keep in (("class", "methods", "method", plain), ("class", "class_variables", "class_variable", plain), ("class", "instance_variables", "instance_variable", plain), ("function", "parameters", "fparam", text), ("method", "parameters", "mparam", text), ("control_flow", "items", "with_item", plain), ("control_flow", "exceptions", "exception", text)):
        value = norm(f"o -> '$.{label}'")
        ctes.append(f"{kind} AS (SELECT detail_id, path AS parent_path, '{label}' AS label, path || '.{label}[' || pos || ']' AS path, pos, v FROM (SELECT detail_id, path, unnest({value}) AS v, generate_subscripts({value}, 1) - 1 AS pos FROM (SELECT detail_id, path, v AS o FROM {source})) WHERE {keep})")
        parts.append((kind, {"fparam": "parameter", "mparam": "parameter"}.get(kind, kind)))
    record = "CASE WHEN json_type(j -> '$.payload.file_detail') = 'OBJECT' THEN j -> '$.payload.file_detail' WHEN json_type(j -> '$.file_detail') = 'OBJECT' THEN j -> '$.file_detail' ELSE j END"
    known = ", ".join(f"'{x}'" for x in [e.label for e in nested.FILE_DETAIL.children("file_detail")] + list(nested.FILE_DETAIL.attributes["file_detail"]))
    return f"r AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT detail_id, {record} AS rec FROM (SELECT detail_id, detail::JSON AS j FROM file_details WHERE json_valid(detail))) WHERE list_has_any(json_keys(rec), [{known}])), {', '.join(ctes)}", parts


def _p1_sql() -> str:
    ctes, parts = _p1_ctes()
    union = " UNION ".join(f"SELECT detail_id, '{name}' AS kind, parent_path, pos::INT AS pos FROM {cte}" for cte, name in parts)
    return f"WITH {ctes} {union}"


def _table_sql(kind: str) -> str:
    """The rows of one table with the columns of the schema, cast where they can be."""
    ctes, parts = _p1_ctes()
    types = {"int": "INT", "boolean": "BOOLEAN", "string": "VARCHAR"}
    root = kind == nested.FILE_DETAIL.root
    value = "rec" if root else "v"
    columns = []
    for name, sql_type in nested.FILE_DETAIL.attributes[kind].items():
        one = f"{value} ->> '$.{name}'"
        if name == "name" and any(e.text for e in nested.FILE_DETAIL.edges if e.child == kind):
            one = f"CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' ELSE {one} END"
        out = f"own_{name}" if name in (("path",) if root else ("label", "path")) else name
        columns.append(f"({one}) AS {out}" if sql_type == "string" else f"TRY_CAST(({one}) AS {types[sql_type]}) AS {out}")
    if root:
        return f"WITH {ctes} SELECT DISTINCT detail_id, '$' AS path, {', '.join(columns)} FROM r"
    key = "detail_id, parent_path, label, pos::INT AS pos, path"
    union = " UNION ".join(f"SELECT {key}, {', '.join(columns)} FROM {cte}" for cte, name in parts if name == kind)
    return f"WITH {ctes} {union}"


ORACLES["p1_found"] = _p1_sql()
ORACLES |= {f"p1_{kind}": _table_sql(kind) for kind in nested.FILE_DETAIL.tables()}
