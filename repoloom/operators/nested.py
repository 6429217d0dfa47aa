"""Flatten deeply nested JSON records into related tables by shared inlining.

The schema graph of a record decides the tables: an element gets a table of its own if it is the root, if it repeats
below some parent, if several parents share it or if it is recursive; every other descendant is inlined as columns of
its nearest table. Each row has the path of its own element as key and the path of its parent's as foreign key. A graph
is declared, or analysed from the records (:func:`infer_graph`); :func:`fields` reports what a graph leaves out.

The whole extraction is one projection over Spark's VARIANT type followed by one ``explode``: no shuffle, no Python.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.session import cut, materialise, spread


def _step(label: str) -> str:
    """The step of a variant path to a label."""
    return f".{label}" if re.fullmatch(r"[A-Za-z_]\w*", label, re.A) else f"[{json.dumps(label, ensure_ascii=False)}]"


@dataclass(frozen=True)
class Edge:
    """``parent.label`` holds ``child``; ``many`` if it repeats, ``text`` if a bare text may stand for the object."""

    parent: str
    label: str
    child: str
    many: bool = True
    text: bool = False


@dataclass(frozen=True)
class SchemaGraph:
    """Elements, their scalar attributes (name -> SQL type) and the edges between them."""

    root: str
    edges: tuple[Edge, ...]
    attributes: dict[str, dict[str, str]] = field(default_factory=dict)

    def children(self, element: str) -> list[Edge]:
        return [e for e in self.edges if e.parent == element]

    def recursive(self) -> set[str]:
        """Elements that can contain themselves."""
        reach = {e.parent: {x.child for x in self.children(e.parent)} for e in self.edges}
        grown = True
        while grown:
            grown = False
            for start, seen in reach.items():
                more = set().union(*(reach.get(x, set()) for x in seen)) - seen
                if more:
                    seen |= more
                    grown = True
        return {x for x, seen in reach.items() if x in seen}

    def tables(self) -> list[str]:
        """The elements that shared inlining gives a table, in depth-first order from the root."""
        incoming: dict[str, list[Edge]] = {}
        for e in self.edges:
            incoming.setdefault(e.child, []).append(e)
        own = {self.root} | self.recursive()
        own |= {c for c, es in incoming.items() if len(es) > 1 or any(e.many for e in es)}
        order: list[str] = []

        def visit(element: str) -> None:
            if element in order:
                return
            order.append(element)
            for e in self.children(element):
                visit(e.child)

        visit(self.root)
        return [x for x in order if x in own]

    def leading_to(self, kinds: set[str]) -> set[str]:
        """The elements below which, or at which, one of ``kinds`` can occur."""
        out = set(kinds)
        while more := {e.parent for e in self.edges if e.child in out} - out:
            out |= more
        return out

    def inlined(self, element: str) -> dict[str, tuple[str, str]]:
        """Columns of an element's table: column -> (variant path, SQL type), singleton descendants included."""
        out = {a: (f"${_step(a)}", t) for a, t in self.attributes.get(element, {}).items()}
        own = set(self.tables())
        for e in self.children(element):
            if e.child not in own:
                for column, (path, kind) in self.inlined(e.child).items():
                    out[f"{e.label}_{column}"] = (f"${_step(e.label)}{path[1:]}", kind)
        return out


#: The record of one parsed file.
FILE_DETAIL = SchemaGraph(
    root="file_detail",
    edges=(
        Edge("file_detail", "classes", "class"),
        Edge("file_detail", "functions", "function"),
        Edge("file_detail", "method_calls", "method_call"),
        Edge("file_detail", "control_flow", "control_flow"),
        Edge("class", "methods", "method"),
        Edge("class", "class_variables", "class_variable"),
        Edge("class", "instance_variables", "instance_variable"),
        Edge("function", "parameters", "parameter", text=True),
        Edge("method", "parameters", "parameter", text=True),
        Edge("control_flow", "items", "with_item"),
        Edge("control_flow", "exceptions", "exception", text=True),
    ),
    attributes={
        "file_detail": {"path": "string", "absolute_path": "string", "language": "string", "lines_of_code": "int"},
        "class": {"name": "string", "line": "int", "docstring": "string"},
        "function": {"name": "string", "line": "int", "is_async": "boolean", "is_nested": "boolean", "returns": "string", "docstring": "string", "is_react_component": "boolean"},
        "method": {"name": "string", "line": "int", "is_async": "boolean", "is_nested": "boolean", "returns": "string", "docstring": "string"},
        "class_variable": {"name": "string", "line": "int", "type": "string"},
        "instance_variable": {"name": "string", "line": "int", "type": "string", "method": "string"},
        "parameter": {"name": "string", "default": "string", "type": "string"},
        "method_call": {"caller": "string", "class_name": "string", "method": "string", "line": "int"},
        "control_flow": {"type": "string", "function": "string", "line": "int", "condition": "string", "has_else": "boolean", "target": "string", "iter": "string", "has_except": "boolean", "has_finally": "boolean", "has_value": "boolean", "call_name": "string", "call_label": "string", "action_label": "string"},
        "with_item": {"var": "string", "context": "string", "label": "string"},
        "exception": {"name": "string"},
    },
)

_ANY_ARRAY, _ANY_OBJECT = "'array<variant>'", "'map<string,variant>'"


def _array_of(value: str, text: bool) -> str:
    """SQL: the array a variant stands for: itself, an object as an array of one, or JSON text of either."""
    parsed = f"try_parse_json(try_variant_get({value}, '$', 'string'))"
    bare = f"if(length(trim(try_variant_get({value}, '$', 'string'))) > 0, array({value}), null)" if text else "null"
    return (
        f"coalesce(try_variant_get({value}, '$', {_ANY_ARRAY}),"
        f" if(try_variant_get({value}, '$', {_ANY_OBJECT}) is not null, array({value}), null),"
        f" try_variant_get({parsed}, '$', {_ANY_ARRAY}),"
        f" if(try_variant_get({parsed}, '$', {_ANY_OBJECT}) is not null, array({parsed}), null),"
        f" {bare}, cast(array() as array<variant>))"
    )


def _kept(edge: Edge, x: str) -> str:
    """SQL: whether an array element gives a row: an object, or a text where the schema allows one."""
    is_object = f"try_variant_get({x}, '$', {_ANY_OBJECT}) is not null"
    return f"(not is_variant_null({x}) and try_variant_get({x}, '$', {_ANY_ARRAY}) is null)" if edge.text else f"({is_object})"


def _expand(graph: SchemaGraph, element: str, value: str, path: str, stop: set[str], kinds: set[str], depth: int = 0, prefix: str = "") -> str | None:
    """SQL: array<struct<kind, label, parent_path, pos, value>> of the ``kinds`` below ``value``, recursive elements excepted.

    ``path`` is that of the nearest table; ``prefix`` the labels of the inlined elements between it and ``value``.
    """
    parts: list[str] = []
    tables, useful = set(graph.tables()), graph.leading_to(kinds)
    for n, e in enumerate(graph.children(element)):
        if e.child not in useful:
            continue
        x, i = f"x{depth}_{n}", f"i{depth}_{n}"
        array, label = _array_of(f"try_variant_get({value}, {_text('$' + _step(e.label))}, 'variant')", e.text), prefix + e.label
        if e.child in tables and (e.child in kinds or e.child in stop):
            parts.append(f"filter(transform({array}, ({x}, {i}) -> if({_kept(e, x)}, named_struct('kind', {_text(e.child)}, 'label', {_text(label)}, 'parent_path', {path}, 'pos', {i}, 'value', {x}), null)), q -> q is not null)")
        if graph.children(e.child) and e.child not in stop:
            if e.child in tables:
                below = _expand(graph, e.child, x, f"concat({path}, {_text(f'.{label}[')}, {i}, ']')", stop, kinds, depth + 1)
            else:
                below = _expand(graph, e.child, x, path, stop, kinds, depth + 1, f"{label}.")
            if below:
                parts.append(f"flatten(transform({array}, ({x}, {i}) -> {below}))")
    if not parts:
        return None
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def _text(value: str) -> str:
    """SQL: a string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _root(graph: SchemaGraph, doc: str, text: str) -> str:
    """SQL: the record of a parsed ``doc`` and its JSON ``text`` inside its wrapping, or null.

    The record is the outermost object, the first of its level, that has a label of the root's edges, or else one of its
    attributes. Objects, arrays and JSON texts may wrap it, under any label and to any depth.
    """
    as_object = lambda v: f"try_variant_get({v}, '$', {_ANY_OBJECT})"
    nested = lambda v: f"({as_object(v)} is not null or try_variant_get({v}, '$', {_ANY_ARRAY}) is not null)"
    opened = lambda vs: f"filter(transform({vs}, t -> if({nested('t')}, t, try_parse_json(try_variant_get(t, '$', 'string')))), t -> t is not null and {nested('t')})"
    below = lambda vs: opened(f"flatten(transform({vs}, w -> coalesce(map_values({as_object('w')}), try_variant_get(w, '$', {_ANY_ARRAY}), cast(array() as array<variant>))))")
    tries = []
    deepest = f"if(contains({text}, '\\\\u'), length({text}), length({text}) - length(translate({text}, '{{[', '')) + 1)"
    for labels in ([e.label for e in graph.children(graph.root)], list(graph.attributes.get(graph.root, {}))):
        if labels:
            known = ", ".join(map(_text, labels))
            fits = lambda v: f"arrays_overlap(map_keys({as_object(v)}), array({known}))"  # noqa: B023, E731
            tries.append(f"if({fits(doc)}, {doc}, null)")
            hit = f"try_element_at(filter(a.level, r -> {fits('r')}), 1)"
            start = f"named_struct('hit', cast(null as variant), 'level', {opened(f'array({doc})')})"
            # a text without any of the labels needs no search
            may = " or ".join(f"contains({text}, {_text(x)})" for x in [*labels, "\\u"])
            tries.append(f"if({may}, aggregate(sequence(1, {deepest}), {start}, (a, n) -> if(a.hit is not null or size(a.level) = 0, a, named_struct('hit', {hit}, 'level', if(exists(a.level, r -> {fits('r')}), a.level, {below('a.level')}))), a -> a.hit), null)")
    return f"coalesce({', '.join(tries)})"


_ELEMENT = ("e.kind", "e.label", "e.parent_path", "e.pos", "e.value")


def _records(records: DataFrame, id_col: str, json_col: str, graph: SchemaGraph) -> DataFrame:
    parsed = records.select(F.col(id_col), F.expr(f"try_parse_json(`{json_col}`)").alias("doc"), F.col(json_col).alias("_text"))  # parsed once; a null record explodes to no row
    return parsed.select(id_col, F.expr(_root(graph, "doc", "_text")).alias("record"))


def elements(records: DataFrame, id_col: str, json_col: str, graph: SchemaGraph, kinds: set[str] | None = None) -> DataFrame:
    """Every element below each record: ``id_col, kind, label, parent_path, pos, value`` (VARIANT), one row per element.

    ``kinds`` leaves out other elements. Null, damaged or empty JSON gives no row. Null array elements give no row but
    keep their position. An object in place of an array is an array of one; an array written as JSON text is that
    array. Repeated records give repeated rows (see :func:`found`); other columns of ``records`` are ignored, whatever
    their names. An empty table gives an empty result. Recursive elements are expanded level by level until nothing is
    left, with a checkpoint per level.
    """
    stop = graph.recursive()
    wanted = set(graph.tables()) if kinds is None else set(kinds)
    base = _records(records, id_col, json_col, graph)

    def exploded(df: DataFrame, element: str, value: str, path: str) -> DataFrame | None:
        below = _expand(graph, element, value, path, stop, wanted)
        return df.select(id_col, F.expr(f"explode({below})").alias("e")).select(id_col, *_ELEMENT) if below else None

    first = exploded(base, graph.root, "record", "'$'")
    if first is None:
        first = base.limit(0).select(id_col, F.expr("explode(cast(null as array<struct<kind: string, label: string, parent_path: string, pos: int, value: variant>>))").alias("e")).select(id_col, *_ELEMENT)
    if not stop & graph.leading_to(wanted):
        return first.where(F.col("kind").isin(*wanted)) if stop else first
    out, frontier = first, first.where(F.col("kind").isin(*stop))
    while not (frontier := cut(frontier)).isEmpty():
        levels = [x for element in sorted(stop) if (x := exploded(frontier.where(F.col("kind") == element), element, "value", "concat(parent_path, '.', label, '[', pos, ']')")) is not None]
        if not levels:
            break
        below = levels[0]
        for level in levels[1:]:
            below = below.unionByName(level)
        out, frontier = out.unionByName(below), below.where(F.col("kind").isin(*stop))
    return out.where(F.col("kind").isin(*wanted))


def found(records: DataFrame, id_col: str = "detail_id", json_col: str = "detail", graph: SchemaGraph | None = None) -> DataFrame:
    """Distinct ``id_col, kind, parent_path, pos``: a record that was delivered twice counts once.

    Where a parent holds one kind under several labels, ``label`` tells them apart; see :func:`flat_table`.
    """
    return elements(records, id_col, json_col, graph or FILE_DETAIL).select(id_col, "kind", "parent_path", F.col("pos").cast("int").alias("pos")).distinct()


def _columns(graph: SchemaGraph, kind: str, value: str, id_col: str) -> list[Column]:
    reserved = {id_col, *(("path",) if kind == graph.root else ("parent_path", "label", "pos", "path"))}
    texts = any(e.text for e in graph.edges if e.child == kind)
    out = []
    for column, (path, sql_type) in graph.inlined(kind).items():
        one = F.expr(f"try_variant_get({value}, {_text(path)}, '{sql_type}')")
        if column == "name" and texts:
            one = F.when(F.expr(f"try_variant_get({value}, '$', {_ANY_OBJECT}) is null"), F.expr(f"try_variant_get({value}, '$', 'string')")).otherwise(one)
        out.append(one.alias(f"own_{column}" if column in reserved else column))
    return out


def _flat(rows: DataFrame, kind: str, id_col: str, graph: SchemaGraph) -> DataFrame:
    own_path = F.concat("parent_path", F.lit("."), F.col("label"), F.lit("["), F.col("pos"), F.lit("]"))
    return rows.select(id_col, "parent_path", "label", F.col("pos").cast("int").alias("pos"), own_path.alias("path"), *_columns(graph, kind, "value", id_col)).distinct()


def flat_table(records: DataFrame, kind: str, id_col: str = "detail_id", json_col: str = "detail", graph: SchemaGraph | None = None) -> DataFrame:
    """The table of one element: key ``(id_col, path)``, foreign key ``(id_col, parent_path)``, and its columns.

    ``parent_path`` joins to ``path`` of the parent's table, that of the root has the path ``$``. A value of another
    type than the schema's is cast if it can be, else null; a text that stands for an object becomes its ``name``; the
    columns of the element that would clash with those of the key begin with ``own_``. Equal rows of one id are one.
    """
    graph = graph or FILE_DETAIL
    if kind == graph.root:
        base = _records(records, id_col, json_col, graph).where("record is not null")
        return base.select(id_col, F.lit("$").alias("path"), *_columns(graph, kind, "record", id_col)).distinct()
    return _flat(elements(records, id_col, json_col, graph, {kind}), kind, id_col, graph)


def flat_tables(records: DataFrame, id_col: str = "detail_id", json_col: str = "detail", graph: SchemaGraph | None = None) -> dict[str, DataFrame]:
    """All tables of the graph by element; the elements are extracted once and written, for all tables to read."""
    graph = graph or FILE_DETAIL
    rows = materialise(elements(records, id_col, json_col, graph), "elements")
    out = {graph.root: flat_table(records, graph.root, id_col, json_col, graph)}
    return out | {kind: _flat(rows.where(F.col("kind") == kind), kind, id_col, graph) for kind in graph.tables() if kind != graph.root}


def _walk(graph: SchemaGraph | None, record: object, root: str, seen: Counter) -> None:
    """Count ``(element, label, shape, child)`` of a record; ``child`` is the element that a graph declares, or the label."""
    edges = {(e.parent, e.label): e.child for e in graph.edges} if graph else {}
    todo: list[tuple[str, dict]] = [(root, record)] if isinstance(record, dict) else []
    while todo:
        element, value = todo.pop()
        for label, below in value.items():
            child = edges.get((element, label), label)
            inner = below
            if isinstance(below, str) and below.lstrip()[:1] in ("[", "{"):
                try:
                    inner = json.loads(below)
                except ValueError:
                    pass
            many = isinstance(inner, list)
            objects = [x for x in inner if isinstance(x, dict)] if many else [inner] if isinstance(inner, dict) else []
            if objects or many:
                shape = ("array of objects" if many else "object") if objects else "array"
            else:
                shape = {str: "string", bool: "boolean", int: "int", float: "double"}.get(type(below), "null")
            seen[element, label, shape] += 1
            todo += [(child, x) for x in objects]


def _unwrapped(graph: SchemaGraph | None, doc: object) -> object:
    """The record inside its wrapping, as :func:`_root` finds it; without a graph the document itself."""
    if graph is None:
        return doc
    for labels in ({e.label for e in graph.children(graph.root)}, set(graph.attributes.get(graph.root, {}))):
        level = [doc]
        while level:
            opened = []
            for x in level:
                if isinstance(x, str):
                    try:
                        x = json.loads(x)
                    except ValueError:
                        pass
                opened.append(x)
            if hit := next((x for x in opened if isinstance(x, dict) and labels & x.keys()), None):
                return hit
            level = [y for x in opened for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return None


def fields(records: DataFrame, json_col: str = "detail", graph: SchemaGraph | None = None, root: str = "record") -> DataFrame:
    """``element, label, shape, n, known``: every field that occurs in the records, how often, and whether ``graph`` has it.

    ``shape`` is ``object``, ``array of objects``, ``array``, ``string``, ``boolean``, ``int``, ``double`` or ``null``;
    an object or array written as JSON text counts as what it says. Without a graph, ``root`` names the root, an element
    is what stands under one label and every field is unknown. Null and damaged records count nothing. A walk over
    trees of any depth is no built-in expression: records are walked in an Arrow map that emits counts only.
    """
    top = graph.root if graph else root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                try:
                    doc = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    continue
                _walk(graph, _unwrapped(graph, doc), top, seen)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([seen[k] for k in keys], pa.int64())], names=["element", "label", "shape", "n"])

    counts = spread(records.select(json_col)).mapInArrow(run, "element string, label string, shape string, n bigint").groupBy("element", "label", "shape").agg(F.sum("n").alias("n"))
    declared = {(e.parent, e.label) for e in graph.edges} | {(x, a) for x, labels in graph.attributes.items() for a in labels} if graph else set()
    known = F.struct("element", "label").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in sorted(declared)]) if declared else F.lit(False)
    return counts.withColumn("known", known)


def infer_graph(records: DataFrame, json_col: str = "detail", root: str = "record") -> SchemaGraph:
    """The schema graph of the records, analysed from all of them.

    Labels that hold objects are elements, the same label below several parents a shared one; an element repeats where
    it stands in an array. Scalars are attributes, of the type that all their values have, else strings; arrays of
    scalars stay JSON text. The driver holds one row per element, label and shape: the vocabulary of the schema.
    """
    rows = fields(records, json_col, None, root).where("shape <> 'null'").collect()
    by: dict[tuple[str, str], set[str]] = {}
    for r in rows:
        by.setdefault((r.element, r.label), set()).add(r["shape"])
    edges = [Edge(a, b, b, many="array of objects" in shapes) for (a, b), shapes in sorted(by.items()) if shapes & {"object", "array of objects"}]
    attributes: dict[str, dict[str, str]] = {}
    for (a, b), shapes in sorted(by.items()):
        if not shapes & {"object", "array of objects"}:
            kind = {frozenset({"int"}): "bigint", frozenset({"int", "double"}): "double", frozenset({"double"}): "double", frozenset({"boolean"}): "boolean"}.get(frozenset(shapes), "string")
            attributes.setdefault(a, {})[b] = kind
    return SchemaGraph(root, tuple(edges), attributes)
