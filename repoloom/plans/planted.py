"""Queries over a few planted sources whose facts, graph and flow are known: the expected rows are checked by hand.

The sources hold what the test tables do not: warnings, used imports, calls across files, nested flow, several languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import paths
from repoloom.operators import graph, rollup
from repoloom.parsers import facts as parsing
from repoloom.parsers import splitting
from repoloom.render import flow
from repoloom.session import cut

SOURCES = {
    "app/calls.py": '''import os
import util
from util import load_it as fetch, Box

LIMIT = 3


class Base:
    kind: str = "b"


class Child(Base):
    def __init__(self, n):
        self.n = n
        LIMIT = n

    def run(self):
        self.step(os.path.join("a", "b"))
        return fetch(self.n)

    async def step(self, p):
        with open(p) as f:
            return f


def main():
    c = Child(2)
    util.load_it(c)
    for i in range(3):
        if i:
            helper(i)
        else:
            continue
    Box()
    return c


def helper(x):
    global LIMIT
    LIMIT = x
    return unknown(x)


def helper(x):
    return x + 1
''',
    "app/util.py": '''def load_it(n):
    try:
        return n
    except (ValueError, KeyError):
        pass


class Box:
    pass
''',
    "app/broken.py": "def (:\n",
    "web/view.js": '''import React, { useState } from 'react';
import * as api from './api';
const fs = require('fs');
// function hidden() {}
export class Store extends Base {
  async load(id, opts = {}) {
    return "function fake() {}";
  }
}
async function save(a, { b }) {}
const View = ({ x }) => <div>{x}</div>;
const twice = n => n * 2;
''',
    "src/Shop.java": '''package shop;
import java.util.List;
import static java.lang.Math.max;
public class Shop extends Base implements Runnable {
    public void run() {
        Cart c = new Cart();
        c.add(price(1));
    }
    private static int price(int a) { return max(a, 2); }
}
interface Small {}
''',
    "db/schema.sql": '''-- CREATE TABLE ghost (id INT);
CREATE TABLE users (
    id INT PRIMARY KEY,
    mail VARCHAR(80) NOT NULL UNIQUE
);
CREATE TABLE IF NOT EXISTS orders (
    id INT,
    user_id INT REFERENCES users(id),
    shop_id INT,
    PRIMARY KEY (id),
    FOREIGN KEY (shop_id) REFERENCES shops (id)
);
''',
}


def _files(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([("planted", path, text) for path, text in SOURCES.items()], "project_id string, path string, content string")
    return df.select("project_id", "path", paths.language_of(F.col("path")).alias("language"), "content")


def _facts(spark: SparkSession) -> DataFrame:
    return parsing.parse_files(_files(spark))


def planted_definitions(spark: SparkSession, _: str) -> DataFrame:
    rows = _facts(spark).where("fact in ('function', 'class', 'method', 'sql_table', 'error')")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return rows.select("path", "fact", F.coalesce("qualified", F.lit("")).alias("qualified"), F.coalesce("line", F.lit(0)).alias("line"), flag("is_async"), F.coalesce(F.array_join("parameters", ","), F.lit("")).alias("parameters"), F.coalesce(F.array_join("bases", ","), F.lit("")).alias("bases"))


def planted_imports(spark: SparkSession, _: str) -> DataFrame:
    return _facts(spark).where("fact = 'import'").select("path", "kind", "module", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("alias", F.lit("")).alias("alias"), "line")


def planted_warnings(spark: SparkSession, _: str) -> DataFrame:
    return _facts(spark).where("fact = 'warning'").select("path", "kind", "name", "line", F.coalesce("previous_line", "global_line").alias("other_line"), "severity")


def planted_import_usage(spark: SparkSession, _: str) -> DataFrame:
    return _facts(spark).where("fact = 'import_usage'").select("path", "caller", "module", "name", "line")


def planted_variables(spark: SparkSession, _: str) -> DataFrame:
    return _facts(spark).where("fact like '%_variable'").select("path", "fact", "name", F.coalesce("class_name", F.lit("")).alias("class_name"), "line", "type")


def planted_calls(spark: SparkSession, _: str) -> DataFrame:
    return _facts(spark).where("fact in ('function_call', 'method_call', 'class_instantiation')").select("path", "fact", "caller", F.coalesce("class_name", F.lit("")).alias("class_name"), "name", "line")


def planted_flow(spark: SparkSession, _: str) -> DataFrame:
    return _facts(spark).where("fact = 'control_flow' and kind != 'call'").select("path", "caller", "kind", "line", F.coalesce("condition", "target", F.array_join("exceptions", ","), F.lit("")).alias("about"))


def planted_tables(spark: SparkSession, _: str) -> DataFrame:
    rows = _facts(spark)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return rows.where("fact = 'sql_column'").select(F.col("class_name").alias("table_name"), "name", "type", "line", flag("is_primary_key"), flag("is_foreign_key"), flag("is_unique"), flag("is_not_null"))


def planted_relationships(spark: SparkSession, _: str) -> DataFrame:
    return _facts(spark).where("fact = 'sql_relationship'").select("from_table", "from_column", "to_table", "to_column", "type")


def planted_graph(spark: SparkSession, _: str) -> DataFrame:
    return graph.build(_facts(spark).where("path like 'app/%'"))[1].select("src", "dst", "relation", "line")


def planted_symbols(spark: SparkSession, _: str) -> DataFrame:
    """What a symbol means by each of the four ways: its name, the end of an id, module and name, the last part."""
    nodes = cut(graph.build(_facts(spark).where("path like 'app/%'"))[0])
    out = None
    for symbol in ("main", "app/calls.py:main", "calls.helper", "run", "nowhere"):
        one = graph.resolve_symbol(nodes, symbol).select(F.lit(symbol).alias("symbol"), "node_id")
        out = one if out is None else out.unionByName(one)
    return out


def planted_answers(spark: SparkSession, _: str) -> DataFrame:
    """Callers, callees, impact and dependencies in the planted graph."""
    nodes, edges = (cut(x) for x in graph.build(_facts(spark).where("path like 'app/%'")))
    asked = {"who_calls load_it": graph.who_calls(nodes, edges, "load_it"), "what_calls Child.run": graph.what_calls(nodes, edges, "Child.run"), "impact_of Child.step": graph.impact_of(nodes, edges, "Child.step"), "dependencies_of calls.py": graph.dependencies_of(nodes, edges, "calls.py")}
    out = None
    for question, answer in asked.items():
        one = answer.select(F.lit(question).alias("question"), "node_id")
        out = one if out is None else out.unionByName(one)
    return out


def planted_rollup(spark: SparkSession, _: str) -> DataFrame:
    counted = rollup.file_counts(_facts(spark))
    return counted.select("path", "total_functions", "async_functions", "total_classes", "total_methods", "total_imports", "total_global_variables", "total_function_calls", "total_method_calls", "total_class_instantiations", "total_warnings", "total_tables")


def planted_flowchart(spark: SparkSession, _: str) -> DataFrame:
    """The arrows of the flowchart of each source."""
    rows = []
    for path, text in SOURCES.items():
        language = {"py": "python", "js": "javascript", "java": "java", "sql": "sql"}[path.rsplit(".", 1)[-1]]
        chart = flow.of_file([f for f in parsing.parse_text(language, text, path) if f["fact"] != "error"], language)
        label = {n.id: n.label for n in chart.nodes}
        rows += [(path, label[a.source], label[a.target], a.label) for a in chart.arrows]
    return spark.createDataFrame(rows, "path string, source string, target string, arm string")


def planted_chunks(spark: SparkSession, _: str) -> DataFrame:
    """Per source the lines that its chunks cover, in order and once."""
    c = splitting.code_chunks(_files(spark), max_chars=200)
    return c.groupBy("path", "chunker").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).cast("bigint").alias("n_lines"), F.max("end_line").alias("last_line"), (F.max(F.length("content")) <= 200).alias("within_limit"))


QUERIES = {f.__name__: f for f in (planted_definitions, planted_imports, planted_warnings, planted_import_usage, planted_variables, planted_calls, planted_flow, planted_tables, planted_relationships, planted_graph, planted_symbols, planted_answers, planted_rollup, planted_flowchart, planted_chunks)}

#: What the queries have to give, checked by hand against the sources line by line. Fixed values.
EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "planted_definitions": (
        "path, fact, qualified, line, is_async, parameters, bases",
        [
            ("app/broken.py", "error", "", 0, False, "", ""), ("app/calls.py", "class", "Base", 8, False, "", ""), ("app/calls.py", "class", "Child", 12, False, "", "Base"),
            ("app/calls.py", "function", "helper", 38, False, "x", ""), ("app/calls.py", "function", "helper", 44, False, "x", ""), ("app/calls.py", "function", "main", 26, False, "", ""),
            ("app/calls.py", "method", "Child.__init__", 13, False, "self,n", ""), ("app/calls.py", "method", "Child.run", 17, False, "self", ""),
            ("app/calls.py", "method", "Child.step", 21, True, "self,p", ""), ("app/util.py", "class", "Box", 8, False, "", ""), ("app/util.py", "function", "load_it", 1, False, "n", ""),
            ("db/schema.sql", "sql_table", "orders", 6, False, "", ""), ("db/schema.sql", "sql_table", "users", 2, False, "", ""), ("src/Shop.java", "class", "Shop", 4, False, "", "Base,Runnable"),
            ("src/Shop.java", "class", "Small", 11, False, "", ""), ("src/Shop.java", "function", "Shop.price", 9, False, "int a", ""), ("src/Shop.java", "function", "Shop.run", 5, False, "", ""),
            ("src/Shop.java", "method", "Shop.price", 9, False, "int a", ""), ("src/Shop.java", "method", "Shop.run", 5, False, "", ""), ("web/view.js", "class", "Store", 5, False, "", "Base"),
            ("web/view.js", "function", "View", 11, False, "{ x }", ""), ("web/view.js", "function", "save", 10, True, "a,{ b }", ""), ("web/view.js", "function", "twice", 12, False, "n", ""),
            ("web/view.js", "method", "Store.load", 6, True, "id,opts", ""),
        ],
    ),
    "planted_imports": (
        "path, kind, module, name, alias, line",
        [
            ("app/calls.py", "from_import", "util", "Box", "", 3), ("app/calls.py", "from_import", "util", "load_it", "fetch", 3), ("app/calls.py", "import", "os", "", "", 1),
            ("app/calls.py", "import", "util", "", "", 2), ("src/Shop.java", "import", "java.lang.Math.max", "max", "", 3), ("src/Shop.java", "import", "java.util.List", "List", "", 2),
            ("web/view.js", "from_import", "./api", "*", "api", 2), ("web/view.js", "from_import", "react", "React", "", 1), ("web/view.js", "from_import", "react", "useState", "", 1),
            ("web/view.js", "require", "fs", "fs", "", 3),
        ],
    ),
    "planted_warnings": (
        "path, kind, name, line, other_line, severity",
        [
            ("app/calls.py", "duplicate_function", "helper", 44, 38, "warning"), ("app/calls.py", "global_override", "LIMIT", 15, 5, "warning"),
        ],
    ),
    "planted_import_usage": (
        "path, caller, module, name, line",
        [
            ("app/calls.py", "Child.run", "os", "os", 18), ("app/calls.py", "main", "util", "Box", 34), ("app/calls.py", "main", "util", "util", 28),
        ],
    ),
    "planted_variables": (
        "path, fact, name, class_name, line, type",
        [
            ("app/calls.py", "class_variable", "kind", "Base", 9, "str"), ("app/calls.py", "global_variable", "LIMIT", "", 5, "int"),
            ("app/calls.py", "instance_variable", "n", "Child", 14, "unknown"), ("app/calls.py", "local_variable", "c", "", 27, "unknown"),
            ("app/calls.py", "local_variable", "LIMIT", "", 15, "unknown"), ("app/calls.py", "local_variable", "LIMIT", "", 40, "unknown"),
        ],
    ),
    "planted_calls": (
        "path, fact, caller, class_name, name, line",
        [
            ("app/calls.py", "class_instantiation", "main", "Child", "Child", 27), ("app/calls.py", "function_call", "Child.run", "", "fetch", 19),
            ("app/calls.py", "function_call", "Child.run", "", "os.path.join", 18), ("app/calls.py", "function_call", "Child.step", "", "open", 22),
            ("app/calls.py", "function_call", "helper", "", "unknown", 41), ("app/calls.py", "function_call", "main", "", "Box", 34), ("app/calls.py", "function_call", "main", "", "helper", 31),
            ("app/calls.py", "function_call", "main", "", "range", 29), ("app/calls.py", "function_call", "main", "", "util.load_it", 28),
            ("app/calls.py", "method_call", "Child.run", "Child", "step", 18), ("src/Shop.java", "class_instantiation", "Shop.run", "Cart", "Cart", 6),
            ("src/Shop.java", "function_call", "Shop.price", "", "max", 9), ("src/Shop.java", "function_call", "Shop.run", "", "Cart", 6),
            ("src/Shop.java", "function_call", "Shop.run", "", "price", 7), ("src/Shop.java", "method_call", "Shop.run", "c", "add", 7),
        ],
    ),
    "planted_flow": (
        "path, caller, kind, line, about",
        [
            ("app/calls.py", "Child.run", "return", 19, ""), ("app/calls.py", "Child.step", "return", 23, ""), ("app/calls.py", "Child.step", "with", 22, ""),
            ("app/calls.py", "helper", "return", 41, ""), ("app/calls.py", "helper", "return", 45, ""), ("app/calls.py", "main", "if", 30, "i"), ("app/calls.py", "main", "for", 29, "i"),
            ("app/calls.py", "main", "continue", 33, ""), ("app/calls.py", "main", "return", 35, ""), ("app/util.py", "load_it", "try", 2, "ValueError,KeyError"),
            ("app/util.py", "load_it", "return", 3, ""),
        ],
    ),
    "planted_tables": (
        "table_name, name, type, line, is_primary_key, is_foreign_key, is_unique, is_not_null",
        [
            ("orders", "id", "INT", 7, False, False, False, False), ("orders", "shop_id", "INT", 9, False, True, False, False), ("orders", "user_id", "INT", 8, False, True, False, False),
            ("users", "id", "INT", 3, True, False, False, False), ("users", "mail", "VARCHAR(80)", 4, False, False, True, True),
        ],
    ),
    "planted_relationships": (
        "from_table, from_column, to_table, to_column, type",
        [
            ("orders", "shop_id", "shops", "id", "foreign_key"), ("orders", "user_id", "users", "id", "reference"),
        ],
    ),
    "planted_graph": (
        "src, dst, relation, line",
        [
            ("class:app/calls.py:Child", "class:app/calls.py:Base", "inherits", 12), ("class:app/calls.py:Child", "function:app/calls.py:Child.__init__", "defines", 13),
            ("class:app/calls.py:Child", "function:app/calls.py:Child.run", "defines", 17), ("class:app/calls.py:Child", "function:app/calls.py:Child.step", "defines", 21),
            ("file:app/calls.py", "class:app/calls.py:Base", "defines", 8), ("file:app/calls.py", "class:app/calls.py:Child", "defines", 12),
            ("file:app/calls.py", "function:app/calls.py:helper", "defines", 44), ("file:app/calls.py", "function:app/calls.py:main", "defines", 26), ("file:app/calls.py", "module:os", "imports", 1),
            ("file:app/calls.py", "module:util", "imports", 2), ("file:app/calls.py", "module:util.Box", "imports", 3), ("file:app/calls.py", "module:util.load_it", "imports", 3),
            ("file:app/util.py", "class:app/util.py:Box", "defines", 8), ("file:app/util.py", "function:app/util.py:load_it", "defines", 1),
            ("function:app/calls.py:Child.run", "function:app/calls.py:Child.step", "calls", 18), ("function:app/calls.py:Child.run", "function:app/calls.py:os.path.join", "calls", 18),
            ("function:app/calls.py:Child.run", "function:app/util.py:load_it", "calls", 19), ("function:app/calls.py:Child.step", "function:app/calls.py:open", "calls", 22),
            ("function:app/calls.py:helper", "function:app/calls.py:unknown", "calls", 41), ("function:app/calls.py:main", "class:app/util.py:Box", "calls", 34),
            ("function:app/calls.py:main", "function:app/calls.py:helper", "calls", 31), ("function:app/calls.py:main", "function:app/calls.py:range", "calls", 29),
            ("function:app/calls.py:main", "function:app/util.py:load_it", "calls", 28),
        ],
    ),
    "planted_symbols": (
        "symbol, node_id",
        [("main", "function:app/calls.py:main"), ("app/calls.py:main", "function:app/calls.py:main"), ("calls.helper", "function:app/calls.py:helper"), ("run", "function:app/calls.py:Child.run")],
    ),
    "planted_answers": (
        "question, node_id",
        [
            ("who_calls load_it", "function:app/calls.py:Child.run"), ("who_calls load_it", "function:app/calls.py:main"), ("what_calls Child.run", "function:app/calls.py:Child.step"), ("what_calls Child.run", "function:app/calls.py:os.path.join"),
            ("what_calls Child.run", "function:app/util.py:load_it"), ("impact_of Child.step", "function:app/calls.py:Child.run"), ("dependencies_of calls.py", "module:os"), ("dependencies_of calls.py", "module:util"),
            ("dependencies_of calls.py", "module:util.Box"), ("dependencies_of calls.py", "module:util.load_it"),
        ],
    ),
    "planted_rollup": (
        "path, total_functions, async_functions, total_classes, total_methods, total_imports, total_global_variables, total_function_calls, total_method_calls, total_class_instantiations, total_warnings, total_tables",
        [
            ("app/broken.py", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), ("app/calls.py", 3, 0, 2, 3, 4, 1, 8, 1, 1, 2, 0), ("app/util.py", 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0),
            ("db/schema.sql", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2), ("src/Shop.java", 2, 0, 2, 2, 2, 0, 3, 1, 1, 0, 0), ("web/view.js", 3, 1, 1, 1, 4, 0, 0, 0, 0, 0, 0),
        ],
    ),
    "planted_flowchart": (
        "path, source, target, arm",
        [
            ("app/broken.py", "Code Structure", "Empty or Unsupported Code", ""), ("app/calls.py", "i", "Else Body", "False"), ("app/calls.py", "i", "If Body", "True"),
            ("app/calls.py", "Box", "Return with value", ""), ("app/calls.py", "Child", "util.load_it", ""), ("app/calls.py", "Continue", "Box", ""), ("app/calls.py", "Continue", "helper", ""),
            ("app/calls.py", "Continue", "range", ""), ("app/calls.py", "Else Body", "Continue", ""), ("app/calls.py", "If Body", "Continue", ""),
            ("app/calls.py", "Loop Body", "for i in range()", "Loop back"), ("app/calls.py", "Return with value", "End", ""), ("app/calls.py", "Start: main", "Child", ""),
            ("app/calls.py", "for i in range()", "Continue", "No items"), ("app/calls.py", "for i in range()", "Loop Body", "Has items"), ("app/calls.py", "helper", "Continue", ""),
            ("app/calls.py", "range", "i", ""), ("app/calls.py", "util.load_it", "for i in range()", ""), ("app/util.py", "Try", "Continue", "Success"),
            ("app/util.py", "Try", "Except KeyError", "KeyError"), ("app/util.py", "Try", "Except ValueError", "ValueError"), ("app/util.py", "Continue", "Return with value", ""),
            ("app/util.py", "Except KeyError", "Continue", ""), ("app/util.py", "Except ValueError", "Continue", ""), ("app/util.py", "Return with value", "End", ""),
            ("app/util.py", "Start: load_it", "Try", ""), ("db/schema.sql", "orders (3 columns)", "users (2 columns)", "user_id → id"), ("src/Shop.java", "Start: Shop.run", "End", ""),
            ("web/view.js", "Render JSX: Component UI", "End: View (Component Rendered)", ""), ("web/view.js", "Start: View (React Component) ({ x })", "Render JSX: Component UI", ""),
        ],
    ),
    "planted_chunks": (
        "path, chunker, n_lines, last_line, within_limit",
        [
            ("app/broken.py", "fallback_sentences", 1, 1, True), ("app/calls.py", "code_splitter", 45, 45, True), ("app/util.py", "code_splitter", 9, 9, True),
            ("db/schema.sql", "fallback_lines", 8, 8, True), ("src/Shop.java", "code_splitter", 11, 11, True), ("web/view.js", "code_splitter", 12, 12, True),
        ],
    ),
}


def _values(columns: str, rows: list[tuple]) -> str:
    sql = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) AS t({columns})"


ORACLES = {name: _values(*expected) for name, expected in EXPECTED.items()}
