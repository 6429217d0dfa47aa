from repoloom.parsers import braces, python, sql, universal


def of(rows, fact, *keys):
    return [tuple(r.get(k) for k in keys) for r in rows if r["fact"] == fact]


def test_python_flow_scopes_and_warnings():
    rows = python.facts("X = 1\ndef f(a):\n    X = 2\n    with open(a) as h, lock:\n        return h.read()\ndef f(b):\n    pass\nif __name__ == '__main__':\n    y = [1]\n")
    assert of(rows, "global_variable", "name", "type") == [("X", "int")]
    assert of(rows, "execution_variable", "name", "type") == [("y", "list")]
    assert of(rows, "warning", "kind", "line", "previous_line") == [("global_override", 3, None), ("duplicate_function", 6, 2)]
    flow = of(rows, "control_flow", "kind", "line", "call_name", "action_label")
    assert flow == [("with", 4, None, None), ("call", 4, "open", "Open file"), ("return", 5, None, None), ("call", 5, "h.read", "Read data")]
    items = next(r["items"] for r in rows if r.get("kind") == "with")
    assert items == [{"var": "h", "context": "open", "label": "Enter open"}, {"var": None, "context": "lock", "label": "Enter lock"}]


def test_python_nested_async_and_instantiation_order():
    rows = python.facts("def outer():\n    def inner():\n        pass\nasync def fetch():\n    return C()\nclass C:\n    pass\ndef late():\n    return C()\n")
    assert of(rows, "function", "name", "is_nested", "is_async") == [("outer", False, False), ("inner", True, False), ("fetch", False, True), ("late", False, False)]
    assert of(rows, "function_call", "name") == [("C",)] and of(rows, "class_instantiation", "name") == [("C",)]


def test_java():
    code = "import java.util.List;\nimport static a.B.c;\npublic class Calls extends Base implements X {\n  // helper()\n  public int mainFlow(int a, List<String> b) {\n    String s = \"x()\";\n    return helper(a) + obj.run(new Thing(1));\n  }\n  int helper(int a) { return a; }\n}\n"
    rows = braces.java(code)
    assert ("Calls.mainFlow", "helper", 7) in of(rows, "function_call", "caller", "name", "line")
    assert of(rows, "class", "name", "bases") == [("Calls", ["Base", "X"])]
    assert of(rows, "method_call", "class_name", "name") == [("obj", "run")]
    assert ("Calls.mainFlow", "Thing") in of(rows, "class_instantiation", "caller", "name")
    assert of(rows, "import", "module", "is_static") == [("java.util.List", False), ("a.B.c", True)]
    assert not any(r.get("name") == "x" for r in rows)


def test_javascript():
    code = "import React, { useState as s } from 'react';\nimport './App.css';\nconst util = require('./util');\nfunction calculateSum(a, b) { return a + b; }\nconst formatDate = (d) => d.x;\nfunction App() { return <div/>; }\nconst Button = ({ label }) => <button>{label}</button>;\nclass Box extends Base {\n  async open(x) { return x; }\n}\n"
    rows = braces.javascript(code)
    assert of(rows, "function", "name", "is_react_component") == [("calculateSum", False), ("App", True), ("formatDate", False), ("Button", True)]
    assert of(rows, "method", "qualified", "is_async") == [("Box.open", True)]
    assert set(of(rows, "import", "module")) == {("react",), ("./App.css",), ("./util",)}
    assert not of(rows, "function_call", "name")


def test_sql_owner_of_foreign_keys():
    code = "CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(20) NOT NULL);\n-- CREATE TABLE no (x INT)\nCREATE TABLE orders (id INT, user_id INT, FOREIGN KEY (user_id) REFERENCES users(id));\nCREATE TABLE reviews (id INT, user_id INT, price DECIMAL(10,2), FOREIGN KEY (user_id) REFERENCES users(id), p INT REFERENCES orders(id));\nSELECT 1;"
    rows = sql.facts(code)
    assert of(rows, "sql_table", "name", "line") == [("users", 1), ("orders", 3), ("reviews", 4)]
    assert of(rows, "sql_relationship", "from_table", "from_column", "to_table") == [("orders", "user_id", "users"), ("reviews", "user_id", "users"), ("reviews", "p", "orders")]
    assert ("price", "DECIMAL(10,2)") in of(rows, "sql_column", "name", "type")
    assert ("user_id", True) in of(rows, "sql_column", "name", "is_foreign_key")
    assert sql.facts("SELECT a FROM b") == []


def test_universal_and_binary():
    rows = universal.facts('package main\nimport "fmt"\nfunc main() {\n}\nfunc helper(a int) int {\n}\n', "go")
    assert of(rows, "function", "name") == [("main",), ("helper",)] and of(rows, "import", "module") == [("fmt",)]
    assert of(universal.facts("@app.route('/x')\ndef y(): pass\n", "other"), "endpoint", "name", "kind") == [("/x", "flask")]
    assert universal.is_binary(b"\x00he") and not universal.is_binary(b"") and not universal.is_binary(b"package main")
