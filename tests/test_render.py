from repoloom.parsers.facts import parse_text
from repoloom.render import docs, flow, mermaid, svg
from repoloom.render.bundle import KINDS, render_files

CODE = "import os\nimport json\nLIMIT = 3\nclass Vehicle:\n    def drive(self):\n        return 1\nclass Car(Vehicle):\n    pass\ndef helper(x):\n    if x > 0:\n        return x\n    return 0\ndef main():\n    for i in range(3):\n        helper(i)\n    helper(1)\n    helper(2)\n    Vehicle()\nif __name__ == '__main__':\n    y = 1\n"
FACTS = parse_text("python", CODE)
DDL = parse_text("sql", "CREATE TABLE a (id INT PRIMARY KEY);\nCREATE TABLE b (id INT, a_id INT REFERENCES a(id));")


def test_diagrams():
    a = mermaid.architecture(FACTS)
    for part in ("```mermaid", "MODULE", "Imports", "Global Variables", "Execution Scope", "inherits", "Vehicle", "helper"):
        assert part in a
    s = mermaid.sequence(FACTS)
    assert "sequenceDiagram" in s and "loop" in s and "main" in s and "helper" in s and "new Vehicle()" in s
    d = mermaid.dependency(FACTS)
    assert "os" in d and "json" in d and "imports" in d and "CurrentModule" in d
    assert flow.chosen(FACTS)["name"] == "main"
    assert "flowchart TD" in mermaid.flowchart(FACTS) and "for i in range()" in mermaid.flowchart(FACTS)
    assert "method drive()" in mermaid.structure(FACTS)
    assert "inherits" in mermaid.code_architecture(FACTS)


def test_empty():
    assert "No code structure detected" in mermaid.sequence([])
    assert "No Imports Found" in mermaid.dependency([])
    assert "No functions found" in svg.flowchart([])
    d = docs.document([])
    assert d["docstrings"] == "" and "0 functions" in d["readme"] and "Total top-level functions: 0" in d["architecture"] and "No top-level functions were detected" in d["architecture"]


def test_docs_and_svg():
    d = docs.document(FACTS)
    assert "2 functions and 2 classes" in d["readme"] and "`Vehicle`" in d["readme"] and "**Methods**: 1" in d["readme"]
    assert "Args:" in d["docstrings"] and "x:" in d["docstrings"] and '"""' in d["docstrings"]
    assert "`drive`" in d["architecture"] and "### Functions" in d["architecture"]
    assert svg.flowchart(parse_text("python", "def f(a):\n    if a < 1:\n        return '<x>'\n")).count("&lt;") == 1


def test_source_with_docstrings_put_in():
    code = "import os\n\n\nclass A(B):\n    size = 1\n\n    @staticmethod\n    def is_ready(x,\n                 y):\n        # note\n        return x\n\n    def one(self): return 1\n\n\ndef load(path):\n    'Has one.'\n    return path\n"
    out = docs.documented(code, parse_text("python", code))
    compile(out, "x", "exec")
    assert out.count('"""') == 4 and "Inherits from B." in out and "size: int of the class." in out and "bool: True if the condition is met" in out
    assert [x for x in out.splitlines() if x.strip() and x in code.splitlines()] == [x for x in code.splitlines() if x.strip()]
    again = docs.documented(out, parse_text("python", out))
    assert again == out and docs.documented("def (", []) == "def ("
    assert "## Functional Overview" in docs.architecture(FACTS) and "- **Calls**: range, helper, Vehicle" in docs.architecture(FACTS)


def test_sql():
    assert "erDiagram" in mermaid.structure(DDL) and "a_id" in mermaid.architecture(DDL) and "sequenceDiagram" in mermaid.sequence(DDL)
    chart = mermaid.flowchart(DDL)
    assert '["a (1 columns)"]' in chart and '["b (2 columns)"]' in chart and 'T1 -->|"a_id → id"| T0' in chart


def shape(code, function=None, language="python"):
    chart = flow.of_file(parse_text(language, code), language, function)
    return [(n.id, n.label) for n in chart.nodes], [(a.source, a.target, a.label) for a in chart.arrows]


def test_arms_of_branches_and_loops():
    nodes, arrows = shape("def f(a):\n    if a:\n        g()\n    else:\n        h()\n    while a:\n        a = 0\n")
    assert ("IF0", "True") in {(s, x) for s, _, x in arrows} and ("IF0", "FALSE0", "False") in arrows and ("TRUE0", "ENDIF0", "") in arrows and ("FALSE0", "ENDIF0", "") in arrows
    assert ("BODY3", "LOOP3", "Loop back") in arrows and ("LOOP3", "ENDLOOP3", "False") in arrows and arrows[-1] == ("ENDLOOP3", "END", "")
    assert ("IF0", "ENDIF0", "False") in shape("def f(a):\n    if a:\n        pass\n")[1]


def test_try_with_and_the_first_return():
    nodes, arrows = shape("def f():\n    with open('x') as y:\n        pass\n    try:\n        pass\n    except (A, B):\n        pass\n    finally:\n        pass\n    return 1\n    if x:\n        pass\n")
    labels = [label for _, label in nodes]
    assert "Except A" in labels and "Except B" in labels and "Finally" in labels and "Return with value" in labels and not any(n.startswith("IF") for n, _ in nodes)
    assert nodes[-1] == ("END", "End") and arrows[-1][1] == "END"
    many = shape("def f():\n    try:\n        pass\n    except (A, B, C, D, E):\n        pass\n")[0]
    assert sum(n.startswith("EXCEPT") for n, _ in many) == 4 and ("EXCEPT0_MORE", "More exceptions") in many
    calls = shape("def f():\n" + "".join(f"    g{i}()\n" for i in range(6)))[0]
    assert calls[-2][1] == "... 2 more calls" and len(calls) == 7


def test_scripts_and_files_without_functions():
    jsx = "export const Panel = ({a, b, c, d}) => {\n  const [x, setX] = useState(0);\n  const onClick = () => setX(1);\n  return <div onClick={onClick}>{x}</div>;\n};\n"
    nodes, _ = shape(jsx, language="javascript")
    assert nodes[0][1].startswith("Start: Panel (React Component)") and "Render JSX: Component UI" in [x for _, x in nodes] and nodes[-1][1] == "End: Panel (Component Rendered)"
    assert [x for _, x in shape("function f(a) { return a }", language="javascript")[0]] == ["Start: f (a)", "Function Body: Execute Logic", "End: f"]
    structure = [x for _, x in shape("import os\nX = 1\nclass A:\n    def m(self):\n        y = 1\n")[0]]
    assert structure == ["Code Structure", "Classes (1)", "A", "Methods: 1", "Variables (2)", "Global: 1", "Local: 1", "Imports (1)", "os"]
    assert [x for _, x in shape("")[0]] == ["Code Structure", "Empty or Unsupported Code"]


def test_svg_has_every_node_and_arm():
    facts = parse_text("python", "def f(a):\n    if a:\n        pass\n    else:\n        pass\n    for i in a:\n        pass\n    return 1\n")
    chart = flow.of_file(facts)
    picture = svg.flowchart(facts)
    assert picture.count("<path d=") == len(chart.arrows) + 1 and picture.count("<rect") + picture.count("<polygon") == len(chart.nodes) and picture.count('class="arm"') == sum(bool(a.label) for a in chart.arrows)
    assert len({(n.row, n.column) for n in chart.nodes}) == len(chart.nodes)


def test_table(spark):
    df = spark.createDataFrame([("p", "a.py", "python", CODE), ("p", "b.py", "python", "def ("), ("p", "c.py", None, None)], "project_id string, path string, language string, content string")
    rows = render_files(df).collect()
    assert len(rows) == 3 * len(KINDS) and all(r.content is not None for r in rows)
