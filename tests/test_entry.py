import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_llm_subpackage():
    import ast
    from pathlib import Path

    for file in Path("repoloom").rglob("*.py"):
        if "llm" in file.parts:
            continue
        for node in ast.walk(ast.parse(file.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("repoloom.llm" in n for n in names), file
