import json

import pytest
from pyspark.sql import functions as F

from repoloom.api import ChunkConfig, Engine
from repoloom.operators.retrieval import Filters
from repoloom.sources import project as source
from repoloom.streaming import incremental
from tests.samples import PYTHON


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in PYTHON.items():
        (root / name).write_text(text)
    for name, text in {"pkg/__init__.py": "", "_private.py": "x = 1\n", "venv/lib/bad.py": "x", "node_modules/p/b.js": "x", "generated/g.py": "x = 1", "ignored.py": "x", "notes.txt": "hello", ".gitignore": "generated/\nignored.py\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "data.bin.py").write_bytes(b"\x00\x01")
    return root


def test_scan_keeps_underscore_names_and_counts(spark, tree):
    listed = {r.path: r.reason for r in source.enumerate_files(spark, tree).collect()}
    assert listed["pkg/__init__.py"] == "indexed" and listed["_private.py"] == "indexed"
    assert listed["generated/g.py"] == "ignored" and listed["ignored.py"] == "ignored" and listed["notes.txt"] == "extension"
    stats = source.scan_stats(source.enumerate_files(spark, tree)).first()
    assert stats.dirs_skipped == 2 and stats.files_skipped_ignore == 2
    scanned = {r.path: r for r in source.scan(spark, tree).collect()}
    assert ".gitignore" in scanned and "data.bin.py" not in scanned and scanned["calls.py"].language == "python"
    with pytest.raises(ValueError):
        source.resolve_folder(str(tree / "missing"))


def test_engine_end_to_end(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    result = engine.index(tree, ChunkConfig(8, 2, 500))
    project = result["project_id"]
    assert result["ready"] and [p["phase"] for p in result["phases"]] == ["scan", "chunks", "graph"]
    assert engine.search(project, "save_result", 3).first().file_path == "mixed.py"
    assert engine.search(project, "save_result", 3, Filters(path_prefix="calls")).count() == 1
    assert engine.search("unknown", "x", 3).count() == 0
    assert [r.path for r in engine.list_files(project, "inst*.py").collect()] == ["instance_usage.py"]
    assert [(r.path, r.line_no) for r in engine.grep(project, r"def helper").collect()] == [("calls.py", 1)]
    assert engine.read_file(project, "calls.py", 1, 2) == "   1| def helper(x):\n   2|     return x * 2"
    assert {r.node_id for r in engine.who_calls(project, "helper").collect()} == {"function:calls.py:main"}
    assert json.loads(engine.tool_json("grep", project, pattern="(")).get("error")
    assert engine.structure(project, "calculator.py")["classs"][0]["name"] == "Calculator"
    assert "```mermaid" in Engine.draw("def f(): pass", "architecture") and "error" in Engine.draw("", "nothing")
    engine.vectors.delete(project)
    assert not engine.vectors.has(project)


def test_facts_are_stored_and_tools_answer(spark, tree, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    project = engine.index(tree)["project_id"]
    assert engine.parsed.has(project)
    assert {r.path for r in engine.find_symbol(project, "helper").collect()} == {"calls.py"}
    rows = json.loads(engine.tool_json("list_files", project, max_rows=2))
    assert len(rows["rows"]) == 2 and rows["rows_in_all"] > 2
    assert "```mermaid" in json.loads(engine.tool_json("generate_diagram", code="def f(): pass", kind="sequence"))
    assert "svg" in json.loads(engine.tool_json("generate_svg_flowchart", code="def f():\n    return 1\n"))
    assert "error" in json.loads(engine.tool_json("generate_diagram", code="x = 1", kind="flow")) and "error" in json.loads(engine.tool_json("generate_readme", code=" "))
    listed = [r.path for r in source.tree(spark, tree, "**/*.py").collect()]
    assert "generated/g.py" in listed and not any(p.startswith("venv/") for p in listed) and listed == sorted(listed)


def test_session_index(spark):
    from repoloom.api import SessionIndex
    from repoloom.operators import embedding

    for provider in (None, embedding.hashed, lambda texts: [[1.0, 2.0]] if texts == ["where is the hen"] else [[0.0]] * len(texts)):
        index = SessionIndex(spark, provider, chunk_lines=2)
        assert index.retrieve("x").count() == 0
        assert index.build([{"path": None, "content": "red fox\nblue\ngreen hen\n"}, "no dictionary", {"path": "b", "content": None}, {"path": "c", "content": "lazy dog"}]) == 3
        question = "green hen" if provider is embedding.hashed else "where is the hen"
        assert index.retrieve(question, 1).first().content == "green hen"
        assert index.retrieve(" ").count() == 0 and index.retrieve("hen", 0).count() == 0
        assert index.build(None) == 0 and index.retrieve("hen").count() == 0


def test_incremental_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"project_id":"p","path":"a.py","language":"python","content":"1","scanned_at":"2025-01-01T00:00:00Z"}\n{"project_id":"p","path":"a.py","language":"python","content":"2","scanned_at":"2025-01-02T00:00:00Z"}\n')
    seen = []
    incremental.run(incremental.file_records(spark, str(folder)), str(tmp_path / "cp"), lambda df, n: seen.extend(df.select("path", "content").collect())).awaitTermination()
    assert [(r.path, r.content) for r in seen] == [("a.py", "2")]


def test_event_windows_by_batch(spark):
    df = spark.sql("select timestamp'2025-01-01 00:10:00' ts, 'a' event_type union all select timestamp'2025-01-01 00:50:00', 'a'")
    assert incremental.event_counts(df).select(F.sum("n")).first()[0] == 2
