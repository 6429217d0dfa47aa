import math

import pytest

from repoloom.operators import evaluation
from repoloom.parsers import splitting as s

PY = "import os\n\n\ndef a():\n    return 1\n\n\nclass B:\n" + "".join(f"    def m{i}(self):\n        x = {i}\n        return x\n\n" for i in range(30))


def tiles(pieces, n):
    return [line for a, b, *_ in pieces for line in range(a, b + 1)] == list(range(1, n + 1))


def test_code_units_tile_and_stay_below_the_limit():
    pieces = s.chunk(PY, "python", max_chars=200)
    assert tiles(pieces, len(PY.splitlines())) and all(len(p[2]) <= 200 for p in pieces) and {p[3] for p in pieces} == {"code_splitter"}
    js = "".join(f"function f{i}(x) {{\n  return x;\n}}\n" for i in range(20))
    assert tiles(s.chunk(js, "javascript", max_chars=100), 60)


def test_cascade():
    assert {p[3] for p in s.chunk("def (:\nx\n" * 30, "python", 4, 1, 500)} == {"fallback_lines"}
    assert {p[3] for p in s.chunk("One sentence. Another one. " * 50, "text", max_chars=100)} == {"fallback_sentences"}
    assert s.chunk("", "python") == [] and s.chunk(" \n", "python") == []


def test_table(spark):
    df = spark.createDataFrame([("p", "a.py", "python", PY), ("p", "b", None, None)], "project_id string, path string, language string, content string")
    assert {r.path for r in s.code_chunks(df).collect()} == {"a.py"}


def test_resume_isolation_and_means(spark):
    items = spark.createDataFrame([("g1", "c", "q1", "e"), ("g2", "c", "bad", "e"), ("g3", "c", "q3", "e")], "id string, category string, question string, expected_answer string")
    done = spark.createDataFrame([("vector", "g3")], "mode string, id string")

    def runner(question, mode):
        if question == "bad":
            raise RuntimeError("no answer")
        return f"{mode}:{question}", ["a.py"]

    records = evaluation.run(items, done, "vector", runner, lambda q, a, e: {"f": 1.0}).cache()
    assert {r.id: (r.answer, r.error) for r in records.collect()} == {"g1": ("vector:q1", None), "g2": (None, "no answer")}
    row = evaluation.comparison(records, ["f", "none"]).first()
    assert row.f == 1.0 and math.isnan(row.none)
    with pytest.raises(ValueError):
        evaluation.run(items, done, "other", runner)


def test_answers_and_scores_that_take_too_long(spark):
    import time

    items = spark.createDataFrame([("g1", "c", "slow", "e"), ("g2", "c", "fast", "e")], "id string, category string, question string, expected_answer string")
    done = spark.createDataFrame([], "mode string, id string")

    def runner(question, mode):
        time.sleep(5 if question == "slow" else 0)
        return "answer", []

    def scorer(question, answer, expected):
        time.sleep(5)
        return {}

    rows = {r.id: r for r in evaluation.run(items, done, "graph", runner, scorer, 0.3, 0.3).collect()}
    assert rows["g1"].answer is None and "the answer took more than" in rows["g1"].error
    assert rows["g2"].answer == "answer" and "scoring took more than" in rows["g2"].error
