import pytest

from repoloom.operators import graph
from repoloom.parsers.facts import parse_files
from tests.samples import CALLS, PYTHON


def build(spark, files, language="python"):
    rows = [("p", path, language, text) for path, text in files.items()]
    nodes, edges = graph.build(parse_files(spark.createDataFrame(rows, "project_id string, path string, language string, content string")))
    return nodes.cache(), edges.cache()


@pytest.fixture(scope="module")
def sample(spark):
    return build(spark, PYTHON)


def ids(df):
    return {r.node_id for r in df.select("node_id").collect()}


def test_sample_counts_and_calls(sample):
    nodes, edges = sample
    assert (nodes.count(), edges.count()) == (39, 37)
    assert {(r.src, r.dst, r.line) for r in edges.where("relation = 'calls'").collect()} == CALLS
    assert nodes.where("kind is null").count() == 9


def test_sample_queries(sample):
    nodes, edges = sample
    assert ids(graph.who_calls(nodes, edges, "helper")) == {"function:calls.py:main"}
    assert ids(graph.what_calls(nodes, edges, "main")) == {"function:calls.py:helper"}
    assert ids(graph.impact_of(nodes, edges, "helper")) == {"function:calls.py:main"}
    assert ids(graph.who_calls(nodes, edges, "Calculator")) == {"function:instance_usage.py:use_via_instance"}
    assert ids(graph.dependencies_of(nodes, edges, "mixed.py")) == {"module:os", "module:pathlib.Path"}
    assert ids(graph.what_calls(nodes, edges, "use_via_instance")) == {"class:calculator.py:Calculator", "function:instance_usage.py:calc.add"}
    assert ids(graph.who_calls(nodes, edges, "Calculator.add")) == set()
    inherits = {r.src for r in graph.relation(edges, "inherits").where("dst = 'class:inheritance.py:Animal'").collect()}
    assert inherits == {"class:inheritance.py:Dog", "class:inheritance.py:Cat"}
    defined = {r.dst for r in graph.relation(edges, "defines").where("src = 'class:calculator.py:Calculator'").collect()}
    assert {d.rsplit(".", 1)[1] for d in defined} == {"__init__", "add", "subtract", "reset"}


def test_chain_cycle_loop_and_repeat(spark):
    nodes, edges = build(spark, {"chain.py": "def leaf():\n    pass\ndef middle():\n    leaf()\ndef top():\n    middle()\n"})
    assert ids(graph.impact_of(nodes, edges, "leaf")) == {"function:chain.py:middle", "function:chain.py:top"}
    nodes, edges = build(spark, {"cycle.py": "def a():\n    b()\ndef b():\n    c()\ndef c():\n    a()\n", "own.py": "def f():\n    f()\n    g()\n\n    g()\ndef g():\n    pass\n"})
    assert ids(graph.impact_of(nodes, edges, "a")) == {"function:cycle.py:b", "function:cycle.py:c"}
    pairs = {(r.src, r.dst): r.line for r in edges.where("relation = 'calls'").collect()}
    assert ("function:own.py:f", "function:own.py:f") not in pairs
    assert pairs["function:own.py:f", "function:own.py:g"] == 5


def test_self_method_edge(spark):
    nodes, edges = build(spark, {"s.py": "class Service:\n    def run(self):\n        self.process()\n    def process(self):\n        pass\n"})
    assert ("function:s.py:Service.run", "function:s.py:Service.process") in {(r.src, r.dst) for r in edges.where("relation = 'calls'").collect()}


def test_empty_and_broken_files(spark):
    nodes, edges = build(spark, {"x.py": "def (:\n"})
    assert nodes.count() == 0 and edges.count() == 0
    assert ids(graph.impact_of(nodes, edges, "x")) == set()


def test_seeds_that_reach_each_other_and_hubs(spark):
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(3):
        nodes = [str(n) for n in range(14)]
        arrows = sorted({(a, b) for a, b in itertools.product(nodes, nodes) if a != b and rng.random() < 0.09})
        seeds = rng.sample(nodes, 4)
        reach = {n: {b for a, b in arrows if a == n} for n in nodes}
        for _ in nodes:
            reach = {n: r | set().union(*(reach[x] for x in r)) for n, r in reach.items()}
        want = {n for n in nodes if any(s in reach[n] and s != n for s in seeds)}
        edges = spark.createDataFrame(arrows or [("x", "y")], "src string, dst string")
        got = [r.node_id for r in graph.reach_backwards(edges, spark.createDataFrame([(s,) for s in seeds], "node_id string")).collect()]
        assert sorted(got) == sorted(want)
