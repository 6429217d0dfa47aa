import numpy as np

from repoloom.llm import provenance as v

CODE = "import os\n\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n"
MIN = "!function(){" + "".join(f'function a{i}(b,c){{return c?c.x({i}):null}}var d{i}=[1,2,3];' for i in range(40)) + "}();"
SCHEMA = "file_id bigint, project_id string, path string, lines_of_code int, language string, content string"


def label(spark, *files):
    rows = [(i, "p", path, None, None, content) for i, (path, content) in enumerate(files)]
    return {r.file_id: r.label for r in v.labels(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_labels(spark):
    files = [
        ("src/a.py", CODE), ("src/b.py", "# Code generated by x. DO NOT EDIT.\n" + CODE), ("src/c.py", 'HEADER = "# Code generated by {tool}. DO NOT EDIT."\n' + CODE), ("src/d.js", MIN), ("dist/e.min.js", MIN),
        ("node_modules/pkg/f.js", "module.exports = 1;\n"), ("src/g.py", "# This module generates reports for the vendor screen.\n" + CODE), ("vendor_portal/h.py", CODE), ("lib/i-1.2.3.py", CODE), ("src/j.py", "DATA = [" + ", ".join(map(str, range(500))) + "]\n"),
        ("generated/sub/k.py", CODE), ("src/l.py", CODE + "\n# Generated from l.idl at build time. Manual edits are overwritten.\n"), ("src/m.py", None), ("src/n.py", ""), ("src/generators/o.py", CODE),
    ]
    got = label(spark, *files)
    want = ["handwritten", "generated", "handwritten", "minified", "minified", "vendored", "handwritten", "handwritten", "vendored", "blob", "generated", "generated", None, None, "handwritten"]
    assert [got.get(i) for i in range(len(files))] == want


def test_null_paths_repeats_long_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, None, None, CODE), (1, None, None, None, None, CODE), (2, "p", "x/" * 30 + "a.py", 1, "x", CODE * 2000)], SCHEMA).selectExpr("*", "'clash' as label")
    assert sorted((r.file_id, r.label) for r in v.labels(df.where("project_id is not null")).collect()) == [(2, "handwritten")]
    assert {r.file_id for r in v.labels(df.fillna("", ["project_id", "path"])).collect()} == {1, 2}
    assert v.found(df.limit(0)).count() == 0


def brute(tree, evidence, names):
    """Exact marginals of a small tree by enumeration; ``tree``: child -> parent."""
    import itertools

    nodes = [*tree, ""]
    files = set(evidence)
    prior = np.log([v.PRIOR_HAND if k == 0 else (1 - v.PRIOR_HAND) / 4 for k in range(5)])
    scores = {n: np.full(5, -np.inf) for n in files}
    for combo in itertools.product(range(5), repeat=len(nodes)):
        at = dict(zip(nodes, combo, strict=True))
        s = prior[at[""]] + sum(evidence[f][at[f]] for f in files)
        for child, parent in tree.items():
            s += (v._FILE_TABLE if child in files else v._DIR_TABLE)[at[parent]][at[child]]
        for n in files:
            scores[n][at[n]] = np.logaddexp(scores[n][at[n]], s)
    return {n: int(x.argmax()) for n, x in scores.items()}


def test_propagation_is_exact_on_a_tree(spark):
    files = [("d/a.py", CODE), ("d/b.py", "# vendored from x\n" + CODE), ("c.py", CODE)]
    evidence = {p: v.evidence(p, c) for p, c in files}
    want = brute({"d/a.py": "d", "d/b.py": "d", "c.py": "", "d": ""}, evidence, {})
    got = label(spark, *files)
    assert {p: v.LABELS.index(got[i]) for i, (p, _) in enumerate(files)} == want


def test_levels_and_subtrees_and_hot_directories_give_the_same(spark):
    bodies = [CODE, "# vendored from x\n" + CODE, MIN, "", "# Code generated by x. DO NOT EDIT.\n" + CODE]
    places = ["", "a/", "a/b/", "a/b/c/d/", "node_modules/x/y/", "/abs/q/", "a//z/", "gen/k/l/m/"]
    rows = [(None if k % 11 == 0 else k, "p" if k % 3 else None, f"{places[k % 8]}f{k}.js", k, "JSON", bodies[k % 5]) for k in range(120)]
    df = spark.createDataFrame(rows, "file_id bigint, project_id string, path string, lines_of_code int, language string, content string")
    sets = []
    for tree_rows, hot in ((1000, 1000), (0, 1000), (12, 1000), (30, 3), (1000, 2)):
        got = v.labels(df, tree_rows, hot).collect()
        sets.append(sorted((str(r.file_id), r.label, round(r.confidence, 9)) for r in got))
    assert len(sets[0]) == 96 and all(x == sets[0] for x in sets)


def test_the_whole_header_and_the_whole_body_count():
    generated, minified = v.LABELS.index("generated"), v.LABELS.index("minified")
    header = "/*\n" + "Terms of use apply to this text.\n" * 120 + "Code generated by a tool.\n*/\n"
    assert v.evidence("src/a.js", header + "f();\n")[generated] > 0
    preamble = "registerModule(firstDependency,secondDependency);" * 450
    bundle = "!function(e,t){var n=e(t);return n?t(n):e(1)};" * 900
    assert len(preamble) > 20_000 and v.evidence("src/b.js", preamble + bundle)[minified] > 0 and v.evidence("src/b.js", preamble)[minified] == 0
