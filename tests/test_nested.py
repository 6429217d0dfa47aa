import json

from pyspark.sql import functions as F

from repoloom.operators import nested
from repoloom.operators.nested import Edge, SchemaGraph


def rows(spark, *details):
    df = spark.createDataFrame([(i, d, "x") for i, d in enumerate(details)], "detail_id bigint, detail string, kind string")
    return {tuple(r) for r in nested.found(df).collect()}


def test_tables_of_the_schema():
    assert nested.FILE_DETAIL.tables() == ["file_detail", "class", "method", "parameter", "class_variable", "instance_variable", "function", "method_call", "control_flow", "with_item", "exception"]


def test_shared_inlining_of_singletons_and_recursion():
    g = SchemaGraph("r", (Edge("r", "owner", "person", many=False), Edge("r", "kids", "node"), Edge("node", "kids", "node")), {"r": {"a": "int"}, "person": {"name": "string"}, "node": {"n": "int"}})
    assert g.tables() == ["r", "node"] and g.recursive() == {"node"}
    assert g.inlined("r") == {"a": ("$.a", "int"), "owner_name": ("$.owner.name", "string")}


def test_recursive_elements_are_expanded_to_the_end(spark):
    g = SchemaGraph("r", (Edge("r", "kids", "node"), Edge("node", "kids", "node")), {"node": {"n": "int"}})
    df = spark.createDataFrame([(1, '{"kids":[{"n":1,"kids":[{"n":2,"kids":{"n":3}}]},{"n":4}]}')], "detail_id bigint, detail string")
    got = {tuple(r) for r in nested.found(df, graph=g).collect()}
    assert got == {(1, "node", "$", 0), (1, "node", "$", 1), (1, "node", "$.kids[0]", 0), (1, "node", "$.kids[0].kids[0]", 0)}


def test_dirty_shapes(spark):
    got = rows(
        spark,
        None, "", "{", "null", "[]", '"x"', "{}",
        '{"v":2,"payload":{"file_detail":{"classes":[null,{"name":"A","methods":{"name":"m","parameters":["a",{"name":"b"},null]}}]}}}',
        '{"file_detail":{"functions":"[{\\"name\\":\\"f\\"}]","control_flow":{"type":"try","exceptions":["E"],"items":"[]"}}}',
        '{"classes":null,"functions":7,"method_calls":["x",{}]}',
    )
    assert got == {
        (7, "class", "$", 1), (7, "method", "$.classes[1]", 0), (7, "parameter", "$.classes[1].methods[0]", 0), (7, "parameter", "$.classes[1].methods[0]", 1),
        (8, "function", "$", 0), (8, "control_flow", "$", 0), (8, "exception", "$.control_flow[0]", 0), (9, "method_call", "$", 1),
    }


def test_repeated_rows_and_tables(spark):
    one = '{"functions":[{"name":"f","line":"3","parameters":["a"]}]}'
    df = spark.createDataFrame([(1, one), (1, one)], "detail_id bigint, detail string")
    assert nested.found(df).count() == 2
    f = nested.flat_table(df, "function").first()
    p = nested.flat_table(df, "parameter").first()
    assert (f["name"], f.line, f.path) == ("f", 3, "$.functions[0]") and (p["name"], p.parent_path) == ("a", f.path)
    assert nested.flat_table(df.limit(0), "class").count() == 0


def unresolved(tables, graph, id_col="detail_id"):
    """Rows whose parent_path is no row of a table that may hold their parent."""
    missing = []
    for kind, df in tables.items():
        parents = {(r[id_col], r.path) for e in graph.edges if e.child == kind for t in [nearest(graph, e.parent)] for r in tables[t].collect()}
        missing += [r for r in df.collect() if kind != graph.root and (r[id_col], r.parent_path) not in parents]
    return missing


def nearest(graph, element):
    while element not in graph.tables():
        element = next(e.parent for e in graph.edges if e.child == element)
    return element


def test_an_element_under_two_labels_of_one_parent(spark):
    g = SchemaGraph("r", (Edge("r", "books", "book"), Edge("book", "owner", "person"), Edge("book", "authors", "person"), Edge("person", "emails", "email")), {"person": {"name": "string"}, "email": {"at": "string"}})
    df = spark.createDataFrame([(1, '{"books":[{"owner":{"name":"o","emails":[{"at":"1"}]},"authors":[{"name":"a","emails":[{"at":"2"}]}]}]}')], "detail_id bigint, detail string")
    tables = nested.flat_tables(df, graph=g)
    assert {(r.path, r["name"]) for r in tables["person"].collect()} == {("$.books[0].owner[0]", "o"), ("$.books[0].authors[0]", "a")}
    assert tables["email"].count() == 2 and not unresolved(tables, g)


def test_a_recursive_element_under_several_labels(spark):
    g = SchemaGraph("r", tuple(Edge(a, b, "node") for a, b in (("r", "body"), ("node", "body"), ("node", "then"), ("node", "else"))), {"node": {"n": "int"}})
    df = spark.createDataFrame([(1, '{"body":[{"n":1,"then":[{"n":2},{"n":3,"else":{"n":5}}],"else":[{"n":4}]}]}')], "detail_id bigint, detail string")
    tables = nested.flat_tables(df, graph=g)
    assert {(r.n, r.path) for r in tables["node"].collect()} == {(1, "$.body[0]"), (2, "$.body[0].then[0]"), (3, "$.body[0].then[1]"), (4, "$.body[0].else[0]"), (5, "$.body[0].then[1].else[0]")}
    parents = {r.path for r in tables["node"].collect()} | {r.path for r in tables["r"].collect()}
    assert {r.parent_path for r in tables["node"].collect()} <= parents


def test_a_table_below_an_inlined_element(spark):
    g = SchemaGraph("r", (Edge("r", "owner", "person", many=False), Edge("person", "pets", "pet"), Edge("r", "pets", "pet")), {"pet": {"name": "string"}, "person": {"name": "string"}})
    df = spark.createDataFrame([(1, '{"owner":{"name":"o","pets":[{"name":"x"}]},"pets":[{"name":"y"}]}')], "detail_id bigint, detail string")
    tables = nested.flat_tables(df, graph=g)
    assert {(r.parent_path, r.path, r["name"]) for r in tables["pet"].collect()} == {("$", "$.owner.pets[0]", "x"), ("$", "$.pets[0]", "y")}
    assert tables["r"].first().owner_name == "o"


def test_wrapped_anywhere(spark):
    record = '{"classes":[{"name":"A"}]}'
    deep = record
    for i in range(12):
        deep = '{"k%d":%s}' % (i, deep) if i % 2 else '[%s, 3]' % deep
    text = json.dumps({"path": "of the envelope", "event": {"body": record}})
    assert rows(spark, deep, text) == {(0, "class", "$", 0), (1, "class", "$", 0)}


def test_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, '{"classes":[{"name":"A"}]}', 1), (None, '{"classes":[{"name":"B"}]}', 2)], "path bigint, detail string, label int")
    got = nested.flat_table(df.withColumnRenamed("path", "name"), "class", id_col="name").select("own_name").collect()
    assert sorted(r.own_name for r in got) == ["A", "B"]


def test_graph_from_the_records(spark):
    df = spark.createDataFrame([('{"a":1,"kids":[{"n":1.5,"kids":[{"n":2}]}],"owner":{"x y":"t","tags":["u"]}}',), ('{"a":2,"owner":null}',), ("{",), (None,)], "detail string")
    g = nested.infer_graph(df)
    assert g.tables() == ["record", "kids"] and g.recursive() == {"kids"}
    assert g.attributes == {"record": {"a": "bigint"}, "kids": {"n": "double"}, "owner": {"x y": "string", "tags": "string"}}
    r = nested.flat_table(df.withColumn("detail_id", F.lit(1)), "record", graph=g).orderBy("a").first()
    assert (r.a, r["owner_x y"]) == (1, "t")


def test_report_of_fields(spark):
    df = spark.createDataFrame([('{"file_detail":{"path":"p","extra":{"z":1},"classes":[{"name":"A","odd":true}]}}',)], "detail string")
    got = {(r.element, r.label, r["shape"], r.n, r.known) for r in nested.fields(df, graph=nested.FILE_DETAIL).collect()}
    assert got == {("file_detail", "path", "string", 1, True), ("file_detail", "extra", "object", 1, False), ("extra", "z", "int", 1, False), ("file_detail", "classes", "array of objects", 1, True), ("class", "name", "string", 1, True), ("class", "odd", "boolean", 1, False)}


def test_very_long_record(spark):
    big = '{"functions":[' + ",".join('{"name":"f%d","docstring":"%s"}' % (i, "d" * 500) for i in range(2000)) + "]}"
    assert len(rows(spark, big)) == 2000
