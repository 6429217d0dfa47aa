import math

import pytest
from pyspark.sql import functions as F

from repoloom.functions import language, paths, text
from repoloom.functions import text
from repoloom.operators import answers, chunking, embedding, graph, retrieval, rollup
from repoloom.sources import stores


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "def save_result(x):\n    pass"), (2, "load config from file\n" * 50), (3, None), (4, ""), (5, "   \n\t"), (6, "save save config")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_split_lines_is_splitlines(spark):
    samples = ["", "a", "a\n", "a\n\n", "\r\n\r", "a\x0bb\x0cc\x1cd\x85e f g", "x\r\ny"]
    df = spark.createDataFrame([(s,) for s in samples], "t string").select("t", text.split_lines("t").alias("ls"))
    for r in df.collect():
        assert r.ls == r.t.splitlines(), repr(r.t)


@pytest.mark.parametrize(("size", "overlap"), [(4, 1), (8, 2), (40, 15), (2, 5)])
def test_overlap_tiles_and_matches_the_rule(spark, docs, size, overlap):
    got = chunking.overlapping_chunks(docs, size, overlap, None).where("doc_id = 2").orderBy("chunk_index").collect()
    want, start, n, step = [], 0, 50, max(1, size - overlap)
    while True:
        end = min(n, start + size)
        want.append((start + 1, end))
        if end == n:
            break
        start += step
    assert [(r.start_line, r.end_line) for r in got] == want
    assert chunking.tiled(docs.where("doc_id = 2"), chunking.overlapping_chunks(docs, size, overlap, None))


def test_char_cap_leaves_gaps_that_are_reported(docs):
    chunks = chunking.overlapping_chunks(docs.where("doc_id = 2"), 10, 0, 30)
    assert not chunking.tiled(docs.where("doc_id = 2"), chunks)
    assert all(len(r.content) <= 30 for r in chunks.collect())
    assert chunking.fixed_chunks(docs, 0).where("doc_id in (3, 4, 5)").count() == 0


def test_keyword_and_bm25_with_nulls(docs):
    assert [r.doc_id for r in retrieval.keyword_topk(docs, "save config", 2).collect()] == [6, 2]
    assert retrieval.keyword_topk(docs, " ", 3).count() == 0 and retrieval.keyword_topk(docs, "x", 0).count() == 0
    assert retrieval.keyword_topk(docs, "the", 3).count() == 3
    n, avg = 6, (4 + 200 + 0 + 0 + 0 + 3) / 6
    idf = math.log(1 + (n - 1 + 0.5) / (1 + 0.5))
    tf = 2 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))
    got = {r.doc_id: r.score for r in retrieval.bm25_scores(docs, "save").collect()}
    assert got == {6: pytest.approx(idf * tf)}
    assert retrieval.bm25_scores(docs, "?!").count() == 0 and retrieval.bm25_scores(docs.limit(0), "save").count() == 0


def test_vector_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [(r.vec_id, r.score) for r in retrieval.l2_topk(v, [1.0, 0.0], 2).collect()] == [(1, 1.0), (3, 1.0)]
    assert [r.score for r in retrieval.cosine_topk(v, [0.0, 0.0], 3).collect()] == [0.0] * 3
    assert {(r.query_id, r.vec_id) for r in retrieval.nearest_many(v.where("vec_id < 3"), v, 1, query_bytes=16).collect()} == {(1, 1), (2, 2)}
    assert [r.s for r in retrieval.min_max(v.withColumn("x", F.lit(2.0)), "x", "s").select("s").collect()] == [1.0] * 3


def test_hybrid_beats_misleading_vectors(spark):
    d = spark.createDataFrame([(1, "def save_result(data): pass"), (2, "def load_config(path): read"), (3, "class DataProcessor: pass")], "doc_id bigint, text string")
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert retrieval.l2_topk(v, [1.0, 0.0, 0.0], 1).first().vec_id == 1
    assert retrieval.hybrid_topk(d, v, "load_config", [1.0, 0.0, 0.0], 1, alpha=0.35).first().doc_id == 2


def test_embed_defaults(spark):
    rows = {r.i: r.embedding for r in embedding.embed(spark.createDataFrame([(1, "a b"), (2, None), (3, " ")], "i int, t string"), "t").collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1.0) and rows[2] is None and rows[3] is None


def test_language(spark):
    rows = [("a.py", "", "python"), ("x.unknown", "def hello():\n    pass", "python"), ("x.unknown", "SELECT a FROM b", "sql"), ("Dockerfile", "FROM x", "dockerfile"), ("q", "zzz", "text"), ("m.cc", "", "cpp"), ("r.rs", "", "rust")]
    df = spark.createDataFrame(rows, "p string, c string, want string").select("want", language.detect(F.col("p"), F.col("c")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def test_ignore_rules_last_wins(spark):
    rules = paths.parse_ignore_rules("# c\n\n*.log\n!keep.log\n/top\nsub/\n")
    got = {r.p: r.i for r in spark.createDataFrame([("a/x.log",), ("a/keep.log",), ("top",), ("a/top",), ("sub/f",), ("a/sub/f",), ("sub",)], "p string").select("p", paths.is_ignored(F.col("p"), rules).alias("i")).collect()}
    assert got == {"a/x.log": True, "a/keep.log": False, "top": True, "a/top": False, "sub/f": True, "a/sub/f": True, "sub": False}


def test_means_and_thresholds(spark):
    runs = spark.sql("select 'a' mode, 100D latency_ms, named_struct('total', 15) tokens, null error union all select 'a', 300D, named_struct('total', 30), null")
    r = rollup.operational_summary(runs, F.col("mode")).first()
    assert (r.mean_latency_ms, r.mean_tokens) == (200.0, 22.5)
    m = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "mode string, f double")
    assert {r.mode for r in rollup.threshold_failures(m, {"f": 0.5}, ("a", "b", "c")).collect()} == {"b", "c"}
    assert math.isnan(m.where("false").agg(rollup.mean_or_nan("f").alias("x")).first().x)
    items = spark.createDataFrame([("gs001",), ("gs002",)], "id string")
    assert [r.id for r in rollup.pending(items, items.limit(1)).collect()] == ["gs002"]


def test_graph_tables(spark):
    e = spark.createDataFrame([("a", "b", "calls", 2, "f", 1), ("a", "b", "imports", 5, "f", 2), ("a", "a", "calls", 1, "f", 3), (None, "b", "calls", 1, "f", 4)], "src string, dst string, relation string, line int, file_path string, seq int")
    edges = graph.edges_last_write(e)
    assert [tuple(r)[:4] for r in edges.collect()] == [("a", "b", "imports", 5)]
    n = spark.createDataFrame([("a", "function", "a", "f", None, 1), ("a", "function", "a", "f", 9, 2)], "node_id string, kind string, name string, file_path string, line int, seq int")
    nodes = {r.node_id: (r.kind, r.line) for r in graph.nodes_first_write(n, edges).collect()}
    assert nodes == {"a": ("function", None), "b": (None, None)}


def test_messages_answers_and_sources(spark):
    m = spark.createDataFrame([("t", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(10)] + [("t", 11, "system", "x"), ("t", 12, "user", " ")], "thread_id string, turn int, role string, content string")
    assert sorted(r.turn for r in answers.recent_messages(m).collect()) == [4, 5, 6, 7, 8, 9]
    h = spark.createDataFrame([(1, i, f"f{i}.py", "c" * 600) for i in range(7)], "question_id int, rank int, file_path string, content string")
    a = answers.template_answer(h).first().answer
    assert "f0.py, f1.py, f2.py, f3.py and 3 more" in a and a.endswith("c" * 500)
    s = spark.createDataFrame([("r", 1, '{"a":[{"file_path":"x.py"}]}'), ("r", 0, '{"path": "y.py"}'), ("r", 2, '{"file":"x.py"}')], "run_id string, seq int, payload string")
    assert answers.trace_sources(s).first().sources == ["y.py", "x.py"]


def test_golden_and_results(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id":"gs1","question":"q"}\n\n{"id":"gs2","category":"x"}\n')
    rows = {r.id: r for r in stores.load_golden(spark, str(tmp_path / "g.jsonl")).collect()}
    assert rows["gs1"].category == "retrieval" and rows["gs2"].expected_answer == "" and len(rows) == 2
    path = str(tmp_path / "results")
    assert stores.load_results(spark, path).count() == 0
    stores.append_results(spark.sql("select 'm' mode, 'gs1' id, 'a' answer"), path)
    stores.append_results(spark.sql("select 'm' mode, 'gs2' id, 'a' answer"), path)
    assert stores.load_results(spark, path, "m").count() == 2
    as_json, as_text = stores.write_report(spark.sql("select 'm' mode, double('nan') x, 1.5D y"), str(tmp_path / "rep"))
    assert "n/a" in open(as_text).read() and "1.500" in open(as_text).read()
    with pytest.raises(ValueError):
        stores.TableStore(spark, str(tmp_path), "x", "other")


def test_numbering_without_a_window(spark):
    from repoloom.session import numbered

    rows = [(g, i) for g, n in (("a", 50), ("b", 3), ("c", 200)) for i in range(n)]
    got = {(r.g, r.i): r.position for r in numbered(spark.createDataFrame(rows, "g string, i int"), "g", "i").collect()}
    assert got == {(g, i): i for g, i in rows}
    assert numbered(spark.createDataFrame([], "g string, i int"), "g", "i").count() == 0


def test_stored_postings_answer_like_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, ""), (5, "a red hen " * 50)], "doc_id bigint, text string")
    index = retrieval.postings(docs).save(str(tmp_path / "postings"))
    for query in ("red fox", "hen hen", "none", ""):
        assert sorted(map(tuple, retrieval.bm25_topk(index, query).collect())) == sorted(map(tuple, retrieval.bm25_topk(docs, query).collect()))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (4, [0.0, 1.0]), (9, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    with_index = retrieval.hybrid_topk(docs, v, "red fox", [1.0, 0.0], 4, 2, index=index).collect()
    assert with_index == retrieval.hybrid_topk(docs, v, "red fox", [1.0, 0.0], 4, 2).collect() and len(with_index) == 4
    assert retrieval.hybrid_topk(docs.limit(0), v, "red", [1.0, 0.0]).count() == 0


def test_nearest_keeps_the_best_over_batches_and_sets(spark):
    v = spark.range(3000).selectExpr("id as vec_id", "array(cast(id % 97 as float), cast(id % 89 as float)) as embedding").repartition(3)
    q = v.where("vec_id % 500 = 0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.query_id, r["rank"]): (r.distance, r.vec_id) for r in retrieval.nearest_many(q, v, 4, query_bytes=40).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(r.vec_id, list(r.embedding)) for r in v.collect()]
    for i, e in rows:
        if i % 500 == 0:
            best = sorted((round(sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), 6), k) for k, x in rows)[:4]
            assert [got[i, n] for n in (1, 2, 3, 4)] == best


def test_settings_and_metadata(spark):
    df = spark.createDataFrame([(" Yes",), ("on",), ("0",), (None,), ("TRUE ",)], "v string")
    assert [r[0] for r in df.select(text.is_true(F.col("v"))).collect()] == [True, True, False, False, True]
    assert stores.plain_metadata({"a": None, "b": [1, None], "c": 2, "d": {"x": 1}}, "t") == {"text": "t", "b": ["1", "None"], "c": 2, "d": "{'x': 1}"}
    row = df.limit(1).select(stores.metadata_map({"a": F.lit(None).cast("string"), "b": F.lit(3)}).alias("m")).first()
    assert row.m == {"b": "3"}
