"""Queries: the code graph over an order table that stands for calls (part calls supplier), and its resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.operators import graph
from repoloom.session import table

SEED, SYMBOL, PATH = "7", "red widget", "index.py"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"), F.lit("calls").alias("relation"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("file_path"), F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice").alias("seq"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("node_id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", F.lit("index.py")).alias("file_path"), F.col("p_size").alias("line"), F.col("p_partkey").alias("seq"))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = graph.edges_last_write(_edges(spark, sf_dir))
    return graph.nodes_first_write(_nodes(spark, sf_dir), edges), edges


def graph_edges_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_last_write(_edges(spark, sf_dir))


def graph_nodes_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.counts(*_graph(spark, sf_dir))


def resolve_symbol_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_symbol(_nodes(spark, sf_dir), SYMBOL)


def resolve_file_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve_file(_nodes(spark, sf_dir).withColumn("kind", F.lit("file")), PATH)


def who_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    seeded = nodes.withColumn("name", F.when(F.col("node_id") == SEED, F.lit("seed")).otherwise(F.col("name")))
    return graph.who_calls(seeded, edges, "seed").select("node_id", "callee_id", "call_line", "name")


def what_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph.what_calls(nodes, edges, SYMBOL).select("node_id", "caller_id", "call_line", "name")


def impact_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    seeded = nodes.withColumn("name", F.when(F.col("node_id") == SEED, F.lit("seed")).otherwise(F.col("name")))
    return graph.impact_of(seeded, edges, "seed").select("node_id", "kind")


def dependencies_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    files = nodes.withColumn("kind", F.lit("file"))
    return graph.dependencies_of(files, edges.withColumn("relation", F.lit("imports")), PATH).select("node_id", "import_line", "name")


QUERIES = {f.__name__: f for f in (graph_edges_last_write, graph_nodes_first_write, graph_counts, resolve_symbol_tiers, resolve_file_shortest, who_calls, what_calls, impact_of, dependencies_of)}

_E = """e AS (SELECT src, dst, 'calls' AS relation, s.l AS line, s.f AS file_path FROM (SELECT l_partkey::VARCHAR AS src, l_suppkey::VARCHAR AS dst,
    arg_max({'l': l_linenumber, 'f': l_returnflag}, (l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice)) AS s FROM lineitem WHERE l_partkey != l_suppkey GROUP BY 1, 2))"""
_N = f"""{_E}, n AS (SELECT p_partkey::VARCHAR AS node_id, p_type AS kind, p_name AS name, p_brand || '/index.py' AS file_path, p_size AS line FROM part
    UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) WHERE id NOT IN (SELECT p_partkey::VARCHAR FROM part))"""
ORACLES = {
    "graph_edges_last_write": f"WITH {_E} SELECT * FROM e",
    "graph_nodes_first_write": f"WITH {_N} SELECT * FROM n",
    "graph_counts": f"WITH {_N} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges",
    "resolve_symbol_tiers": f"SELECT p_partkey::VARCHAR AS node_id FROM part WHERE p_name = '{SYMBOL}'",
    "resolve_file_shortest": "SELECT p_partkey::VARCHAR AS node_id FROM part ORDER BY length(p_brand), p_partkey::VARCHAR LIMIT 1",
    "who_calls": f"WITH {_N} SELECT e.src AS node_id, e.dst AS callee_id, e.line AS call_line, n.name FROM e LEFT JOIN n ON n.node_id = e.src WHERE e.dst = '{SEED}'",
    "what_calls": f"WITH {_N} SELECT e.dst AS node_id, e.src AS caller_id, e.line AS call_line, n.name FROM e LEFT JOIN n ON n.node_id = e.dst WHERE e.src IN (SELECT node_id FROM n WHERE name = '{SYMBOL}')",
    "impact_of": f"""
        WITH RECURSIVE {_N}, r(id) AS (SELECT src FROM e WHERE dst = '{SEED}' UNION SELECT e.src FROM e JOIN r ON e.dst = r.id)
        SELECT n.node_id, n.kind FROM n JOIN r ON r.id = n.node_id WHERE r.id != '{SEED}'""",
    "dependencies_of": f"WITH {_N}, f AS (SELECT node_id FROM n WHERE file_path IS NOT NULL ORDER BY length(file_path), node_id LIMIT 1) SELECT e.dst AS node_id, e.line AS import_line, n.name FROM e JOIN f ON e.src = f.node_id LEFT JOIN n ON n.node_id = e.dst",
}
