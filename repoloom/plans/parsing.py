"""Queries: every file parsed once, and what follows from the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import paths
from repoloom.operators import graph, rollup
from repoloom.parsers import splitting
from repoloom.parsers.facts import parse_files
from repoloom.session import table


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all files; a path counts within its project, with the content of its last scan."""
    f = table(spark, sf_dir, "files").groupBy("project_id", "path").agg(F.max_by("content", F.struct("scanned_at", "file_id")).alias("content"))
    return parse_files(f.select("project_id", F.concat_ws("/", "project_id", "path").alias("path"), paths.language_of(F.col("path")).alias("language"), "content"))


def parse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).groupBy("language", "fact").agg(F.count("*").alias("n"))


def file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.file_counts(_facts(spark, sf_dir))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where("fact in ('function', 'class', 'method', 'sql_table')").select("path", "fact", "name", "qualified", "line", "is_async", "is_nested", "parameters", "docstring")


def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).where("fact in ('function', 'class', 'method', 'global_variable', 'sql_table')").where(F.col("name") == "__init__")
    return rows.select("path", "line", "qualified", "fact").orderBy("path", "line", "qualified")


def sql_tables_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that the SQL scripts of a project create."""
    return _facts(spark, sf_dir).where("fact = 'sql_table'").select("path", "name").groupBy("path", "name").agg(F.count("*").alias("n"))


def java_imports_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where("fact = 'import' and language = 'java'").groupBy("path", "module").agg(F.count("*").alias("n"))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").dropDuplicates(["file_id"])
    return splitting.code_chunks(f.select("project_id", "path", paths.language_of(F.col("path")).alias("language"), "content"))


def code_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(_facts(spark, sf_dir))[1]


def code_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(_facts(spark, sf_dir))[0]


QUERIES = {f.__name__: f for f in (parse_facts, file_rollup, symbols, find_symbol, sql_tables_in_files, java_imports_in_files, code_chunks, code_graph_edges, code_graph_nodes)}
_ONCE = "(SELECT DISTINCT ON (project_id, path) * FROM files ORDER BY project_id, path, scanned_at DESC NULLS LAST, file_id DESC NULLS LAST)"
ORACLES: dict[str, str] = {
    "sql_tables_in_files": f"""
        SELECT path, name, count(*) AS n FROM (SELECT project_id || '/' || path AS path, unnest(regexp_extract_all(regexp_replace(content, '--[^\\n]*|/\\*(?:[^*]|\\*+[^*/])*\\*+/', ' ', 'g'), '(?i)\\bCREATE\\s+(?:TEMPORARY\\s+|TEMP\\s+)?TABLE\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?["`\\[]?([\\w.]+)["`\\]]?\\s*\\(', 1)) AS name
            FROM {_ONCE} WHERE lower(path) LIKE '%.sql') GROUP BY 1, 2""",
    "java_imports_in_files": f"""
        SELECT path, module, count(*) AS n FROM (SELECT project_id || '/' || path AS path, unnest(regexp_extract_all(content, '(?m)^\\s*import\\s+(?:static\\s+)?([\\w.]+(?:\\.\\*)?)\\s*;', 1)) AS module
            FROM {_ONCE} WHERE lower(path) LIKE '%.java') GROUP BY 1, 2""",
}
