"""Queries: diagrams and documents of every file, template answers and message windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import paths
from repoloom.operators import answers
from repoloom.render import bundle
from repoloom.session import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").dropDuplicates(["file_id"])
    return f.select("project_id", "path", paths.language_of(F.col("path")).alias("language"), "content")


def file_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.render_files(_files(spark, sf_dir), ("architecture", "code_architecture", "sequence", "dependency", "flowchart", "structure"))


def file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.render_files(_files(spark, sf_dir), ("docstrings", "readme", "architecture_doc"))


def svg_flowcharts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.render_files(_files(spark, sf_dir), ("svg_flowchart",))


def template_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from the sources and contexts that a run has seen."""
    r = table(spark, sf_dir, "question_runs").dropDuplicates(["run_id"]).where("sources is not null and size(sources) > 0")
    hits = r.select("run_id", "contexts", F.posexplode("sources").alias("rank", "file_path")).select("run_id", "rank", "file_path", F.coalesce(F.try_element_at("contexts", F.col("rank") + 1), F.lit("")).alias("content"))
    return answers.template_answer(hits, "run_id")


def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers of a project as one thread: the last six that are not blank."""
    r = table(spark, sf_dir, "question_runs").dropDuplicates(["run_id"])
    both = F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(0).alias("k")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.lit(1).alias("k"))))
    m = r.select("project_id", "scored_at", "run_id", both.alias("m")).select("project_id", F.struct("scored_at", "run_id", "m.k").alias("turn"), "run_id", "m.role", "m.content")
    return answers.recent_messages(m, "project_id").select("project_id", "run_id", "role")


QUERIES = {f.__name__: f for f in (file_diagrams, file_documents, svg_flowcharts, template_answer, recent_messages)}
ORACLES = {
    "template_answer": """
        WITH r AS (SELECT DISTINCT ON (run_id) * FROM question_runs WHERE sources IS NOT NULL AND len(sources) > 0),
        d AS (SELECT run_id, list_distinct(sources) AS u, sources, contexts FROM r),
        o AS (SELECT run_id, contexts, list_sort(list_transform(u, lambda x: {'p': list_position(sources, x), 's': x})) AS s FROM d)
        SELECT run_id, 'Relevant files: ' || CASE WHEN len(s) <= 5 THEN array_to_string(list_transform(s, lambda x: x.s), ', ')
            ELSE array_to_string(list_transform(s[1:4], lambda x: x.s), ', ') || ' and ' || (len(s) - 4) || ' more' END || chr(10) || chr(10) || coalesce(contexts[1], '')[1:500] AS answer FROM o""",
    "recent_messages": """
        WITH r AS (SELECT DISTINCT ON (run_id) * FROM question_runs),
        m AS (SELECT project_id, run_id, scored_at, 0 AS k, 'user' AS role, question AS content FROM r UNION ALL SELECT project_id, run_id, scored_at, 1, 'assistant', answer FROM r)
        SELECT project_id, run_id, role FROM m WHERE regexp_matches(coalesce(content, ''), '[^ \\t\\n\\x0B\\f\\r]') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY scored_at DESC, run_id DESC, k DESC) <= 6""",
}
