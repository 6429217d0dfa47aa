"""Answers without a model: messages, template answers and what an agent's trace says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HISTORY = 6
PREVIEW = 500


def recent_messages(messages: DataFrame, thread: str = "thread_id", turn: str = "turn", n: int = HISTORY) -> DataFrame:
    """The last ``n`` user and assistant messages of each thread that are not blank, in order."""
    kept = messages.where(F.col("role").isin("user", "assistant") & F.col("content").rlike(r"\S"))
    w = Window.partitionBy(thread).orderBy(F.desc(turn))
    return kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def template_answer(hits: DataFrame, question: str = "question_id") -> DataFrame:
    """An answer from search hits (question, rank, file_path, content): files, and the start of the best chunk."""
    ordered = hits.groupBy(question).agg(F.array_sort(F.collect_list(F.struct("rank", "file_path", "content"))).alias("h"))
    files = F.array_distinct(F.transform("h", lambda x: x["file_path"]))
    named = F.when(F.size(files) <= 5, F.array_join(files, ", ")).otherwise(F.concat(F.array_join(F.slice(files, 1, 4), ", "), F.lit(" and "), (F.size(files) - 4).cast("string"), F.lit(" more")))
    best = F.left(F.element_at("h", 1)["content"], F.lit(PREVIEW))
    return ordered.select(question, F.concat(F.lit("Relevant files: "), named, F.lit("\n\n"), best).alias("answer"))


def trace_sources(steps: DataFrame, run: str = "run_id", payload: str = "payload", order: str = "seq") -> DataFrame:
    """Files that the results of a run's tool calls name, first seen first: ``file_path`` values of JSON at any depth."""
    names = F.regexp_extract_all(payload, F.lit(r'"(?:file_path|file|path|source)"\s*:\s*"([^"]+)"'), F.lit(1))
    found = steps.select(run, order, F.posexplode(names).alias("pos", "source"))
    first = found.groupBy(run, "source").agg(F.min(F.struct(order, "pos")).alias("first"))
    return first.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("first", "source"))).alias("s")).select(run, F.transform("s", lambda x: x["source"]).alias("sources"))
