"""Queries: chunks by lines, their coverage, and the symbols they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.operators import chunking
from repoloom.plans.text import _sql_lines
from repoloom.session import table


def chunk_fixed_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"), 40)


def chunk_overlap_40_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.overlapping_chunks(table(spark, sf_dir, "documents"), 40, 15, None)


def chunk_char_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.overlapping_chunks(table(spark, sf_dir, "documents"), 8, 2, 400)


def chunk_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return chunking.coverage_gaps(docs, chunking.overlapping_chunks(docs, 8, 2, 400))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("line", F.col("event_id").cast("int"))


def enclosing_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    symbols = e.where("event_type in ('purchase', 'signup')").select("user_id", "line", F.concat_ws("#", "event_type", "line").alias("name"), F.lit("function").alias("kind"))
    points = e.where("event_type not in ('purchase', 'signup')").select("user_id", F.col("event_id").alias("point_id"), "line")
    return chunking.enclosing(points, symbols, "user_id").select("user_id", F.col("point_id").cast("bigint").alias("event_id"), "symbol_name")


def chunk_symbol_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a file with the symbol of any chunk that begins in their lines: one that their text declares, else the first."""
    c = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
    lined = c.select("file_id", "chunk_id", "chunk_index", F.col("metadata")["start_line"].cast("int").alias("start_line"), F.col("metadata")["end_line"].cast("int").alias("end_line"), F.col("metadata")["symbol_name"].alias("name"), "text")
    symbols = lined.where("name is not null").select("file_id", "name", F.lit("function").alias("kind"), F.col("start_line").alias("line"))
    chunks = lined.groupBy("file_id", "chunk_index").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.coalesce(F.min("text"), F.lit("")).alias("content"))
    return chunking.symbols_in_chunks(chunks, symbols, "file_id").select("file_id", "chunk_index", "start_line", "end_line", "symbol_name")


def chunk_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = chunking.fixed_chunks(docs, 40).select("doc_id", F.col("start_line").alias("true_start"), "content")
    return chunking.relocate(docs.select("doc_id", "text"), pieces).select("doc_id", "true_start", "start_line", "end_line")


QUERIES = {f.__name__: f for f in (chunk_fixed_40, chunk_overlap_40_15, chunk_char_cap, chunk_coverage_gaps, enclosing_asof, chunk_symbol_range, chunk_relocation)}


def _overlap_sql(size: int, overlap: int, cap: int | None) -> str:
    step = size - overlap
    content = f"whole[1:{cap}]" if cap else "whole"
    end = f"CASE WHEN length(whole) > length({content}) THEN k * {step} + 1 + length({content}) - length(replace({content}, chr(10), '')) ELSE least(n, k * {step} + {size}) END"
    return f"""
        SELECT doc_id, k::INT AS chunk_index, (k * {step} + 1)::INT AS start_line, ({end})::INT AS end_line, {content} AS content
        FROM (SELECT doc_id, n, k, array_to_string(l2[k * {step} + 1:k * {step} + {size}], chr(10)) AS whole
              FROM (SELECT doc_id, l2, len(l2) AS n, unnest(range(0, greatest(0, ceil((len(l2) - {size}) / {step}))::BIGINT + 1)) AS k FROM {_sql_lines('text', 'documents')} WHERE len(l2) > 0))
        WHERE regexp_matches({content}, '[^ \\t\\n\\x0B\\f\\r]')"""


ORACLES = {
    "chunk_fixed_40": f"""
        SELECT doc_id, (k * 40 + 1)::INT AS start_line, least(len(l2), k * 40 + 40)::INT AS end_line, array_to_string(l2[k * 40 + 1:k * 40 + 40], chr(10)) AS content
        FROM (SELECT doc_id, l2, unnest(range(0, (len(l2) + 39) // 40)) AS k FROM {_sql_lines('text', 'documents')} WHERE len(l2) > 0)
        WHERE regexp_matches(array_to_string(l2[k * 40 + 1:k * 40 + 40], chr(10)), '[^ \\t\\n\\x0B\\f\\r]')""",
    "chunk_overlap_40_15": _overlap_sql(40, 15, None),
    "chunk_char_cap": _overlap_sql(8, 2, 400),
    "chunk_coverage_gaps": f"""
        SELECT doc_id, unnest(range(1, len(l2) + 1))::INT AS line_no FROM {_sql_lines('text', 'documents')}
        EXCEPT SELECT doc_id, unnest(range(start_line, end_line + 1))::INT FROM ({_overlap_sql(8, 2, 400)})""",
    "enclosing_asof": """
        WITH s AS (SELECT user_id, event_id AS at, event_type || '#' || event_id AS symbol_name FROM events WHERE event_type IN ('purchase', 'signup'))
        SELECT e.user_id, e.event_id, s.symbol_name FROM (SELECT * FROM events WHERE event_type NOT IN ('purchase', 'signup')) e
        ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.event_id >= s.at""",
    "chunk_symbol_range": """
        WITH l AS (SELECT DISTINCT file_id, chunk_id, chunk_index, metadata['start_line']::INT AS start_line, metadata['end_line']::INT AS end_line, metadata['symbol_name'] AS name, text FROM chunks),
        c AS (SELECT file_id, chunk_index, min(start_line) AS start_line, max(end_line) AS end_line, coalesce(min(text), '') AS content FROM l GROUP BY 1, 2),
        j AS (SELECT c.*, s.name, s.start_line AS line, s.name IS NOT NULL AND regexp_matches(c.content, '\\b(?:def|class|function|const|let|var)\\s+' || regexp_escape(string_split(coalesce(s.name, ''), '.')[-1]) || '\\b') AS declared
            FROM c LEFT JOIN (SELECT * FROM l WHERE name IS NOT NULL) s ON c.file_id = s.file_id AND s.start_line BETWEEN c.start_line AND c.end_line)
        SELECT file_id, chunk_index, start_line, end_line, arg_min(name, (NOT declared, line, name)) AS symbol_name FROM j GROUP BY ALL""",
    "chunk_relocation": f"""
        WITH d AS (SELECT doc_id, text, l2, len(l2) AS n FROM {_sql_lines('text', 'documents')} WHERE len(l2) > 0),
        p AS (SELECT doc_id, text, l2, n, k * 40 + 1 AS true_start, l2[k * 40 + 1:k * 40 + 40] AS ls, array_to_string(l2[k * 40 + 1:k * 40 + 40], chr(10)) AS content FROM (SELECT *, unnest(range(0, (n + 39) // 40)) AS k FROM d)),
        f AS (SELECT doc_id, true_start, n, strpos(text, content) AS place, text, list_position(l2, ls[1]) AS hit, len(ls) - CASE WHEN ls[-1] = '' THEN 1 ELSE 0 END AS size FROM p WHERE regexp_matches(content, '[^ \\t\\n\\x0B\\f\\r]')),
        s AS (SELECT *, CASE WHEN place > 0 THEN length(text[1:place - 1]) - length(replace(text[1:place - 1], chr(10), '')) + 1 WHEN hit > 0 THEN hit ELSE 1 END AS s FROM f)
        SELECT doc_id, true_start::INT AS true_start, s::INT AS start_line, (CASE WHEN place > 0 OR hit > 0 THEN least(s + greatest(size, 1) - 1, n) ELSE n END)::INT AS end_line FROM s""",
}
