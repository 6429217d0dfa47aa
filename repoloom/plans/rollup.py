"""Queries: roll-ups, evaluation figures, traces, patterns and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoloom.functions import text as text_functions
from repoloom.operators import rollup
from repoloom.session import table

MODES = ("vector", "hybrid", "agentic", "graph")
IMPORT = r"(?m)^(?:import ([\w.]+)|from ([\w.]+) import)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").dropDuplicates(["file_id"])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "question_runs").dropDuplicates(["run_id"])


def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.project_summary(_files(spark, sf_dir))


def files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per language with the ten first paths, in the order of the paths."""
    f = _files(spark, sf_dir).select(F.lower(F.coalesce("language", F.lit("unknown"))).alias("language"), "path", "file_id")
    top = rollup.last_per_group(f, "language", [F.asc("path"), F.asc("file_id")], 10)
    listed = top.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("path", "file_id"))).alias("ps")).select("language", F.array_join(F.transform("ps", lambda x: x["path"]), "|").alias("first_paths"))
    return f.groupBy("language").agg(F.count("*").alias("n_files")).join(listed, "language")


def languages_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).where("language is not null")
    return f.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower("language"))), ",").alias("languages"))


def operational_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.operational_summary(_runs(spark, sf_dir), F.lower("mode"))


def mean_ignoring_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("project_id").agg(F.round(rollup.mean_or_nan("latency_ms"), 6).alias("mean_latency"))


def threshold_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _runs(spark, sf_dir).groupBy(F.lower("mode").alias("mode")).agg(F.round(F.avg("latency_ms"), 6).alias("latency"), F.round(F.avg("tokens.completion"), 6).alias("completion"))
    return rollup.threshold_failures(means, {"latency": 3000.0, "completion": 1e6}, MODES)


def mode_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir).select("project_id", F.lower("mode").alias("mode"), "latency_ms")
    return runs.groupBy("project_id").pivot("mode", list(MODES)).agg(F.count(F.lit(1))).fillna(0)


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _runs(spark, sf_dir).where("error is null and answer is not null and lower(mode) = 'vector'")
    return rollup.pending(table(spark, sf_dir, "golden_items").select("id", "category"), done)


def last6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).select("project_id", "run_id", "scored_at")
    return rollup.last_per_group(rows, "project_id", [F.desc("scored_at"), F.desc("run_id")], 6).select("project_id", "run_id")


def sources_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of each golden item in the order in which its runs named them first."""
    rows = _runs(spark, sf_dir).where("sources is not null").select("id", "scored_at", "run_id", F.posexplode("sources").alias("pos", "source"))
    first = rows.groupBy("id", "source").agg(F.min(F.struct("scored_at", "run_id", "pos")).alias("first"))
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("first", "source"))).alias("s")).select("id", F.array_join(F.transform("s", lambda x: x["source"]), "|").alias("sources"))


def token_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _runs(spark, sf_dir).groupBy("id")
    return t.agg(*[F.sum(F.col(f"tokens.{c}").cast("bigint")).alias(c) for c in ("prompt", "completion", "total")])


def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _runs(spark, sf_dir).select(F.lower("mode").alias("mode"), F.explode("tool_trace").alias("t"))
    return calls.groupBy("mode", F.col("t.tool").alias("tool")).agg(F.count("*").alias("n_calls"), F.countDistinct(F.get_json_object("t.args", "$.name")).alias("n_names"))


def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def golden_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run's answer names the file that its golden item expects."""
    g = table(spark, sf_dir, "golden_items").select("id", "category", "expected_source_file")
    r = _runs(spark, sf_dir).select("id", "run_id", "answer", "sources")
    both = r.join(g, "id").where("expected_source_file != ''")
    named = F.coalesce(F.contains("answer", F.col("expected_source_file")), F.lit(False)) | F.coalesce(F.array_contains("sources", F.col("expected_source_file")), F.lit(False))
    return both.groupBy("category").agg(F.count("*").alias("n_runs"), F.count_if(named).alias("n_named"))


def context_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a run's contexts that hold a word of its question, averaged by mode."""
    runs = _runs(spark, sf_dir).where("contexts is not null and size(contexts) > 0").select(F.lower("mode").alias("mode"), "contexts", F.filter(F.split(F.lower("question"), "[^a-z0-9_]+"), lambda w: F.length(w) > 3).alias("ws"))
    hit = F.size(F.filter("contexts", lambda c: F.exists(F.col("ws"), lambda w: F.contains(F.lower(c), w))))
    return runs.groupBy("mode").agg(F.round(F.avg(hit / F.size("contexts")), 6).alias("precision"))


def repeated_patterns_ge3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.repeated(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], 3)


def argmax_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.busiest(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


def call_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive events between errors, per user."""
    rows = rollup.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], F.col("event_type") == "error")
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def stop_at_first_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.until_first(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], F.col("event_type") == "purchase").select("user_id", "event_id")


def duplicate_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the lines of a function header that repeat an earlier header in the same file."""
    from repoloom.functions.text import lines

    defs = lines(_files(spark, sf_dir), "content", "file_id").select("file_id", F.col("line_no").alias("line"), F.regexp_extract("line", r"^\s*def (\w+)\(", 1).alias("name")).where("name != ''")
    return rollup.duplicates(defs, ["file_id"], "name", "line").select("file_id", "name", "line", "previous_line")


def shadowed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type whose user had that type before, except where the user signed up with it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("name"), F.col("event_id").alias("line"), F.pmod("event_id", F.lit(7)).alias("function"))
    return rollup.shadowed(e.where("name != 'view'"), e.where("name != 'view'"), e.where("name = 'view'").withColumn("name", F.lit("click"))).select("path", "name", "line", "global_line")


def top_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).where("content is not null").select("project_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^import ([\w.]+)"), F.lit(1))).alias("module"))
    return f.groupBy("project_id", rollup.top_module(F.col("module")).alias("module")).agg(F.count("*").alias("n"))


def dependency_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir).where("content is not null").select("project_id", F.explode(F.regexp_extract_all("content", F.lit(r"require\('([^']+)'\)"), F.lit(1))).alias("module"))
    return rollup.dependency_groups(f, "module", "project_id")


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by the role that their name suggests; the first keyword in the list wins."""
    from repoloom.render.categories import class_category

    names = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"]).select(F.col("metadata")["symbol_name"].alias("name")).where("name is not null")
    return names.groupBy(class_category(F.col("name")).alias("category")).agg(F.count("*").alias("n"))


def flow_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.flow_flags(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type"), {"purchase": ("purchase",), "quiet": ("view", "click")})


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an evaluation is: the place of each run among those of its mode."""
    runs = _runs(spark, sf_dir).select(F.lower("mode").alias("mode"), "run_id")
    return rollup.progress(runs, "mode", "run_id")


def settings_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit(" "), F.col("l_linenumber").cast("string")).alias("setting"))
    return rows.withColumn("on", text_functions.is_true(F.col("setting"))).groupBy("setting", "on").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (flow_flags, run_progress, settings_on, project_summary, files_by_language, languages_set, operational_summary, mean_ignoring_null, threshold_failures, mode_pivot, resume_pending, last6_runs, sources_first_seen, token_sums, tool_usage, json_payload, golden_containment, context_precision, repeated_patterns_ge3, argmax_flow, call_islands, stop_at_first_return, duplicate_definitions, shadowed_names, top_modules, dependency_groups, category_counts)}

_F = "(SELECT DISTINCT ON (file_id) * FROM files)"
_R = "(SELECT DISTINCT ON (run_id) * FROM question_runs)"
_MODES = ", ".join(f"('{m}')" for m in MODES)


def _category_sql() -> str:
    from repoloom.render.categories import CLASS_KEYWORDS

    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(name), {chr(39)}{k}{chr(39)})' for k in ks)} THEN '{c}'" for c, ks in CLASS_KEYWORDS.items()) + " ELSE 'other' END"


ORACLES = {
    "flow_flags": """
        SELECT user_id, bool_or(coalesce(event_type = 'purchase', false)) AS any_purchase, bool_and(coalesce(event_type = 'purchase', false)) AS all_purchase,
            bool_or(coalesce(event_type IN ('view', 'click'), false)) AS any_quiet, bool_and(coalesce(event_type IN ('view', 'click'), false)) AS all_quiet FROM events GROUP BY user_id""",
    "run_progress": """
        SELECT mode, run_id, row_number() OVER (PARTITION BY mode ORDER BY run_id) AS index, count(*) OVER (PARTITION BY mode) AS total FROM (SELECT DISTINCT run_id, lower(mode) AS mode FROM question_runs)""",
    "settings_on": "SELECT ' ' || l_linenumber AS setting, l_linenumber = 1 AS \"on\", count(*) AS n FROM lineitem GROUP BY 1, 2",
    "project_summary": f"""
        SELECT count(*) AS total_files, coalesce(sum(lines_of_code), 0)::BIGINT AS total_lines, coalesce(sum(functions_count), 0)::BIGINT AS total_functions, coalesce(sum(classes_count), 0)::BIGINT AS total_classes,
            coalesce(sum(tables_count), 0)::BIGINT AS total_tables, coalesce(sum(imports_count), 0)::BIGINT AS total_imports, count(error) AS failed_files FROM {_F}""",
    "files_by_language": f"""
        SELECT language, count(*) AS n_files, string_agg(path, '|' ORDER BY path, file_id) FILTER (rn <= 10) AS first_paths
        FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY path, file_id) AS rn FROM (SELECT lower(coalesce(language, 'unknown')) AS language, path, file_id FROM {_F})) GROUP BY language""",
    "languages_set": f"SELECT project_id, string_agg(DISTINCT lower(language), ',' ORDER BY lower(language)) AS languages FROM {_F} WHERE language IS NOT NULL GROUP BY project_id",
    "operational_summary": f"""
        SELECT lower(mode) AS mode, count(*) AS n_runs, round(avg(coalesce(latency_ms, 0)), 6) AS mean_latency_ms, round(coalesce(avg(tokens.total), 0), 6) AS mean_tokens, count(error) AS n_errors FROM {_R} GROUP BY 1""",
    "mean_ignoring_null": f"SELECT project_id, round(coalesce(avg(latency_ms), 'nan'::DOUBLE), 6) AS mean_latency FROM {_R} GROUP BY 1",
    "threshold_failures": f"""
        WITH m AS (SELECT lower(mode) AS mode, round(avg(latency_ms), 6) AS latency, round(avg(tokens.completion), 6) AS completion FROM {_R} GROUP BY 1),
        w AS (SELECT mode, metric, minimum FROM (VALUES {_MODES}) a(mode), (VALUES ('latency', 3000.0), ('completion', 1e6)) b(metric, minimum))
        SELECT w.mode, w.metric, CASE w.metric WHEN 'latency' THEN m.latency ELSE m.completion END AS value FROM w LEFT JOIN m USING (mode)
        WHERE value IS NULL OR isnan(value) OR value < minimum""",
    "mode_pivot": f"SELECT project_id, {', '.join(f'count(*) FILTER (lower(mode) = {chr(39)}{m}{chr(39)}) AS {m}' for m in MODES)} FROM {_R} GROUP BY 1",
    "resume_pending": f"SELECT id, category FROM golden_items WHERE id NOT IN (SELECT id FROM {_R} WHERE error IS NULL AND answer IS NOT NULL AND lower(mode) = 'vector')",
    "last6_runs": f"SELECT project_id, run_id FROM {_R} QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY scored_at DESC, run_id DESC) <= 6",
    "sources_first_seen": f"""
        WITH s AS (SELECT id, scored_at, run_id, unnest(range(len(sources))) AS pos, unnest(sources) AS source FROM {_R} WHERE sources IS NOT NULL),
        f AS (SELECT id, source, min((scored_at, run_id, pos)) AS first FROM s GROUP BY 1, 2) SELECT id, string_agg(source, '|' ORDER BY first, source) AS sources FROM f GROUP BY 1""",
    "token_sums": f"SELECT id, sum(tokens.prompt)::BIGINT AS prompt, sum(tokens.completion)::BIGINT AS completion, sum(tokens.total)::BIGINT AS total FROM {_R} GROUP BY 1",
    "tool_usage": f"SELECT mode, t.tool, count(*) AS n_calls, count(DISTINCT t.args ->> '$.name') AS n_names FROM (SELECT lower(mode) AS mode, unnest(tool_trace) AS t FROM {_R}) GROUP BY 1, 2",
    "json_payload": "SELECT event_id, (props ->> '$.k')::INT AS k FROM events",
    "golden_containment": f"""
        SELECT category, count(*) AS n_runs, count(*) FILTER (coalesce(contains(answer, expected_source_file), false) OR coalesce(list_contains(sources, expected_source_file), false)) AS n_named
        FROM {_R} r JOIN golden_items g USING (id) WHERE expected_source_file != '' GROUP BY 1""",
    "context_precision": f"""
        SELECT mode, round(avg(len(list_filter(contexts, lambda c: len(list_filter(ws, lambda w: contains(lower(c), w))) > 0)) / len(contexts)), 6) AS precision
        FROM (SELECT lower(mode) AS mode, contexts, list_filter(string_split_regex(lower(question), '[^a-z0-9_]+'), lambda w: length(w) > 3) AS ws FROM {_R} WHERE contexts IS NOT NULL AND len(contexts) > 0) GROUP BY 1""",
    "repeated_patterns_ge3": "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3",
    "argmax_flow": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1",
    "call_islands": """
        SELECT user_id, island, count(*) AS n, min(event_id) AS first_event
        FROM (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS island FROM events) WHERE event_type != 'error' GROUP BY 1, 2""",
    "stop_at_first_return": """
        SELECT user_id, event_id FROM (SELECT *, coalesce(max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events) WHERE s = 0""",
    "duplicate_definitions": f"""
        WITH l AS (SELECT file_id, unnest(range(1, len(x) + 1))::INT AS line, unnest(x) AS t FROM (SELECT file_id, string_split_regex(content, '\\r\\n|[\\n\\r]') AS x FROM {_F} WHERE content IS NOT NULL)),
        d AS (SELECT file_id, line, regexp_extract(t, '^\\s*def (\\w+)\\(', 1) AS name FROM l)
        SELECT file_id, name, line, previous_line FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY line) AS rn, min(line) OVER (PARTITION BY file_id, name) AS previous_line FROM d WHERE name != '') WHERE rn > 1""",
    "shadowed_names": """
        WITH e AS (SELECT user_id AS path, event_type AS name, event_id AS line, event_id % 7 AS function FROM events), g AS (SELECT path, name, min(line) AS global_line FROM e WHERE name != 'view' GROUP BY 1, 2)
        SELECT e.path, e.name, e.line, g.global_line FROM e JOIN g USING (path, name) WHERE e.name != 'view'
            AND NOT EXISTS (SELECT 1 FROM e v WHERE v.name = 'view' AND e.name = 'click' AND v.path = e.path AND v.function = e.function)""",
    "top_modules": f"SELECT project_id, split_part(m, '.', 1) AS module, count(*) AS n FROM (SELECT project_id, unnest(regexp_extract_all(content, '(?m)^import ([\\w.]+)', 1)) AS m FROM {_F}) GROUP BY 1, 2",
    "dependency_groups": f"""
        SELECT project_id, CASE WHEN m LIKE '@%' THEN array_to_string(string_split(m, '/')[1:2], '/') WHEN contains(m, '/') AND m NOT LIKE '.%' THEN split_part(m, '/', 1) WHEN m LIKE '.%' THEN m ELSE split_part(m, '.', 1) END AS package,
            count(*) AS n_imports, count(DISTINCT m) AS n_modules FROM (SELECT project_id, unnest(regexp_extract_all(content, 'require\\(''([^'']+)''\\)', 1)) AS m FROM {_F}) GROUP BY 1, 2""",
    "category_counts": f"SELECT {_category_sql()} AS category, count(*) AS n FROM (SELECT DISTINCT chunk_id, metadata['symbol_name'] AS name FROM chunks) WHERE name IS NOT NULL GROUP BY 1",
}
