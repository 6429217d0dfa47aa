"""Queries: lines, ranges, search in files, paths, languages, scan decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import language, paths, text
from repoloom.session import table

IGNORE_FILE = "# build output\n*.min.js\n/generated/\n!generated/keep.py\nvendor/\n*_pb2.py\n!important.py\n"
GREP = r"return (None|\[\])|JSON\.parse"
GLOB = "**/*_by_*.py"

_SPLIT = r"'\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
_LINES = f"(SELECT *, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS l2 FROM (SELECT *, string_split_regex(%s, {_SPLIT}) AS ls FROM %s WHERE %s IS NOT NULL))"


def _sql_lines(column: str, source: str) -> str:
    return _LINES % (column, source, column)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").dropDuplicates(["file_id"])


def lines_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(table(spark, sf_dir, "documents"), "text", "doc_id")


def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.lines(table(spark, sf_dir, "documents"), "text", "doc_id").where(F.col("line_no").between(10, 20))
    body = F.array_sort(F.collect_list(F.struct("line_no", F.format_string("%4d| %s", "line_no", "line").alias("s"))))
    return rows.groupBy("doc_id").agg(body.alias("b")).select("doc_id", F.array_join(F.transform("b", lambda x: x["s"]), "\n").alias("content"))


def grep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.lines(_files(spark, sf_dir), "content", "file_id", "path").where(F.col("line").rlike(GREP))
    return rows.select("file_id", "path", "line_no", F.rtrim("line").alias("line"))


def glob_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(paths.glob_matches(F.col("path"), GLOB)).select("file_id", "path")


def eligible_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_id", paths.is_eligible(F.col("path")).alias("eligible"))


def gitignore_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_id", paths.is_ignored(F.col("path"), paths.parse_ignore_rules(IGNORE_FILE)).alias("ignored"))


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    ignored = paths.is_ignored(F.col("path"), paths.parse_ignore_rules(IGNORE_FILE))
    skipped = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda x: x.isin(*paths.SKIP_DIRECTORIES))
    reason = F.when(skipped, "directory").when(ignored, "ignored").when(~text.extension(F.col("path")).isin(*paths.INDEXABLE_EXTENSIONS), "extension").otherwise("indexed")
    return f.groupBy("project_id", reason.alias("reason")).agg(F.count("*").alias("n_files"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _files(spark, sf_dir).select("file_id", text.stem(p).alias("stem"), text.extension(p).alias("extension"), F.substring_index(p, "/", -1).alias("name"), text.safe_identifier(p).alias("identifier"), text.truncate(p, 30).alias("short"))


def language_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_id", paths.language_of(F.col("path")).alias("language"), paths.is_supported(F.col("path")).alias("supported"))


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", language.from_code(F.col("text")).alias("by_code"), language.detect(F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))).alias("language"))


def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language.scores(F.col("content"))
    return _files(spark, sf_dir).where("content is not null").select("file_id", *[scores[k].cast("bigint").alias(k) for k in ("cpp", "sql", "java", "go")])


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file_id", text.lines_of_code(F.col("content")).cast("bigint").alias("n_lines"))


_FILES = "(SELECT DISTINCT ON (file_id) * FROM files)"
_EXT = "regexp_extract(lower(regexp_extract(path, '([^/]*)$', 1)), '(\\.[^.]*)$', 1)"
_NAME = "lower(regexp_extract(path, '([^/]*)$', 1))"
_LANG = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in paths.EXTENSION_LANGUAGE.items())
_SPECIAL = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in paths.SPECIAL_NAMES.items())
_in = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _ignored_sql() -> str:
    """The last matching rule: rules in a list with their order, arg_max over those that match."""
    rows = []
    for order, pattern, negated, only in paths.parse_ignore_rules(IGNORE_FILE):
        regex = paths.ignore_rule_regex(pattern)
        if only:
            regex = regex.replace("(?:/.*)?$", "/.*$")
        rows.append(f"({order}, '{regex}', {str(not negated).lower()})")
    return f"(SELECT f.file_id, coalesce(arg_max(r.verdict, r.ord), false) AS ignored FROM {_FILES} f LEFT JOIN (VALUES {', '.join(rows)}) r(ord, regex, verdict) ON regexp_matches(f.path, r.regex) GROUP BY f.file_id)"


QUERIES = {f.__name__: f for f in (lines_numbered, read_range, grep_lines, glob_paths, eligible_paths, gitignore_last_wins, scan_stats, path_parts, language_by_path, language_detect, language_scores, code_lines)}
ORACLES = {
    "lines_numbered": f"SELECT doc_id, unnest(range(1, len(l2) + 1))::INT AS line_no, unnest(l2) AS line FROM {_sql_lines('text', 'documents')}",
    "read_range": f"""
        SELECT doc_id, string_agg(lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, ' ') || '| ' || line, chr(10) ORDER BY n) AS content
        FROM (SELECT doc_id, unnest(range(1, len(l2) + 1)) AS n, unnest(l2) AS line FROM {_sql_lines('text', 'documents')}) WHERE n BETWEEN 10 AND 20 GROUP BY doc_id""",
    "grep_lines": f"""
        SELECT file_id, path, n::INT AS line_no, rtrim(line) AS line
        FROM (SELECT file_id, path, unnest(range(1, len(l2) + 1)) AS n, unnest(l2) AS line FROM {_sql_lines('content', _FILES)}) WHERE regexp_matches(line, '{GREP}')""",
    "glob_paths": f"SELECT file_id, path FROM {_FILES} WHERE regexp_matches(path, '(?:^|/)[^/]*_by_[^/]*\\.py$')",
    "eligible_paths": f"""
        SELECT file_id, CASE WHEN path IS NULL OR path = '' THEN false WHEN len(list_intersect(string_split(path, '/'), [{_in(paths.SKIP_SEGMENTS)}])) > 0 THEN false
            WHEN {_NAME} IN ({_in(paths.SPECIAL_NAMES)}) OR contains({_NAME}, 'dockerfile') THEN true WHEN {_EXT} = '' OR {_EXT} = {_NAME} THEN true
            ELSE {_EXT} NOT IN ({_in(paths.SKIP_EXTENSIONS)}) END AS eligible FROM {_FILES}""",
    "gitignore_last_wins": f"SELECT file_id, ignored FROM {_ignored_sql()}",
    "scan_stats": f"""
        SELECT project_id, CASE WHEN len(list_intersect(string_split(path, '/')[1:-2], [{_in(paths.SKIP_DIRECTORIES)}])) > 0 THEN 'directory' WHEN ignored THEN 'ignored'
            WHEN {_EXT} NOT IN ({_in(paths.INDEXABLE_EXTENSIONS)}) THEN 'extension' ELSE 'indexed' END AS reason, count(*) AS n_files
        FROM {_FILES} f JOIN {_ignored_sql()} USING (file_id) GROUP BY 1, 2""",
    "path_parts": f"""
        SELECT file_id, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem, CASE WHEN length(name) > 1 AND strpos(name[2:], '.') > 0 THEN lower(regexp_extract(name, '(\\.[^.]+)$', 1)) ELSE '' END AS extension,
            name, trim(regexp_replace(path, '[^a-zA-Z0-9_-]', '_', 'g'), '_') AS identifier, CASE WHEN length(path) > 30 THEN path[1:27] || '...' ELSE path END AS short
        FROM (SELECT file_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM {_FILES})""",
    "language_by_path": f"""
        SELECT file_id, coalesce(CASE {_EXT} {_LANG} END, CASE regexp_replace({_NAME}, '[^a-z0-9]', '', 'g') {_SPECIAL} END, CASE WHEN contains({_NAME}, 'dockerfile.') THEN 'dockerfile' END, 'text') AS language,
            {_EXT} IN ({_in(paths.EXTENSION_LANGUAGE)}) AS supported FROM {_FILES}""",
    "language_scores": f"""
        SELECT file_id, {', '.join(' + '.join(f"len(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}'))" for p in language.PATTERNS[k]) + f' AS {k}' for k in ('cpp', 'sql', 'java', 'go'))}
        FROM {_FILES} WHERE content IS NOT NULL""",
    "code_lines": f"SELECT file_id, coalesce(len(string_split(content, chr(10))), 0)::BIGINT AS n_lines FROM {_FILES}",
}
