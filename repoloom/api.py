"""What a user of the engine calls: index a project, look around in it, search it, ask its graph, draw it.

Every method that answers a question returns a DataFrame; the ``*_json`` tools return text for callers that want it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions import paths, text
from repoloom.operators import chunking, embedding, graph, retrieval
from repoloom.parsers.facts import parse_files, parse_text
from repoloom.parsers.splitting import code_chunks
from repoloom.render import bundle, docs
from repoloom.session import materialise, numbered
from repoloom.sources import project as source
from repoloom.sources import stores


@dataclass(frozen=True)
class ChunkConfig:
    chunk_lines: int = 40
    chunk_lines_overlap: int = 15
    max_chars: int = 1500


class Engine:
    """Projects under one storage root."""

    def __init__(self, spark: SparkSession, root: str, provider: embedding.Provider = embedding.hashed) -> None:
        self.spark, self.provider = spark, provider
        self.vectors, self.graphs, self.files = stores.TableStore(spark, root, "chunks"), stores.GraphStore(spark, root), stores.TableStore(spark, root, "files")
        self.parsed = stores.TableStore(spark, root, "facts")
        self.root = root.rstrip("/")

    # --- indexing

    def index(self, folder: str | Path, config: ChunkConfig = ChunkConfig()) -> dict:
        """Scan, parse once, chunk, embed and build the graph of a folder; what was done, phase by phase."""
        folder = source.resolve_folder(str(folder))
        project = source.project_id(folder)
        phases = []
        listed = source.enumerate_files(self.spark, folder)
        stats = source.scan_stats(listed).first().asDict()
        phases.append({"phase": "scan", "status": "done", **{k: v for k, v in stats.items() if k != "skipped_paths"}})
        if not stats["files_indexed"]:
            raise ValueError(f"no indexable files in {folder}")
        wanted = listed.where("reason = 'indexed'").select("path")
        files = materialise(source.scan(self.spark, folder).join(wanted, "path", "left_semi"), "api-files")
        self.files.upsert(files)
        self.parsed.upsert(parse_files(files))
        facts = self.parsed.fetch(project)
        n = self.vectors.upsert(self.chunks(files, facts, config))
        phases.append({"phase": "chunks", "status": "done", "chunks": n})
        nodes, edges = graph.build(facts)
        self.graphs.save(project, nodes, edges)
        phases.append({"phase": "graph", "status": "done", **graph.counts(nodes, edges).first().asDict()})
        return {"project_id": project, "ready": stores.is_ready(self.vectors, self.graphs, project), "phases": phases}

    def chunks(self, files: DataFrame, facts: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
        """Chunks with symbol metadata, ids and vectors, numbered over the project in order of files and lines."""
        whole = materialise(code_chunks(files.where("content is not null"), config.chunk_lines, config.chunk_lines_overlap, config.max_chars), "api-chunks")
        symbols = facts.where("fact in ('function', 'class', 'method', 'sql_table')").select("path", F.coalesce("qualified", "name").alias("name"), F.col("fact").alias("kind"), "line")
        named = chunking.symbols_in_chunks(whole.select("path", "chunk_index", "start_line", "end_line", "content"), symbols, "path")
        both = whole.join(named.select("path", "chunk_index", "symbol_name", "symbol_kind"), ["path", "chunk_index"])
        placed = numbered(both, "project_id", "path", "chunk_index")
        chunk_id = F.concat_ws(":", "path", "start_line", "end_line", "position")
        shaped = placed.select("project_id", chunk_id.alias("chunk_id"), F.col("position").alias("chunk_index"), F.col("path").alias("file_path"), "language", "start_line", "end_line", "chunker", "symbol_name", "symbol_kind", F.col("content").alias("text"))
        return embedding.embed(shaped, "text", self.provider)

    # --- navigation

    def _files(self, project: str) -> DataFrame:
        rows = self.files.fetch(project)
        if rows is None:
            raise LookupError(f"project is not indexed: {project}")
        return rows

    def list_files(self, project: str, glob: str = "") -> DataFrame:
        return self._files(project).where(paths.glob_matches(F.col("path"), glob)).select("path").orderBy("path")

    def grep(self, project: str, pattern: str, glob: str = "") -> DataFrame:
        """``path, line_no, line``; ``ValueError`` for an empty or invalid pattern."""
        if not pattern:
            raise ValueError("pattern is required")
        try:
            re.compile(pattern)
        except re.error as problem:
            raise ValueError(f"invalid pattern: {problem}") from problem
        kept = self._files(project).where(paths.glob_matches(F.col("path"), glob))
        return text.lines(kept, "content", "path").where(F.col("line").rlike(pattern)).select("path", "line_no", F.rtrim("line").alias("line")).orderBy("path", "line_no")

    def read_file(self, project: str, path: str, start: int | None = None, end: int | None = None) -> str:
        """Numbered lines of a range; bounds are clamped, a start behind the end is an error."""
        if ".." in Path(path).parts or path.startswith("/"):
            raise ValueError("path leads out of the project")
        file = self._files(project).where(F.col("path") == path)
        size = file.select(F.size(text.split_lines("content")).alias("n")).first()
        if size is None or not size.n or size.n < 0:
            raise FileNotFoundError(path)
        first, last = max(1, start or 1), min(size.n, end or size.n)
        if first > last:
            raise ValueError("start is behind the end")
        rows = text.lines(file, "content", "path").where(F.col("line_no").between(first, last)).orderBy("line_no").collect()
        return "\n".join(f"{r.line_no:4d}| {r.line}" for r in rows)

    def facts(self, project: str) -> DataFrame:
        """The facts of a project as they were parsed when it was indexed."""
        rows = self.parsed.fetch(project)
        return parse_files(self._files(project)) if rows is None else rows

    def find_symbol(self, project: str, name: str) -> DataFrame:
        rows = self.facts(project).where("fact in ('function', 'class', 'method', 'global_variable', 'class_variable', 'instance_variable', 'local_variable', 'sql_table')")
        return rows.where(F.col("name") == name).select("path", "line", F.coalesce("qualified", "name").alias("qualified_name"), F.col("fact").alias("kind")).orderBy("path", "line", "qualified_name")

    def structure(self, project: str, path: str) -> dict:
        """Outline of one file: classes with methods, functions, imports, tables."""
        row = self._files(project).where(F.col("path") == path).select("language", "content").first()
        if row is None:
            raise FileNotFoundError(path)
        if row.language not in paths.PARSEABLE_LANGUAGES:
            raise ValueError(f"no outline for language {row.language}")
        facts = parse_text(row.language, row.content or "", path)
        pick = lambda kind: [{k: f[k] for k in ("name", "qualified", "line", "parameters", "bases", "module") if f.get(k) is not None} for f in facts if f["fact"] == kind]
        return {"path": path, "language": row.language, **{f"{k}s": pick(k) for k in ("class", "method", "function", "import", "sql_table")}}

    # --- search

    def search(self, project: str, query: str, k: int = 5, filters: retrieval.Filters = retrieval.Filters(), hybrid: bool = True, rerank: bool = True, alpha: float = retrieval.ALPHA, pool: int = 20) -> DataFrame:
        """The best chunks for a question; none for a project without an index.

        The language goes to the store before the vector leg's top k; the other filters come behind it, but before BM25.
        """
        rows = self.vectors.fetch(project)
        if rows is None or k < 1 or not query.strip():
            return self.spark.createDataFrame([], "chunk_id string, file_path string, start_line int, end_line int, score double")
        vector = self.provider([query])[0]
        stored = rows.where(F.col("language") == filters.language) if filters.language else rows
        nearest = filters.apply(retrieval.l2_topk(stored, vector, max(k, pool), "chunk_id").join(rows.drop("embedding"), "chunk_id"))
        kept = filters.apply(rows)
        if hybrid:
            found = retrieval.bm25_scores(kept, query, "chunk_id", "text").withColumnRenamed("score", "b_raw")
            legs_b = retrieval.min_max(kept.select("chunk_id").join(found, "chunk_id", "left").fillna(0.0, ["b_raw"]), "b_raw", "bm25_score")
            legs_v = retrieval.min_max(nearest.select("chunk_id", F.col("score").alias("v_raw")), "v_raw", "vector_score")
            fused = legs_b.select("chunk_id", "bm25_score").join(legs_v.select("chunk_id", "vector_score"), "chunk_id", "left").fillna(0.0, ["vector_score", "bm25_score"])
            score = F.lit(alpha) * F.col("vector_score") + F.lit(1 - alpha) * F.col("bm25_score")
            ranked = fused.withColumn("score", score).join(kept.drop("embedding"), "chunk_id").orderBy(F.desc("score"), "chunk_index").limit(max(k, pool) if rerank else k)
        else:
            ranked = nearest.orderBy(F.desc("score"), "chunk_id").limit(max(k, pool) if rerank else k)
        if rerank:
            ranked = retrieval.lexical_rerank(ranked, query, k, "chunk_id", "text", "symbol_name")
        return ranked

    # --- graph

    def _graph(self, project: str) -> tuple[DataFrame, DataFrame]:
        loaded = self.graphs.load(project)
        if loaded is None:
            raise LookupError(f"project has no graph: {project}")
        return loaded

    def who_calls(self, project: str, symbol: str) -> DataFrame:
        return graph.who_calls(*self._graph(project), symbol).orderBy("node_id")

    def what_calls(self, project: str, symbol: str) -> DataFrame:
        return graph.what_calls(*self._graph(project), symbol).orderBy("node_id")

    def impact_of(self, project: str, symbol: str) -> DataFrame:
        return graph.impact_of(*self._graph(project), symbol).orderBy("node_id")

    def dependencies_of(self, project: str, path: str) -> DataFrame:
        return graph.dependencies_of(*self._graph(project), path).orderBy("node_id")

    # --- tools

    def tool_json(self, tool: str, project: str | None = None, max_rows: int | None = None, **arguments: object) -> str:
        """One of the retrieval or generation tools by name as JSON text; an error becomes ``{"error": ...}``.

        ``max_rows`` bounds the rows of an answer, which then says how many there are; without it all are given.
        """
        if tool not in TOOLS and tool not in GENERATION_TOOLS:
            return json.dumps({"error": f"unknown tool: {tool}"})
        try:
            answer = generate(tool, **arguments) if tool in GENERATION_TOOLS else getattr(self, tool)(project, **arguments)
        except (ValueError, LookupError, FileNotFoundError) as problem:
            return json.dumps({"error": str(problem)})
        if isinstance(answer, DataFrame):
            shown = answer.drop("embedding")
            if max_rows is not None and (n := shown.count()) > max_rows:
                rows = [r.asDict(recursive=True) for r in shown.limit(max_rows).collect()]
                return json.dumps({"rows": rows, "rows_in_all": n}, indent=2, default=str)
            answer = [r.asDict(recursive=True) for r in shown.collect()]
        return json.dumps(answer, indent=2, default=str)

    @staticmethod
    def draw(code: str, kind: str, language: str = "python") -> str:
        """A diagram or document of a snippet; an unknown kind gives ``{"error": ...}``."""
        try:
            return bundle.render(kind, [f for f in parse_text(language, code) if f["fact"] != "error"], language)
        except ValueError as problem:
            return json.dumps({"error": str(problem)})


TOOLS = ("list_files", "grep", "read_file", "find_symbol", "structure", "search", "who_calls", "what_calls", "impact_of", "dependencies_of")
#: The tools that write a document or diagram of code, and what they render.
GENERATION_TOOLS = {"generate_docstrings": "docstrings", "generate_readme": "readme", "generate_architecture_doc": "architecture_doc", "generate_diagram": None, "generate_svg_flowchart": "svg_flowchart"}


def generate(tool: str, code: str, kind: str = "architecture", language: str = "python") -> str:
    """What a generation tool makes of a snippet; a diagram is of the kind architecture, sequence or dependency."""
    if tool == "generate_diagram" and kind not in ("architecture", "sequence", "dependency"):
        raise ValueError(f"unknown diagram: {kind}")
    if not code.strip():
        raise ValueError("code is required")
    if tool == "generate_docstrings" and language == "python":
        return docs.documented(code, parse_text(language, code))
    return bundle.render(GENERATION_TOOLS[tool] or kind, [f for f in parse_text(language, code) if f["fact"] != "error"], language)


class SessionIndex:
    """Chunks of a few files for one session: built anew from each list, asked by vectors or, without them, by words."""

    def __init__(self, spark: SparkSession, provider: embedding.Provider | None = None, chunk_lines: int = 40) -> None:
        self.spark, self.provider, self.chunk_lines = spark, provider, chunk_lines
        self.chunks: DataFrame | None = None

    def build(self, files: list[dict] | DataFrame | None) -> int:
        """Replace the index; items that are no dictionaries go, null paths and contents count as empty. Chunks made."""
        if not isinstance(files, DataFrame):
            rows = [("" if f.get("path") is None else str(f["path"]), "" if f.get("content") is None else str(f["content"])) for f in files or [] if isinstance(f, dict)]
            files = self.spark.createDataFrame(rows, "path string, text string")
        else:
            files = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("text"))
        keyed = chunking.fixed_chunks(files, self.chunk_lines, ("path",)).withColumn("one", F.lit(1))
        placed = numbered(keyed, "one", "path", "start_line", out="chunk_no").drop("one")
        self.chunks = materialise(embedding.embed(placed, "content", self.provider) if self.provider else placed, "session-chunks")
        return self.chunks.count()

    def retrieve(self, question: str | None, k: int = 5) -> DataFrame:
        """``path, start_line, end_line, content`` of the best chunks in order.

        No rows for ``k`` below 1, a blank question or an empty index. Vectors are asked if there are any of the
        question's width; otherwise, or where the provider fails, the words that question and chunk share decide.
        """
        wanted = ("path", "start_line", "end_line", "content")
        if self.chunks is None or k < 1 or not (question or "").strip():
            return self.spark.createDataFrame([], "path string, start_line int, end_line int, content string")
        best = self._nearest(question.strip(), k) or retrieval.keyword_topk(self.chunks, question, k, "chunk_no", "content")
        return best.join(self.chunks.select("chunk_no", *wanted), "chunk_no").orderBy(F.desc("score"), "chunk_no").select(*wanted)

    def _nearest(self, question: str, k: int) -> DataFrame | None:
        if self.provider is None:
            return None
        try:
            vector = self.provider([question])[0]
        except Exception:  # noqa: BLE001 - any failure of a provider means words
            return None
        width = self.chunks.select(F.max(F.size("embedding")).alias("n")).first().n
        return retrieval.cosine_topk(self.chunks, vector, k, "chunk_no") if vector and width == len(vector) else None
