"""Stores on shared storage: chunks with vectors, graphs, evaluation records, reports. All are Parquet or JSON lines."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

GOLDEN_SCHEMA = "id string, category string, question string, expected_answer string, expected_source_file string, expected_context string"
RESULT_SCHEMA = (
    "mode string, id string, category string, question string, expected_answer string, answer string, contexts array<string>, sources array<string>, tool_trace array<struct<tool:string,args:string,tool_call_id:string>>, latency_ms double, tokens struct<prompt:int,completion:int,total:int>, scores map<string,double>, error string, scored_at timestamp"
)
PROVIDERS = ("parquet",)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class TableStore:
    """One partition per project; writing a project replaces its partition and leaves the others."""

    def __init__(self, spark: SparkSession, root: str, name: str, provider: str = "parquet") -> None:
        if provider not in PROVIDERS:
            raise ValueError(f"unknown store: {provider}")
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def upsert(self, rows: DataFrame) -> int:
        """Replace the projects that ``rows`` (with ``project_id``) hold; the number of rows, counted as they are written."""
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(self.path)
        return int(seen.get["n"])

    def fetch(self, project: str) -> DataFrame | None:
        """One project's rows, by partition pruning; None if nothing was ever written."""
        if not _exists(self.spark, self.path):
            return None
        try:
            return self.spark.read.parquet(self.path).where(F.col("project_id") == project)
        except AnalysisException:  # every partition has been dropped
            return None

    def has(self, project: str) -> bool:
        rows = self.fetch(project)
        return rows is not None and not rows.limit(1).isEmpty()

    def delete(self, project: str) -> None:
        """Drop one project's partition; a project that is not there is no error."""
        from urllib.parse import quote

        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/project_id={quote(project, safe='')}")
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class GraphStore:
    """Nodes and edges of projects."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.nodes, self.edges = TableStore(spark, root, "graph_nodes"), TableStore(spark, root, "graph_edges")

    def save(self, project: str, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes.upsert(nodes.withColumn("project_id", F.lit(project)))
        self.edges.upsert(edges.withColumn("project_id", F.lit(project)))

    def load(self, project: str) -> tuple[DataFrame, DataFrame] | None:
        if not self.has(project):
            return None
        edges = self.edges.fetch(project)
        nodes = self.nodes.fetch(project).drop("project_id")
        return nodes, (edges.drop("project_id") if edges is not None else None)

    def has(self, project: str) -> bool:
        return self.nodes.has(project)

    def delete(self, project: str) -> None:
        self.nodes.delete(project)
        self.edges.delete(project)


def metadata_map(columns: dict[str, Column]) -> Column:
    """Metadata as a map of texts for stores that take nothing else: nulls go, lists become JSON, other values texts."""
    values = F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*[c.cast("string") for c in columns.values()]))
    return F.map_filter(values, lambda _, v: v.isNotNull())


def plain_metadata(metadata: dict, text: str) -> dict:
    """Metadata for a store that takes scalars and lists of texts only, with the text of the chunk."""
    out: dict = {"text": text}
    for key, value in metadata.items():
        if isinstance(value, list):
            out[key] = [str(x) for x in value]
        elif value is not None:
            out[key] = value if isinstance(value, str | int | float | bool) else str(value)
    return out


def is_ready(vectors: TableStore, graphs: GraphStore, project: str) -> bool:
    """A project can be asked once it has both vectors and a graph."""
    return vectors.has(project) and graphs.has(project)


def load_golden(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Golden items from JSON lines; blank lines go, a missing category is ``retrieval``, other fields are ''."""
    rows = spark.read.schema(GOLDEN_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("id is not null")
    filled = rows.fillna({"category": "retrieval"}).fillna("")
    return filled.orderBy("id").limit(limit) if limit else filled


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("mode").json(path)


def load_results(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], RESULT_SCHEMA)
    rows = spark.read.schema(RESULT_SCHEMA).json(path)
    return rows.where(F.col("mode") == mode) if mode else rows


def write_report(summary: DataFrame, folder: str, title: str = "Evaluation") -> tuple[str, str]:
    """A summary as JSON and as a Markdown table, stamped in UTC, whole whatever its size; both paths."""
    stamp = dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%SZ")
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    as_json, as_text = out / f"report-{stamp}.json", out / f"report-{stamp}.md"
    show = lambda v: "n/a" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = summary.columns
    with as_json.open("w") as j, as_text.open("w") as t:
        j.write(json.dumps({"created_at": stamp})[:-1] + ', "rows": [')
        t.write("\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), ""]))
        for n, row in enumerate(summary.toLocalIterator()):  # all rows, one partition at a time
            r = row.asDict(recursive=True)
            j.write((", " if n else "") + json.dumps(r, default=str))
            t.write("| " + " | ".join(show(r[c]) for c in head) + " |\n")
        j.write("]}")
    return str(as_json), str(as_text)
