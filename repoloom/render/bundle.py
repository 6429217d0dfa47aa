"""Renderings of every file as a table: parsed and drawn where the file lies, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from repoloom.parsers.facts import parse_text
from repoloom.render import docs, mermaid, svg
from repoloom.session import spread

KINDS = (*mermaid.DIAGRAMS, "svg_flowchart", "docstrings", "readme", "architecture_doc")


def render(kind: str, facts: list[dict], language: str = "python") -> str:
    """One rendering of one file's facts; ``ValueError`` for an unknown kind."""
    if kind == "flowchart":
        return mermaid.flowchart(facts, language)
    if kind in mermaid.DIAGRAMS:
        return mermaid.DIAGRAMS[kind](facts)
    if kind == "svg_flowchart":
        return svg.flowchart(facts)
    if kind == "docstrings":
        return docs.docstrings(facts)
    if kind == "readme":
        return docs.readme(facts, language)
    if kind == "architecture_doc":
        return docs.architecture(facts)
    raise ValueError(f"unknown rendering: {kind}")


def render_files(files: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``project_id, path, kind, content`` for each file and kind; a file that does not parse is drawn as empty."""
    for kind in kinds:
        if kind not in KINDS:
            raise ValueError(f"unknown rendering: {kind}")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, path, language, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                facts = [f for f in parse_text(language or "text", content or "", path or "") if f["fact"] != "error"]
                rows += [{"project_id": project, "path": path, "kind": kind, "content": render(kind, facts, language or "text")} for kind in kinds]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("project_id", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("content", pa.string())]))

    return spread(files.select("project_id", "path", "language", "content"), "path").mapInArrow(draw, "project_id string, path string, kind string, content string")
