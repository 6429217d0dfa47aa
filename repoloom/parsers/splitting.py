"""Chunks of one file at the boundaries of its code, with the cascade of fallbacks."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from repoloom.parsers.braces import block_end, mask
from repoloom.session import spread

Piece = tuple[int, int, str]  # first line, last line, text


def _python_units(lines: list[str], content: str) -> list[tuple[int, int]]:
    """Line ranges of statements, large classes and functions opened up, comments kept with what follows."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(content)
    starts: set[int] = {1}

    def visit(body: list[ast.stmt], depth: int) -> None:
        for node in body:
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            starts.add(first)
            if depth < 2 and isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.end_lineno - first > 8:
                visit(node.body, depth + 1)

    visit(tree.body, 0)
    order = sorted(starts)
    return [(a, b - 1) for a, b in zip(order, [*order[1:], len(lines) + 1], strict=True)]


def _brace_units(lines: list[str], content: str) -> list[tuple[int, int]]:
    """Line ranges of blocks at the outermost two levels of braces."""
    text = mask(content)
    starts = {1}
    offset, at = [], 0
    for line in lines:
        offset.append(at)
        at += len(line) + 1
    for n, line in enumerate(lines, 1):
        if re.match(r"(?:export\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|async\s+)*(?:class|interface|enum|function|const|let|var|import|package)\b", line) or re.match(r"(?: {2,4}|\t)[\w<].*\)\s*(?:throws [\w., ]+)?\{\s*$", line):
            starts.add(n)
        if line.startswith("}") and n < len(lines):
            starts.add(n + 1)
    if block_end(text, 0) == len(text) and text.count("{") != text.count("}"):
        raise ValueError("unbalanced braces")
    order = sorted(starts)
    return [(a, b - 1) for a, b in zip(order, [*order[1:], len(lines) + 1], strict=True)]


def by_code(content: str, language: str, max_chars: int) -> list[Piece]:
    """Whole units packed up to ``max_chars``; every line is in exactly one chunk. Raises if the code does not parse."""
    lines = content.splitlines()
    if language == "python":
        units = _python_units(lines, content)
    elif language in ("javascript", "java"):
        units = _brace_units(lines, content)
    else:
        raise ValueError(f"no code splitter for {language}")
    out: list[Piece] = []
    first = last = 0
    size = 0
    for a, b in units:
        n = sum(len(x) + 1 for x in lines[a - 1 : b])
        if first and size + n > max_chars:
            out.append((first, last, "\n".join(lines[first - 1 : last])))
            first = 0
        if not first:
            first, size = a, 0
        last, size = b, size + n
    if first:
        out.append((first, last, "\n".join(lines[first - 1 : last])))
    final: list[Piece] = []
    for a, b, text in out:
        final += [(a, b, text)] if len(text) <= max_chars else [(a + x - 1, a + y - 1, t) for x, y, t in packed_lines(text, max_chars)]
    return final


def packed_lines(content: str, max_chars: int) -> list[Piece]:
    """Lines packed up to ``max_chars``, each in one piece; a longer line is alone."""
    lines = content.splitlines()
    out, at = [], 0
    while at < len(lines):
        end, length = at, 0
        while end < len(lines) and (end == at or length + len(lines[end]) + 1 <= max_chars):
            length += len(lines[end]) + 1
            end += 1
        out.append((at + 1, end, "\n".join(lines[at:end])))
        at = end
    return out


def by_lines(content: str, size: int, overlap: int, max_chars: int) -> list[Piece]:
    """Windows of ``size`` lines that begin every ``size - overlap`` lines (at least one) until one reaches the end.

    A window longer than ``max_chars`` is cut there and its last line follows what is left; the next one begins where it
    would anyhow, so that lines behind a cut may be in no window.
    """
    lines = content.splitlines()
    step = max(1, size - overlap)
    out = []
    for at in range(0, max(1, len(lines) - size + step), step) if lines else ():
        whole = "\n".join(lines[at : at + size])
        text = whole[:max_chars]
        out.append((at + 1, at + 1 + text.count("\n") if len(text) < len(whole) else min(len(lines), at + size), text))
    return out


def by_sentences(content: str, max_chars: int) -> list[Piece]:
    """Sentences packed up to ``max_chars``, for text without usable lines."""
    out, start = [], 0
    ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n", content)] + [len(content)]
    last = 0
    for end in ends:
        if end - start > max_chars and last > start:
            out.append((start, last))
            start = last
        last = end
    out.append((start, len(content)))
    line = lambda at: content.count("\n", 0, at) + 1
    return [(line(a), line(max(a, b - 1)), content[a:b]) for a, b in out if content[a:b].strip()]


def chunk(content: str, language: str, size: int = 40, overlap: int = 15, max_chars: int = 1500) -> list[tuple[int, int, str, str]]:
    """(first line, last line, text, chunker) by the first way that works: code, lines, sentences, whole file."""
    if not content or not content.strip():
        return []
    ways = (("code_splitter", lambda: by_code(content, language, max_chars)), ("fallback_lines", lambda: by_lines(content, size, overlap, max_chars) if "\n" in content.strip() else []), ("fallback_sentences", lambda: by_sentences(content, max_chars)), ("fallback_whole_file", lambda: [(1, len(content.splitlines()), content)]))
    for name, way in ways:
        try:
            pieces = [p for p in way() if p[2].strip()]
        except (SyntaxError, ValueError, RecursionError):
            continue
        if pieces:
            return [(*p, name) for p in pieces]
    return []


def code_chunks(files: DataFrame, size: int = 40, overlap: int = 15, max_chars: int = 1500) -> DataFrame:
    """``project_id, path, language, chunk_index, start_line, end_line, content, chunker`` of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for project, path, language, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for n, (a, b, text, chunker) in enumerate(chunk(content or "", language or "text", size, overlap, max_chars)):
                    rows.append({"project_id": project, "path": path, "language": language, "chunk_index": n, "start_line": a, "end_line": b, "content": text, "chunker": chunker})
            schema = pa.schema([("project_id", pa.string()), ("path", pa.string()), ("language", pa.string()), ("chunk_index", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("chunker", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spread(files.select("project_id", "path", "language", "content"), "path").mapInArrow(run, "project_id string, path string, language string, chunk_index int, start_line int, end_line int, content string, chunker string")
