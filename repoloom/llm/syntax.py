"""Source files that do not parse (problem 6).

Each file is parsed by the recursive-descent parser of the language that the extension of its path names. All errors
are kept, with the first cause; panic-mode recovery goes on behind an error. A Python file with errors is parsed once
more by the interpreter's own parser, which can only clear it. What the table says about language or warnings is not
read.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm.grammars import PARSERS, Error
from repoloom.session import once, spread

#: The language of an extension. Fixed values.
LANGUAGES = {"py": "python", "js": "javascript", "java": "java", "sql": "sql", "json": "json"}


def check(extension: str, content: str) -> list[Error]:
    """All syntax errors of a text in the language of an extension, in order; none for a text that parses."""
    errors = PARSERS[extension](content)
    if errors and extension == "py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(content)
            return []
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            pass
    return errors


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        extensions, contents = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = [check(e, c) for e, c in zip(extensions, contents, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(2), pa.array([len(f) for f in found], pa.int32()), pa.array([f[0].message if f else None for f in found], pa.string()), pa.array([f[0].at if f else None for f in found], pa.int32()),
                pa.array([[{"at": e.at, "message": e.message} for e in f] for f in found], pa.list_(pa.struct([("at", pa.int32()), ("message", pa.string())]))),
            ],
            names=["file_id", "project_id", "extension", "n_errors", "first_cause", "first_at", "errors"],
        )


def errors(files: DataFrame) -> DataFrame:
    """``file_id, project_id, language, n_errors, first_cause, first_at, errors`` of every file of a known extension.

    ``errors`` holds the position and cause of each error in the order in which the parser met them.
    Files with another extension, a null path, or null or empty content are not judged and give no row. A text of
    white space parses in every language but JSON. A file that was delivered twice counts once;
    files with a null id are all judged and kept.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    judged = files.select("file_id", "project_id", extension.alias("extension"), "content").where(F.col("extension").isin(*LANGUAGES) & (F.length("content") > 0))
    out = spread(judged, "file_id").mapInArrow(_parsed, "file_id bigint, project_id string, extension string, n_errors int, first_cause string, first_at int, errors array<struct<at int, message string>>")
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return once(out, "file_id").select("file_id", "project_id", names[F.col("extension")].alias("language"), "n_errors", "first_cause", "first_at", "errors")


def found(files: DataFrame) -> DataFrame:
    """``file_id`` of each file that does not parse."""
    return errors(files).where("n_errors > 0").select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """Per project and language: judged files, files that do not parse, and their share."""
    judged = errors(files).groupBy("project_id", "language").agg(F.count("*").alias("n_files"), F.count_if(F.col("n_errors") > 0).alias("n_invalid"))
    return judged.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))
