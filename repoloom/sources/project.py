"""Scan a directory tree of source files.

A custom data source lists the tree on the driver, which prunes directories before it descends, and reads the files on
the executors. Unlike the built-in file sources it keeps names that begin with ``_`` or ``.``.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from repoloom.functions import language, paths, text
from repoloom.parsers.universal import is_binary
from repoloom.session import cut

#: Bytes of the head that decide whether a file is binary.
HEAD_BYTES = 65_536
FILE_SCHEMA = "path string, absolute_path string, reason string, size bigint, content string, error string"


def walk(root: str, skip: tuple[str, ...] = paths.SKIP_DIRECTORIES) -> Iterator[tuple[str, int, str | None]]:
    """(relative path, size, None) of each file in order, and (path, 0, 'directory') of each pruned directory."""
    stack = [""]
    while stack:
        here = stack.pop()
        entries = sorted(os.scandir(os.path.join(root, here)), key=lambda e: e.name)
        below = []
        for e in entries:
            path = f"{here}/{e.name}" if here else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name in skip:
                    yield path, 0, "directory"
                else:
                    below.append(path)
            elif e.is_file():
                yield path, e.stat().st_size, None
        stack += reversed(below)


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, str | None]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, read: bool, per_partition: int) -> None:
        self.root, self.read_content, self.per_partition = root, read, per_partition

    def partitions(self) -> list[_Part]:
        """Files in groups of bounded total size, largest group first filled in listing order."""
        parts: list[_Part] = []
        group: list[tuple[str, int, str | None]] = []
        size = 0
        for item in walk(self.root):
            group.append(item)
            size += item[1] + 4096
            if size >= self.per_partition:
                parts.append(_Part(group))
                group, size = [], 0
        return [*parts, _Part(group)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, size, reason in partition.files:
            absolute = os.path.join(self.root, path)
            content = error = None
            if reason is None and self.read_content:
                try:
                    with open(absolute, "rb") as f:
                        head = f.read(HEAD_BYTES)
                        if is_binary(head):
                            reason = "binary"
                        else:
                            content = (head + f.read()).decode("utf-8", "ignore")
                except OSError as problem:
                    error = str(problem)
            yield path, absolute, reason, size, content, error


class ProjectSource(DataSource):
    """``spark.read.format("project").option("root", ...)``; options ``content`` and ``bytes_per_partition``."""

    @classmethod
    def name(cls) -> str:
        return "project"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        root = os.path.abspath(self.options["root"])
        return _Reader(root, self.options.get("content", "true") == "true", int(self.options.get("bytes_per_partition", 8 << 20)))


def normalize_folder(text_: str) -> str:
    """A folder as a user types it: quotes go, ``Users/...`` gets its slash, ``~`` is expanded."""
    clean = (text_ or "").strip().strip("'\"").strip()
    if clean.startswith("Users/"):
        clean = "/" + clean
    return os.path.expanduser(clean)


def resolve_folder(text_: str) -> Path:
    """The absolute folder; ``ValueError`` if it is empty, missing or no folder."""
    clean = normalize_folder(text_)
    if not clean:
        raise ValueError("folder path is required")
    path = Path(clean).resolve()
    if not path.exists():
        raise ValueError(f"folder does not exist: {path}")
    if not path.is_dir():
        raise ValueError(f"not a folder: {path}")
    return path


def project_id(path: str | Path) -> str:
    return str(Path(path).expanduser().resolve())


def _listed(spark: SparkSession, root: Path, content: bool) -> DataFrame:
    spark.dataSource.register(ProjectSource)
    return spark.read.format("project").option("root", str(root)).option("content", str(content).lower()).load()


def _rules(root: Path) -> list[tuple[int, str, bool, bool]]:
    ignore = root / ".gitignore"
    return paths.parse_ignore_rules(ignore.read_text(errors="ignore")) if ignore.is_file() else []


def enumerate_files(spark: SparkSession, root: str | Path, extensions: tuple[str, ...] = paths.INDEXABLE_EXTENSIONS, respect_ignore: bool = True) -> DataFrame:
    """``path, reason``: ``indexed``, or why a file or directory is left out (directory, ignored, extension)."""
    root = resolve_folder(str(root))
    listed = _listed(spark, root, False)
    ignored = paths.is_ignored(F.col("path"), _rules(root)) if respect_ignore else F.lit(False)
    reason = F.when(F.col("reason") == "directory", "directory").when(ignored, "ignored").when(~text.extension(F.col("path")).isin(*extensions), "extension").otherwise("indexed")
    return listed.select("path", reason.alias("reason"))


def tree(spark: SparkSession, root: str | Path, glob: str = "") -> DataFrame:
    """``path, size`` of every file of a folder that fits a glob, in order: no ignore rules, no extensions, as it is now."""
    listed = _listed(spark, resolve_folder(str(root)), False).where("reason is null")
    return listed.where(paths.glob_matches(F.col("path"), glob)).select("path", "size").orderBy("path")


def scan_stats(enumerated: DataFrame) -> DataFrame:
    """Files indexed, ignored, of other extensions, directories skipped, and the sorted skipped paths."""
    of = lambda r: F.count_if(F.col("reason") == r)
    return enumerated.agg(of("indexed").alias("files_indexed"), of("ignored").alias("files_skipped_ignore"), of("extension").alias("files_skipped_extension"), of("directory").alias("dirs_skipped"), F.array_sort(F.collect_list(F.when(F.col("reason") != "indexed", F.col("path")))).alias("skipped_paths"))


def scan(spark: SparkSession, root: str | Path) -> DataFrame:
    """Every eligible text file of a tree: ``project_id, path, absolute_path, language, lines_of_code, content, error``.

    A file that cannot be read is a row with its error; binary files and those of other kinds are left out; a folder
    without files gives no row.
    """
    root = resolve_folder(str(root))
    kept = _listed(spark, root, True).where("reason is null").where(paths.is_eligible(F.col("path")))
    lang = language.detect(F.col("path"), F.coalesce("content", F.lit("")))
    return kept.select(F.lit(str(root)).alias("project_id"), "path", "absolute_path", lang.alias("language"), text.lines_of_code(F.col("content")).alias("lines_of_code"), "content", "error")


def from_uploads(spark: SparkSession, uploads: list[tuple[str, bytes]], project: str = "upload") -> DataFrame:
    """Uploaded files as the same table: ineligible paths and binary bytes are left out."""
    rows = [(project, p.lstrip("/"), b.decode("utf-8", "ignore")) for p, b in uploads if not is_binary(b)]
    df = spark.createDataFrame(rows, "project_id string, path string, content string")
    kept = df.where(paths.is_eligible(F.col("path")))
    return kept.withColumn("absolute_path", F.col("path")).withColumn("language", language.detect(F.col("path"), F.col("content"))).withColumn("lines_of_code", text.lines_of_code(F.col("content"))).withColumn("error", F.lit(None).cast("string"))


def from_snippet(spark: SparkSession, code: str, filename: str = "pasted_code.py", language_: str | None = None) -> DataFrame:
    """A pasted snippet as a table of one file; an override must be one of the deep or C languages."""
    if language_ and language_ not in ("python", "javascript", "java", "sql", "c", "cpp"):
        raise ValueError(f"unsupported language: {language_}")
    df = spark.createDataFrame([("snippet", filename, code)], "project_id string, path string, content string")
    return df.withColumn("language", F.lit(language_) if language_ else language.detect(F.col("path"), F.col("content"))).withColumn("lines_of_code", text.lines_of_code(F.col("content")))


def clone(url: str, target: str, timeout: int = 300) -> str:
    """Clone a repository into a folder with ``git``; errors say what was wrong: address, time or git itself."""
    address = url.strip().rstrip("/")
    if not address:
        raise ValueError("repository URL is required")
    if address.startswith("git@") is False and "://" not in address:
        address = f"https://{address}"
    if not address.endswith(".git"):
        address += ".git"
    try:
        subprocess.run(["git", "clone", address, target], check=True, capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired as problem:
        raise TimeoutError(f"cloning took more than {timeout} s") from problem
    except FileNotFoundError as problem:
        raise RuntimeError("git is not installed") from problem
    except subprocess.CalledProcessError as problem:
        raise RuntimeError((problem.stderr or "git clone failed").strip()) from problem
    return target


def snapshot(files: DataFrame) -> DataFrame:
    """The scanned table, cut from the file system so that later steps read one state."""
    return cut(files)
