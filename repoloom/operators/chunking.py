"""Chunks of files by lines, what covers them, and the symbols they belong to. Everything is a Catalyst plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.functions.text import count_newlines, lines, split_lines


def fixed_chunks(files: DataFrame, size: int = 40, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Tumbling chunks of ``size`` lines: ``keys, start_line, end_line, content``; blank chunks and texts have none.

    A size below 1 means 40. One row per file is turned into rows of its chunks without a shuffle.
    """
    size = size if size >= 1 else 40
    parts = files.select(*keys, split_lines(text_col).alias("ls")).where(F.size("ls") > 0)
    at = parts.select(*keys, "ls", F.explode(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(size))).alias("at"))
    content = F.array_join(F.slice("ls", F.col("at") + 1, F.lit(size)), "\n")
    out = at.select(*keys, (F.col("at") + 1).alias("start_line"), F.least(F.size("ls"), F.col("at") + size).alias("end_line"), content.alias("content"))
    return out.where(F.col("content").rlike(r"\S"))


def overlapping_chunks(files: DataFrame, size: int = 40, overlap: int = 15, max_chars: int | None = 1500, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Windows of ``size`` lines that begin every ``size - overlap`` (at least one) lines, until one reaches the end.

    A window longer than ``max_chars`` is cut there and its ``end_line`` follows what is left, while the next window
    still begins where it would; blank windows are left out. Columns: ``keys, chunk_index, start_line, end_line, content``.
    """
    step = max(1, size - overlap)
    parts = files.select(*keys, split_lines(text_col).alias("ls")).where(F.size("ls") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("ls") - size) / step)).cast("int")
    at = parts.select(*keys, "ls", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    start = F.col("k") * step + 1
    whole = F.array_join(F.slice("ls", start, F.lit(size)), "\n")
    text = F.left(whole, F.lit(max_chars)) if max_chars else whole
    out = at.select(*keys, F.col("k").alias("chunk_index"), start.alias("start_line"), F.least(F.size("ls"), start + size - 1).alias("full_end"), whole.alias("whole"), text.alias("content"))
    end = F.when(F.length("whole") > F.length("content"), F.col("start_line") + count_newlines(F.col("content"))).otherwise(F.col("full_end"))
    return out.where(F.col("content").rlike(r"\S")).select(*keys, "chunk_index", "start_line", end.cast("int").alias("end_line"), "content")


def coverage_gaps(files: DataFrame, chunks: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of files that no chunk covers: ``key, line_no``; tiled files give no row."""
    every = lines(files, text_col, key).select(key, "line_no")
    covered = chunks.select(key, F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    return every.join(covered, [key, "line_no"], "left_anti")


def tiled(files: DataFrame, chunks: DataFrame, key: str = "doc_id", text_col: str = "text") -> bool:
    return coverage_gaps(files, chunks, key, text_col).isEmpty()


def symbols_in_chunks(chunks: DataFrame, symbols: DataFrame, key: str = "file_id") -> DataFrame:
    """Each chunk with the symbol it stands for: the first that is declared in its text, else the first in its lines.

    ``chunks``: key, chunk_index, start_line, end_line, content; ``symbols``: key, name, kind, line. The file is the equi
    key of the range join, so that it never leaves the file. Chunks without a symbol keep nulls.
    """
    s = symbols.select(F.col(key).alias("s_key"), "name", "kind", "line")
    inside = (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    declared = F.regexp("content", F.concat(F.lit(r"\b(?:def|class|function|const|let|var)\s+\Q"), F.element_at(F.split("name", r"\."), -1), F.lit(r"\E\b")))
    both = chunks.join(s, (F.col(key) == F.col("s_key")) & inside, "left")
    best = F.min_by(F.struct("name", "kind", "line"), F.struct(~F.coalesce(declared, F.lit(False)), "line", "name", "kind"))
    out = both.groupBy(key, "chunk_index", "start_line", "end_line").agg(best.alias("b"))
    return out.select(key, "chunk_index", "start_line", "end_line", F.col("b.name").alias("symbol_name"), F.col("b.kind").alias("symbol_kind"))


#: Which symbol wins on one line: the later kind. Fixed values.
KIND_ORDER = {"class": 0, "method": 1, "function": 2, "table": 3}


def enclosing(points: DataFrame, symbols: DataFrame, key: str = "file_id") -> DataFrame:
    """As-of join: each point (``key, point_id, line``) with the last symbol that begins at or before its line.

    Both sides are unioned and one window per file carries the last symbol forward: no join, one shuffle on the key.
    Points before any symbol have a null symbol.
    """
    from pyspark.sql.window import Window

    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in KIND_ORDER.items()], F.lit(9))
    s = symbols.select(key, "line", order.alias("o"), F.struct("name", "kind").alias("symbol"), F.lit(None).cast("string").alias("point_id"))
    p = points.select(key, "line", F.lit(99).alias("o"), F.lit(None).cast("struct<name:string,kind:string>").alias("symbol"), F.col("point_id").cast("string").alias("point_id"))
    w = Window.partitionBy(key).orderBy("line", "o", F.col("symbol.name"), "point_id").rowsBetween(Window.unboundedPreceding, 0)
    out = s.unionByName(p).withColumn("last", F.last_value("symbol", F.lit(True)).over(w))
    return out.where("point_id is not null").select(key, "point_id", "line", F.col("last.name").alias("symbol_name"), F.col("last.kind").alias("symbol_kind"))


def relocate(files: DataFrame, pieces: DataFrame, key: str = "doc_id", text_col: str = "text", piece_col: str = "content") -> DataFrame:
    """Lines of pieces of text: where the piece occurs, else where its first line does, else the whole file.

    The pieces of a file, which together are about as long as it, come to its text; the text is not copied for each.
    """
    own = pieces.groupBy(key).agg(F.collect_list(F.struct(*pieces.columns)).alias("_pieces"))
    both = files.select(key, F.col(text_col).alias("_text"), split_lines(text_col).alias("_lines")).join(own, key)

    def placed(p: Column) -> Column:
        at, hit = F.position(p[piece_col], F.col("_text")), F.array_position("_lines", F.element_at(split_lines(p[piece_col]), 1))
        start = F.when(at > 0, count_newlines(F.substring(F.col("_text"), F.lit(1), at - 1)) + 1).when(hit > 0, hit).otherwise(F.lit(1))
        size = F.greatest(F.size(split_lines(p[piece_col])), F.lit(1))
        end = F.when((at > 0) | (hit > 0), F.least(start + size - 1, F.size("_lines"))).otherwise(F.size("_lines"))
        return F.struct(*[p[c].alias(c) for c in pieces.columns], start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))

    return both.select(F.inline(F.transform("_pieces", placed)))
