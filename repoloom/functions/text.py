"""Text expressions: lines, offsets, trimming, truncation, tokens and identifiers. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line where every Unicode line boundary counts. Fixed value (Java regex).
LINE_BOUNDARY = r"\r\n|[\n\x0B\x0C\r\x1c-\x1e\x85  ]"
#: Characters that a plain strip removes. Fixed value.
BLANKS = " \t\n\r\f\x0b"
#: Words that a keyword query ignores. Fixed values.
STOP_WORDS = ("the", "is", "are", "where", "what", "how", "in", "of", "and", "to")


def split_lines(text: Column | str) -> Column:
    """The lines of a text by every Unicode boundary; a final boundary opens no further line, '' has no line."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, LINE_BOUNDARY, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def lines_of_code(text: Column) -> Column:
    """Pieces between line feeds: a final line feed counts one more, an empty text one; 0 for null."""
    return F.coalesce(count_newlines(text) + 1, F.lit(0))


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return count_newlines(F.substring(text, F.lit(1), offset)) + 1


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def truncate(text: Column, size: int) -> Column:
    """At most ``size`` characters, the last three dots where something is cut."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size - 3)), F.lit("..."))).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case ASCII words and numbers in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def keywords(text: Column) -> Column:
    """Distinct words without stop words."""
    return F.array_except(F.array_distinct(words(text)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def safe_identifier(text: Column) -> Column:
    """Letters, digits, ``_`` and ``-``; anything else becomes ``_``, outer ``_`` go; an empty result is an error."""
    clean = F.btrim(F.regexp_replace(text, r"[^a-zA-Z0-9_-]", "_"), F.lit("_"))
    return F.when(clean == "", F.raise_error(F.lit("identifier is empty"))).otherwise(clean)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The lower-case last extension with its dot, '' if there is none; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"(?<=[^.])(\.[^.]+)$", 1))


def lines(files: DataFrame, text_col: str = "text", *keys: str) -> DataFrame:
    """One row per line: ``keys``, ``line_no`` from 1 and ``line``. Null and empty texts have no lines."""
    return files.select(*keys, F.posexplode(split_lines(F.col(text_col))).alias("pos", "line")).select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


#: What a setting says to be on. Fixed values.
TRUE_WORDS = ("1", "true", "yes", "on")


def is_true(value: Column) -> Column:
    """Whether a setting given as text is on; null and other words are not."""
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUE_WORDS), F.lit(False))
