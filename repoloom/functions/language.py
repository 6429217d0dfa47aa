"""Programming language of a file by name and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions.paths import EXTENSION_LANGUAGE, language_of

#: Characters of the head that the sure marks are looked for in.
HEAD = 16_000
#: Patterns whose matches count for a language. Fixed values (Java regular expressions).
PATTERNS = {
    "python": (r"(?m)^\s*from\s+\w+(\.\w+)*\s+import\s+", r"(?m)^\s*import(?!\s+static)(?!\s+java\.)[ \t]*[^#\n;]+(?:#.*)?$", r"^\s*def\s+\w+\s*\(", r"^\s*class\s+\w+(\(|:)", r"if\s+__name__\s*==\s*[\"']__main__[\"']", r"^\s*@\w+\s*(?:\n|def|class)"),
    "javascript": (r"(?m)^\s*import\s+[\w*{},\s]+\s+from\s+['\"]", r"(?m)^\s*export\s+(?:default|const|function|class|type)\s+", r"\b=>\s*[{(\n]", r"require\s*\(\s*['\"]", r"console\.(log|error|warn|info)\s*\("),
    "cpp": (r"#include\s*[<\"]", r"\bstd::\w+", r"\b(cout|cin)\b", r"\bnamespace\s+\w+"),
    "c": (r"#include\s*[<\"]", r"\b(printf|scanf|malloc|free|strcpy|memcpy)\s*\("),
    "sql": (r"(?i)\bCREATE\s+TABLE\b", r"(?is)\bSELECT\s+.+\bFROM\b", r"(?i)\bINSERT\s+INTO\b"),
    "java": (r"(?m)^\s*import\s+java\.", r"(?m)^\s*package\s+[\w.]+\s*;\s*$", r"\bpublic\s+class\s+\w+", r"\bpublic\s+static\s+void\s+main"),
    "go": (r"(?m)^\s*package\s+[\w.]+\s*$", r"(?m)^\s*func\s+(\w+|\(\s*[\w*]+\s*[\w.]+\s*\))"),
    "rust": (r"(?m)^\s*(?:pub\s+)?fn\s+\w+\s*\(", r"(?m)^\s*use\s+[\w:]+\s*;\s*$", r"(?m)^\s*(?:pub\s+)?(?:struct|enum|impl|trait)\s+\w+"),
    "ruby": (r"(?m)^\s*require[_ ]+['\"]", r"(?m)^\s*require_relative\s+['\"]", r"(?m)^\s*module\s+\w+\s*$\n"),
    "php": (r"<\?php",),
}
#: Which language wins a tie. Fixed values.
PREFERENCE = ("php", "java", "go", "rust", "sql", "python", "ruby", "javascript", "cpp", "c")
#: Marks in the head that decide at once, in this order; all patterns of a mark must be found. Fixed values.
MARKS = (
    ("python", (r"(?m)^\s*def\s+\w+\s*\([^\n]*\)\s*:",)),
    ("python", (r"(?m)^\s*class\s+\w+[^:\n]*:\s*$\n(?:[ \t]+def|from\s+)",)),
    ("python", (r"(?m)^\s*from\s+\w+(\.\w+)*\s+import\s+",)),
    ("php", (r"(?m)^\s*<\?php",)),
    ("java", (r"^\s*package\s+[\w.]+\s*;\s", r"(?:\bimport\s+java\.|\bpublic\s+class\s+\w+)")),
    ("go", (r"(?m)^\s*package\s+[\w.]+\s*$", r"(?m)^\s*func\s+(?:\w+|\()")),
    ("rust", (r"(?m)^\s*use\s+[\w:]*std::|(?m)^\s*(?:pub\s+)?mod\s+\w+",)),
    ("rust", (r"(?m)^#!\[",)),
)


def from_extension(path: Column) -> Column:
    """The language of a known extension, else null."""
    suffix = F.regexp_extract(F.lower(path), r"(\.[^./\\]*)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair]), suffix)


def scores(code: Column) -> dict[str, Column]:
    """Matches of all patterns by language."""
    out = {}
    for language, patterns in PATTERNS.items():
        total = F.regexp_count(code, F.lit(patterns[0]))
        for pattern in patterns[1:]:
            total = total + F.regexp_count(code, F.lit(pattern))
        out[language] = total
    return out


def from_code(code: Column) -> Column:
    """The language by content: a sure mark in the head, else most matches with ties by preference, else null."""
    head = F.substring(code, 1, HEAD)
    sure = F.lit(None).cast("string")
    for language, patterns in reversed(MARKS):
        found = head.rlike(patterns[0])
        for pattern in patterns[1:]:
            found = found & head.rlike(pattern)
        sure = F.when(found, language).otherwise(sure)
    counted = scores(code)
    ranked = [F.struct(counted[x].alias("n"), F.lit(-i).alias("preference"), F.lit(x).alias("language")) for i, x in enumerate(PREFERENCE)]
    best = F.array_max(F.array(*ranked))
    return F.when(F.length(F.btrim(code)) > 0, F.coalesce(sure, F.when(best["n"] > 0, best["language"])))


def detect(path: Column, code: Column) -> Column:
    """Language of a file: extension, else content, else name; never null."""
    return F.coalesce(from_extension(path), from_code(code), language_of(path))
