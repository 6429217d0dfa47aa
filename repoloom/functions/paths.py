"""Path patterns as regular expressions: shell globs, right-anchored globs and ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that no scan enters. Fixed values.
SKIP_DIRECTORIES = (".git", "__pycache__", "node_modules", ".venv", "venv", "env", ".env", "dist", "build", "target", ".next", ".pytest_cache", ".mypy_cache", ".idea", ".vscode", "bin", "obj", ".vs", "coverage", ".coverage")
#: Path segments that make a file ineligible for parsing. Fixed values.
SKIP_SEGMENTS = (".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".pytest_cache", ".mypy_cache", "target", "coverage")
#: Language of a special file name. Fixed values.
SPECIAL_NAMES = {"dockerfile": "dockerfile", "makefile": "make", "gnumakefile": "make", "gemfile": "ruby", "rakefile": "ruby", "vagrantfile": "ruby", "jenkinsfile": "groovy", "justfile": "just"}
#: Extensions of images, media, archives, documents, fonts and binaries. Fixed values.
SKIP_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".bmp", ".tiff", ".tif", ".heic", ".psd", ".mp4", ".webm", ".avi", ".mkv", ".mov", ".mp3", ".wav", ".flac",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".exe", ".dll", ".so", ".dylib", ".pdb", ".o", ".a", ".lib", ".class", ".pyc", ".pyo", ".pyd", ".wasm", ".bin", ".dat", ".db", ".sqlite", ".sqlite3",
)
#: Language of an extension. Fixed values.
EXTENSION_LANGUAGE = {
    ".py": "python", ".pyw": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "javascript",
    ".tsx": "javascript", ".sql": "sql", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".fs": "fsharp", ".vb": "vb",
    ".go": "go", ".rs": "rust", ".php": "php", ".phtml": "php", ".rb": "ruby", ".rake": "ruby", ".swift": "swift", ".scala": "scala",
    ".clj": "clojure", ".hs": "haskell", ".ml": "ocaml", ".lua": "lua", ".r": "r", ".pl": "perl", ".pm": "perl", ".sh": "shell",
    ".bash": "shell", ".zsh": "shell", ".ps1": "powershell", ".bat": "batch", ".cmd": "batch", ".c": "c", ".h": "c", ".cc": "cpp",
    ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".hh": "cpp", ".html": "html", ".htm": "html", ".xhtml": "html",
    ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".json": "json", ".jsonc": "json", ".yml": "yaml", ".yaml": "yaml",
    ".xml": "xml", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".md": "markdown", ".mdx": "markdown", ".rst": "rst", ".txt": "text",
    ".vue": "vue", ".svelte": "svelte", ".dart": "dart", ".proto": "protobuf", ".graphql": "graphql", ".gql": "graphql",
}
#: What the index takes, and what navigation and parsing take. Fixed values.
INDEXABLE_EXTENSIONS = (".py", ".pyw", ".pyi", ".js", ".jsx", ".mjs", ".java", ".sql")
SUPPORTED_EXTENSIONS = (".py", ".pyw", ".pyi", ".js", ".jsx", ".mjs", ".java", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx", ".php", ".phtml", ".sql", ".md", ".txt", ".json", ".yaml", ".yml", ".toml", ".html", ".css")
PARSEABLE_LANGUAGES = ("python", "javascript", "java", "sql")


def fnmatch_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` and ``?`` match separators as well."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i:j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def right_anchored_regex(pattern: str) -> str:
    """A pattern of path segments that must match the last segments of a path; ``*`` stays inside a segment."""
    segments = [s for s in pattern.split("/") if s]
    parts = [fnmatch_regex(s)[5:-1].replace(".*", "[^/]*") if s != "**" else "[^/]*" for s in segments]
    return ("^" if pattern.startswith("/") else "(?:^|/)") + "/".join(parts) + "$"


def glob_matches(path: Column, pattern: str) -> Column:
    """Whether a relative path fits a glob: '' and ``*`` and ``**/*`` fit all; ``**/x`` also fits ``x`` at the root."""
    if pattern in ("", "*", "**/*"):
        return F.lit(True)
    name = F.substring_index(path, "/", -1)
    fits = path.rlike(right_anchored_regex(pattern)) | (path == pattern) | (name == pattern)
    if pattern.startswith("**/"):
        fits = fits | path.rlike(right_anchored_regex(pattern[3:]))
    return fits


def parse_ignore_rules(text: str) -> list[tuple[int, str, bool, bool]]:
    """(order, pattern, negated, directories only) of the lines of an ignore file; blank lines and comments go."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only = line.endswith("/")
        out.append((len(out), line.rstrip("/") if only else line, negated, only))
    return out


def ignore_rule_regex(pattern: str) -> str:
    """What one ignore rule matches: anchored if it begins with ``/``, else the name, the path or any tail of it."""
    if pattern.startswith("/"):
        body = fnmatch_regex(pattern[1:])[5:-1]
        return f"(?s)^{body}(?:/.*)?$"
    body = fnmatch_regex(pattern)[5:-1]
    return f"(?s)^(?:.*/)?{body}(?:/.*)?$"


def is_ignored(path: Column, rules: list[tuple[int, str, bool, bool]], is_directory: Column | None = None) -> Column:
    """The last rule that matches decides; no match means kept. A rule for directories also covers what lies below."""
    out = F.lit(False)
    for _, pattern, negated, only in rules:
        fits = path.rlike(ignore_rule_regex(pattern))
        if only:
            below = path.rlike(ignore_rule_regex(pattern).replace("(?:/.*)?$", "/.*$"))
            fits = below | (fits & is_directory) if is_directory is not None else below
        out = F.when(fits, F.lit(not negated)).otherwise(out)
    return out


def is_eligible(path: Column) -> Column:
    """Whether a file is parsed at all, by its path alone; '' is not, an unknown extension is."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name = F.lower(F.element_at(parts, -1))
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    skipped = F.exists(parts, lambda x: x.isin(*SKIP_SEGMENTS))
    special = name.isin(*SPECIAL_NAMES) | F.contains(name, F.lit("dockerfile"))
    return F.when(F.coalesce(path, F.lit("")) == "", False).when(skipped, False).when(special, True).when((suffix == "") | (suffix == name), True).otherwise(~suffix.isin(*SKIP_EXTENSIONS))


def language_of(path: Column) -> Column:
    """The language by extension, else by special name, else ``text``."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair])
    special = F.create_map(*[F.lit(x) for pair in SPECIAL_NAMES.items() for x in pair])
    by_extension = F.try_element_at(table, F.regexp_extract(name, r"(\.[^.]*)$", 1))
    by_name = F.try_element_at(special, F.regexp_replace(name, "[^a-z0-9]", ""))
    return F.coalesce(by_extension, by_name, F.when(F.contains(name, F.lit("dockerfile.")), "dockerfile"), F.lit("text"))


def is_supported(path: Column) -> Column:
    """Whether the extension belongs to a known language."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    return F.regexp_extract(name, r"(\.[^.]*)$", 1).isin(*EXTENSION_LANGUAGE)


def supported_extensions() -> list[str]:
    return sorted(EXTENSION_LANGUAGE)
