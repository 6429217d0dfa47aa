"""Facts of SQL scripts: tables with their columns and the relationships between them."""

from __future__ import annotations

import re

from repoloom.parsers.braces import Lines

_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)
_TABLE = re.compile(r"\bCREATE\s+(?:TEMPORARY\s+|TEMP\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"`\[]?([\w.]+)[\"`\]]?\s*\(", re.I)
_CONSTRAINT = re.compile(r"^(?:CONSTRAINT\s+\S+\s+)?(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|INDEX|KEY|EXCLUDE)\b", re.I)
_FOREIGN = re.compile(r"FOREIGN\s+KEY\s*\(\s*(\w+)\s*\)\s*REFERENCES\s+([\w.]+)\s*(?:\(\s*(\w+)\s*\))?", re.I)
_REFERENCES = re.compile(r"\bREFERENCES\s+([\w.]+)\s*(?:\(\s*(\w+)\s*\))?", re.I)


def _parts(body: str) -> list[tuple[int, str]]:
    """Definitions of a table body: split at commas outside of parentheses and quotes, with their offsets."""
    out, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and depth == 0:
            out.append((start, body[start:i]))
            start = i + 1
    return [*out, (start, body[start:])]


def _close(text: str, at: int) -> int:
    """The offset of the parenthesis that closes the one in front of ``at``."""
    depth = 1
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    return len(text)


def facts(code: str) -> list[dict]:
    """Tables, their columns and foreign keys, in the order of the script.

    The type of a column is its second word with its size. Table constraints are no columns; each foreign key belongs to
    the table whose body it stands in.
    """
    text = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    line, rows = Lines(code), []
    for m in _TABLE.finditer(text):
        table, begin = m[1], m.end()
        body = text[begin : _close(text, begin)]
        rows.append({"fact": "sql_table", "name": table, "qualified": table, "line": line(m.start())})
        keyed: set[str] = set()
        relations: list[dict] = []
        columns: list[dict] = []
        for at, part in _parts(body):
            clean = part.strip()
            if not clean:
                continue
            where = line(begin + at + len(part) - len(part.lstrip()))
            if _CONSTRAINT.match(clean):
                if f := _FOREIGN.search(clean):
                    relations.append({"fact": "sql_relationship", "from_table": table, "from_column": f[1], "to_table": f[2], "to_column": f[3], "type": "foreign_key", "line": where})
                    keyed.add(f[1].lower())
                continue
            d = re.match(r"[\"`\[]?(\w+)[\"`\]]?(?:\s+(\w+(?:\s*\([^)]*\))?))?", clean)
            if not d:
                continue
            upper = clean.upper()
            reference = _REFERENCES.search(clean)
            if reference:
                relations.append({"fact": "sql_relationship", "from_table": table, "from_column": d[1], "to_table": reference[1], "to_column": reference[2], "type": "reference", "line": where})
            columns.append({"fact": "sql_column", "name": d[1], "class_name": table, "qualified": f"{table}.{d[1]}", "type": d[2] or "unknown", "line": where, "is_primary_key": "PRIMARY KEY" in upper, "is_foreign_key": bool(reference), "is_unique": "UNIQUE" in upper, "is_not_null": "NOT NULL" in upper})
        for c in columns:
            c["is_foreign_key"] = c["is_foreign_key"] or c["name"].lower() in keyed
        rows += columns + relations
    return rows
