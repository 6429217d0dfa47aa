"""Recursive-descent parsers with precedence-climbing expressions and panic-mode recovery, one per language."""

from __future__ import annotations

from repoloom.llm.grammars.base import Error
from repoloom.llm.grammars.java import parse_java
from repoloom.llm.grammars.javascript import parse_javascript
from repoloom.llm.grammars.json import parse_json
from repoloom.llm.grammars.python import parse_python
from repoloom.llm.grammars.sql import parse_sql

PARSERS = {"py": parse_python, "js": parse_javascript, "java": parse_java, "sql": parse_sql, "json": parse_json}

__all__ = ["PARSERS", "Error"]
