"""Facts of JavaScript and Java files, by patterns over text whose comments and strings are masked."""

from __future__ import annotations

import re
from bisect import bisect_right

_MASK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
#: Words before a parenthesis that are no names of functions. Fixed values.
NOT_CALLS = frozenset("if for while switch catch return new throw super this".split())


def mask(code: str) -> str:
    """The code with comments and the inside of strings blanked; offsets and line ends stay."""
    return _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


class Lines:
    """1-based line of an offset."""

    def __init__(self, code: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]

    def __call__(self, at: int) -> int:
        return bisect_right(self.starts, at)


def block_end(code: str, at: int) -> int:
    """The offset behind the brace that closes the one at or behind ``at``; the end of the text if none does."""
    depth = 0
    for m in re.finditer(r"[{}]", code[at:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return at + m.end()
    return len(code)


def _arrow_end(text: str, at: int) -> int:
    """The offset behind the body of an arrow function: its block, or all up to the next declaration at a line's start."""
    start = re.compile(r"\s*").match(text, at).end()
    if text[start : start + 1] == "{":
        return block_end(text, start)
    following = re.compile(r"(?m)^(?:export|const|let|var|function|class|import)\b").search(text, start)
    return following.start() if following else len(text)


def _names(inside: str) -> list[str]:
    """Parameter names of a list: defaults, types and rest marks go."""
    out = []
    for part in re.split(r",(?![^{(\[]*[})\]])", inside):
        part = part.split("=")[0].split(":")[0].strip().lstrip(".")
        if part:
            out.append(part)
    return out


def javascript(code: str) -> list[dict]:
    """Imports in five forms, functions, arrow functions, React components, classes with their methods."""
    text, line, rows = mask(code), Lines(code), []
    quoted = r"['\"]([^'\"]+)['\"]"
    for m in re.finditer(rf"\bimport\s+(?:(\w+)\s*,\s*)?\{{([^}}]*)\}}\s*from\s*{quoted}", code):
        if m[1]:
            rows.append({"fact": "import", "kind": "from_import", "module": m[3], "name": m[1], "line": line(m.start())})
        for item in m[2].split(","):
            name, _, alias = (s.strip() for s in item.strip().partition(" as "))
            if name:
                rows.append({"fact": "import", "kind": "from_import", "module": m[3], "name": name, "alias": alias or None, "line": line(m.start())})
    for m in re.finditer(rf"\bimport\s+\*\s+as\s+(\w+)\s+from\s*{quoted}", code):
        rows.append({"fact": "import", "kind": "from_import", "module": m[2], "name": "*", "alias": m[1], "line": line(m.start())})
    for m in re.finditer(rf"\bimport\s+(\w+)\s+from\s*{quoted}", code):
        rows.append({"fact": "import", "kind": "from_import", "module": m[2], "name": m[1], "line": line(m.start())})
    for m in re.finditer(rf"\bimport\s+{quoted}", code):
        rows.append({"fact": "import", "kind": "import", "module": m[1], "line": line(m.start())})
    for m in re.finditer(rf"(?:(?:const|let|var)\s+(\w+)\s*=\s*)?\brequire\s*\(\s*{quoted}\s*\)", code):
        rows.append({"fact": "import", "kind": "require", "module": m[2], "name": m[1], "line": line(m.start())})
    for m in re.finditer(r"\b(async\s+)?function\s*\*?\s*(\w+)\s*\(([^)]*)\)", text):
        component = m[2][:1].isupper() and bool(re.search(r"return\s*\(?\s*<", code[m.end() : block_end(text, m.end())]))
        rows.append({"fact": "function", "name": m[2], "qualified": m[2], "line": line(m.start()), "is_async": bool(m[1]), "is_nested": False, "parameters": _names(m[3]), "is_react_component": component})
    for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(async\s+)?(?:\(([^)]*)\)|(\w+))\s*=>", text):
        component = m[1][:1].isupper()
        if component and not re.search(r"<[A-Za-z>]", code[m.end() : _arrow_end(text, m.end())]):
            continue
        rows.append({"fact": "function", "name": m[1], "qualified": m[1], "line": line(m.start()), "is_async": bool(m[2]), "is_nested": False, "parameters": _names(m[3] if m[3] is not None else m[4]), "is_react_component": component})
    for m in re.finditer(r"\bclass\s+(\w+)(?:\s+extends\s+([\w.]+))?\s*\{", text):
        end = block_end(text, m.end() - 1)
        for k in re.finditer(r"(?m)^[ \t]*(static\s+)?(async\s+)?\*?(#?\w+)\s*\(([^)]*)\)\s*\{", text[m.end() : end]):
            if k[3] not in NOT_CALLS and k[3] not in ("constructor", "get", "set", "function"):
                rows.append({"fact": "method", "name": k[3], "qualified": f"{m[1]}.{k[3]}", "class_name": m[1], "line": line(m.end() + k.start(3)), "is_async": bool(k[2]), "is_static": bool(k[1]), "is_nested": True, "parameters": _names(k[4])})
        rows.append({"fact": "class", "name": m[1], "qualified": m[1], "line": line(m.start()), "bases": [m[2]] if m[2] else []})
    return rows


_MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*"
_METHOD = re.compile(rf"{_MODIFIERS}(?:<[^>{{}}]+>\s*)?[\w.<>\[\],?]+(?:\s*\[\])*\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?\{{")


def java(code: str) -> list[dict]:
    """Imports, classes, methods (also as functions with their qualified names), calls and instantiations."""
    text, line, rows = mask(code), Lines(code), []
    for m in re.finditer(r"(?m)^\s*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", text):
        rows.append({"fact": "import", "kind": "import", "module": m[2], "name": m[2].rsplit(".", 1)[-1], "line": line(m.start(2)), "is_static": bool(m[1])})
    for m in re.finditer(r"\b(?:class|interface|enum)\s+(\w+)(?:\s*<[^{>]*>)?(?:\s+extends\s+([\w.<>, ]+?))?(?:\s+implements\s+([\w.<>, ]+?))?\s*\{", text):
        cls, begin, end = m[1], m.end(), block_end(text, m.end() - 1)
        bases = [b.strip() for g in (m[2], m[3]) if g for b in re.split(r",(?![^<]*>)", g)]
        inner = [(begin + n.start(), block_end(text, begin + n.end() - 1)) for n in re.finditer(r"\b(?:class|interface|enum)\s+\w+[^{;]*\{", text[begin:end])]
        before = len(rows)
        for k in _METHOD.finditer(text, begin, end):
            at = k.start(1)
            if k[1] in NOT_CALLS or any(a <= at < b for a, b in inner) or re.match(r"\s*(?:new|return|else|throw)\b", k[0]):
                continue
            name = f"{cls}.{k[1]}"
            params = [p.strip() for p in re.split(r",(?![^<]*>)", k[2]) if p.strip()]
            shared = {"line": line(at), "parameters": params, "is_async": False, "is_static": "static" in k[0].split(k[1])[0].split()}
            rows.append({"fact": "method", "name": k[1], "qualified": name, "class_name": cls, "is_nested": True, **shared})
            rows.append({"fact": "function", "name": name, "qualified": name, "is_nested": False, **shared})
            stop = block_end(text, k.end() - 1)
            rows += _java_calls(text, k.end(), stop, name, line)
        if len(rows) == before:  # what a class without methods calls, it calls itself
            rows += _java_calls(text, begin, end, cls, line)
        rows.append({"fact": "class", "name": cls, "qualified": cls, "line": line(m.start()), "bases": bases})
    return rows


def _java_calls(text: str, begin: int, end: int, caller: str, line: Lines) -> list[dict]:
    out = []
    for m in re.compile(r"(?<![\w.])(\w+)\s*\(").finditer(text, begin, end):
        if m[1] not in NOT_CALLS:
            out.append({"fact": "function_call", "caller": caller, "name": m[1], "line": line(m.start())})
    for m in re.compile(r"(\w+)\.(\w+)\s*\(").finditer(text, begin, end):
        if m[1] not in ("this", "super"):
            out.append({"fact": "method_call", "caller": caller, "class_name": m[1], "name": m[2], "line": line(m.start())})
            if m[2][0].isupper():  # reads like the constructor of an inner class
                out.append({"fact": "class_instantiation", "caller": caller, "class_name": m[2], "name": m[2], "line": line(m.start())})
    for m in re.compile(r"\bnew\s+(\w+)\s*(?:<[^>]*>)?\s*\(").finditer(text, begin, end):
        out.append({"fact": "class_instantiation", "caller": caller, "class_name": m[1], "name": m[1], "line": line(m.start())})
    return out
